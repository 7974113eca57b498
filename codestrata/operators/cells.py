"""Pairs of items by what they share, block by block: each item's set is a row of bits, and a task compares two blocks.

Nothing is gathered but a block, and a task writes either the pairs, row by row, or what they come to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a block, about; rows of a block that are compared at once; bytes of their bits that are widened at once.
BLOCK, STRIP, WIDE = 2048, 128, 1024


class Blocks(NamedTuple):
    """rows (block, file, total, size, bits) of count blocks; bits are width bytes."""

    rows: DataFrame
    count: int
    width: int


def packed(listed: DataFrame, width: int) -> DataFrame:
    """listed with its column at (positions in a set) as bits (width bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 25) // (8 * width))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                at = part.column("at")
                bits = np.zeros((part.num_rows, 8 * width), bool)
                bits[np.repeat(np.arange(part.num_rows), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = True
                rows = pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), rows], names=[*kept, "bits"])

    kept = [c for c in listed.columns if c != "at"]
    types = ", ".join(f"`{c}` {listed.schema[c].dataType.simpleString()}" for c in kept)
    return listed.select(*kept, "at").mapInArrow(run, f"{types}, bits binary")


class _Side:
    """A block's items as arrays."""

    def __init__(self, rows: pa.StructArray):
        self.file, self.label = rows.field("file"), rows.field("label")
        self.total, self.size = (rows.field(c).to_numpy().astype(np.float64) for c in ("total", "size"))
        self.bits = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint8).reshape(len(rows), -1)

    def shared(self, other: _Side) -> np.ndarray:
        """How many members each pair of sets shares; whole numbers below 2**24 are exact in 32 bits."""
        out = np.zeros((len(self.bits), len(other.bits)), np.float32)
        for c in range(0, self.bits.shape[1], WIDE):
            a, b = (np.unpackbits(s.bits[:, c : c + WIDE], axis=1).astype(np.float32) for s in (self, other))
            out += a @ b.T
        return out


def _compared(a: _Side, b: _Side, same: bool, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shared, ratio, which pairs count) of a strip of rows; in a block with itself a pair is met once.

    An item is paired with itself where it stands for several.
    """
    met = a.shared(b)
    for start in range(0, len(met), STRIP):
        shared = met[start : start + STRIP].astype(np.float64)
        ratio = shared / np.maximum(a.total[start : start + STRIP, None], b.total[None, :])
        held = (shared > 0) & (ratio >= least)
        if same:
            held &= np.arange(start, start + len(shared))[:, None] <= np.arange(len(b.total))[None, :]
            row = np.arange(len(shared))
            held[row, start + row] &= a.size[start + row] > 1
        yield start, shared, ratio, held


def _run(blocks: Blocks, compare: Callable, schema: str, labels: DataFrame | None = None) -> DataFrame:
    """compare(a, b, same) of each two blocks; labels (file, label) are known to their items."""
    rows = blocks.rows.join(labels, "file", "left") if labels is not None else blocks.rows.withColumn("label", F.lit(None).cast(blocks.rows.schema["file"].dataType))
    whole = rows.groupBy("block").agg(F.collect_list(F.struct("file", "total", "size", "bits", "label")).alias("rows"))
    cells = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks.count - 1))).alias("o")).select(
        F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rows"
    )
    cells = cells.repartition(min(20_000, max(cells.sparkSession.sparkContext.defaultParallelism, blocks.count * (blocks.count + 1) // 2)), "i", "j")
    cells = cells.groupBy("i", "j").agg(F.collect_list(F.struct("block", "rows")).alias("sides")).where("i = j or size(sides) = 2")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                sides = [_Side(rows.values) for rows in batch.column("sides")[at].values.field("rows")]
                yield from compare(sides[0], sides[-1], len(sides) == 1)

    return cells.select("sides").mapInArrow(run, schema)


def pairs(blocks: Blocks, least: float, few: int = 0, many: int = 1 << 62) -> DataFrame:
    """(file_a, file_b, shared, total_a, total_b, ratio, links), in no order of a and b, as they are found.

    links are the pairs that two items stand for, above few and up to many.
    """
    kind = blocks.rows.schema["file"].dataType.simpleString()

    def compare(a: _Side, b: _Side, same: bool) -> Iterator[pa.RecordBatch]:
        for start, shared, ratio, held in _compared(a, b, same, least):
            x, y = np.nonzero(held)
            links = np.where(same & (x + start == y), b.size[y] * (b.size[y] - 1) / 2, a.size[x + start] * b.size[y])
            some = (links > few) & (links <= many)
            if not some.all():
                x, y, links = x[some], y[some], links[some]
            if not len(x):
                continue
            whole = (shared[x, y], a.total[x + start], b.total[y])
            arrays = [a.file.take(pa.array(x + start)), b.file.take(pa.array(y)), *(pa.array(v.astype(np.int64)) for v in whole), pa.array(ratio[x, y]), pa.array(links.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["file_a", "file_b", "shared", "total_a", "total_b", "ratio", "links"])

    return _run(blocks, compare, f"file_a {kind}, file_b {kind}, shared long, total_a long, total_b long, ratio double, links long")


def counts(blocks: Blocks, least: float) -> DataFrame:
    """(shared, larger, links): how many pairs at or above least share so many of the larger set's members."""

    def compare(a: _Side, b: _Side, same: bool) -> Iterator[pa.RecordBatch]:
        wide = int(max(a.total.max(), b.total.max())) + 1
        for start, shared, _, held in _compared(a, b, same, least):
            size = a.size[start : start + len(held)]
            links = size[:, None] * b.size[None, :]
            if same:
                row = np.arange(len(held))
                links[row, start + row] = size * (size - 1) / 2
            keys = (shared * wide + np.maximum(a.total[start : start + len(held), None], b.total[None, :]))[held].astype(np.int64)
            if wide * wide <= 1 << 20:
                n = np.bincount(keys, links[held])
                found = np.flatnonzero(n)
                n = n[found]
            else:
                found, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, links[held])
            arrays = [pa.array(v.astype(np.int64)) for v in (found // wide, found % wide, n)]
            yield pa.RecordBatch.from_arrays(arrays, names=["shared", "larger", "links"])

    return _run(blocks, compare, "shared long, larger long, links long").groupBy("shared", "larger").agg(F.sum("links").alias("links"))


def _pieces(held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each connected piece; every row and column is looked at once."""
    turned = np.ascontiguousarray(held.T)
    rows_left, columns_left = held.any(1), held.any(0)
    while rows_left.any():
        rows = np.array([rows_left.argmax()])
        rows_left[rows] = False
        all_rows, all_columns = [rows], []
        while len(rows):
            columns = np.flatnonzero(held[rows].any(0) & columns_left)
            columns_left[columns] = False
            rows = np.flatnonzero(turned[columns].any(0) & rows_left)
            rows_left[rows] = False
            all_rows.append(rows)
            all_columns.append(columns)
        yield np.concatenate(all_rows), np.concatenate(all_columns)


def forest(blocks: Blocks, least: float) -> DataFrame:
    """(file_a, file_b): edges that join the same items as all pairs at or above least, at most one an item and cell."""
    kind = blocks.rows.schema["file"].dataType.simpleString()

    def compare(a: _Side, b: _Side, same: bool) -> Iterator[pa.RecordBatch]:
        held = np.concatenate([h for *_, h in _compared(a, b, same, least)])
        if same:  # an item is a row and a column, which belong together
            held |= held.T
            np.fill_diagonal(held, held.any(1))
        for rows, columns in _pieces(held):
            ends = pa.concat_arrays([a.file.take(pa.array(rows)), *([] if same else [b.file.take(pa.array(columns))])])
            yield pa.RecordBatch.from_arrays([ends.take(pa.array(np.zeros(len(ends), np.int64))), ends], names=["file_a", "file_b"])

    return _run(blocks, compare, f"file_a {kind}, file_b {kind}")


def sums(blocks: Blocks, labels: DataFrame, least: float) -> DataFrame:
    """(label, ratios, links): the pairs at or above least of items of the same label (file, label), summed by it."""
    kind = labels.schema["label"].dataType.simpleString()

    def compare(a: _Side, b: _Side, same: bool) -> Iterator[pa.RecordBatch]:
        both = pa.concat_arrays([a.label, b.label]).dictionary_encode()
        codes = both.indices.fill_null(-1).to_numpy()
        ca, cb = codes[: len(a.total)], codes[len(a.total) :]
        out = np.zeros((2, len(both.dictionary) + 1))  # the last one is that of no label
        for start, _, ratio, held in _compared(a, b, same, least):
            here, size = ca[start : start + len(held)], a.size[start : start + len(held)]
            held &= (here[:, None] == cb[None, :]) & (here >= 0)[:, None]
            weights = held.astype(np.float64)
            if same:  # an item with itself: each two of those that it stands for
                row = np.arange(len(held))
                weights[row, start + row] *= (size - 1) / (2 * size)
            for at, v in enumerate((weights * ratio, weights)):
                np.add.at(out[at], here, (v @ b.size) * size)
        some = np.flatnonzero(out[1, :-1])
        if len(some):
            arrays = [both.dictionary.take(pa.array(some)), pa.array(out[0, some]), pa.array(out[1, some])]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "ratios", "links"])

    found = _run(blocks, compare, f"label {kind}, ratios double, links double", labels)
    return found.groupBy("label").agg(F.sum("ratios").alias("ratios"), F.sum("links").alias("links"))
