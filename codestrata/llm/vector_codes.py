"""Product codes of vectors: each part of a vector becomes the index of its nearest codebook entry.

Codebooks are fitted by Lloyd's rounds with Elkan's bounds over all rows. A written table holds, per vector and part, its
entry, an upper bound of the distance to it, and one lower bound per entry (a byte each, rounded down, with one scale
for a part). When entries have moved, upper bounds grow by the way of the own entry and lower bounds shrink by that of
each. An entry is passed over only if a bound is strictly above the upper bound, by the triangle inequality, with room
for rounding; what is left is compared by exact integer distances, so ties go to the lower index whatever the bounds
were. Only (part, entry) sums, combined on the map side, leave the tasks: the driver sees codebooks, 256 entries, never
rows. Each round's table is written to the shared folder and read once more for the sums; it is deleted after the next.

Cases: vectors that are null or hold null or non-finite components are dropped. Vectors shorter than the longest, and
lengths that four doesn't divide, are filled up with zeros. Components count as no more than the largest magnitude at
which a squared distance still fits into 64 bits (above 100,000 for parts of up to 256 components). With fewer than 256
vectors codebooks have as many entries as there are vectors. Repeated vec_ids are vectors of their own, equal ones in
order of their components; a null vec_id comes after all others. Null labels are one label. Other columns, whatever
their names, are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Room for rounding in comparisons of bounds, relative.
ROOM = 1e-9
#: Rows of one block of distances.
BLOCK = 2048


def limit(width: int) -> int:
    """The largest magnitude of a component at which the squared distance of two parts of this width fits into a long."""
    return math.isqrt((2**62) // max(1, width)) // 2


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:  # every step is a whole number that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book], 1)


class Part:
    """One part's codebook with what a round needs: half distances between entries and the way each has moved."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None = None) -> None:
        self.book = book
        self.moved = np.zeros(len(book)) if before is None else np.sqrt(((book - before) ** 2).sum(1).astype(np.float64)) * (1 + ROOM)
        self.half = np.sqrt(distances(book, book).astype(np.float64)) / 2 * (1 - ROOM)
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, squared distances to them, and distances to all entries as lower bounds."""
        d = distances(x, self.book)
        code = d.argmin(1)  # the first of equal ones
        return code, d[np.arange(len(x)), code], np.sqrt(d.astype(np.float64)) * (1 - ROOM)

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, exactly: bool = False) -> tuple[np.ndarray, ...]:
        """Entries, upper bounds and lower bounds from those of the round before, and how many distances to rivals were
        computed. If exactly, upper bounds are squared distances."""
        code, upper, lower = code.copy(), (upper + self.moved[code]) * (1 + ROOM), np.maximum(lower - self.moved[None, :], 0) * (1 - ROOM)
        own = np.arange(len(x)) if exactly else np.flatnonzero(upper >= self.nearest[code])  # below it, no other entry can be as near
        exact = ((x[own] - self.book[code[own]]) ** 2).sum(1)
        upper[own] = np.sqrt(exact.astype(np.float64)) * (1 + ROOM)
        lower[own, code[own]] = np.sqrt(exact.astype(np.float64)) * (1 - ROOM)
        rival = (lower[own] <= upper[own, None]) & (self.half[code[own]] <= upper[own, None])
        rival[np.arange(len(own)), code[own]] = False
        at, j = np.nonzero(rival)
        d = ((x[own[at]] - self.book[j]) ** 2).sum(1)
        lower[own[at], j] = np.sqrt(d.astype(np.float64)) * (1 - ROOM)
        order = np.lexsort((j, d, at))
        at, j, d = at[order], j[order], d[order]
        lead = np.flatnonzero(np.diff(at, prepend=-1) > 0)
        at, j, d = at[lead], j[lead], d[lead]
        better = (d < exact[at]) | ((d == exact[at]) & (j < code[own[at]]))
        at, j, d = at[better], j[better], d[better]
        code[own[at]], exact[at] = j, d
        upper[own[at]] = np.sqrt(d.astype(np.float64)) * (1 + ROOM)
        return code, exact if exactly else upper, lower, int(rival.sum())


def _pack(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes, rounded down, and the scale of each row."""
    scale = np.nextafter((lower.max(1, initial=0) / 255).astype(np.float32), np.float32(np.inf))
    return np.minimum(lower / scale[:, None].astype(np.float64) * (1 - ROOM), 255).astype(np.uint8), scale


def _matrix(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    """The rows of a binary column as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


STATE = "x binary, code binary, upper binary, lower binary, scale binary"


def _first(vectors: DataFrame, dims: int, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, x, code, upper, lower, scale) of vectors (vec_id, label, whole)."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(b) for b in books]
        for batch in _blocks(batches):
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            x = np.zeros((batch.num_rows, dims), "<i4")
            x[np.arange(dims)[None, :] < sizes[:, None]] = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            yield _state(batch.columns[:2], x, [(*p.first(x[:, k].astype(np.int64)),) for p, k in zip(parts, _slices(dims), strict=True)])

    return shared.map_batches(vectors, run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, {STATE}")


def _next(state: DataFrame, dims: int, books: list[np.ndarray], before: list[np.ndarray]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(b, old) for b, old in zip(books, before, strict=True)]
        for batch in _blocks(batches):
            x, code, upper, lower = _read(batch, dims)
            yield _state(batch.columns[:2], x, [p.again(x[:, k].astype(np.int64), code[:, i], upper[:, i], lower[i])[:3] for i, (p, k) in enumerate(zip(parts, _slices(dims), strict=True))])

    return shared.map_batches(state, run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, {STATE}")


def _last(state: DataFrame, dims: int, books: list[np.ndarray], before: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) by the final codebooks."""
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(b, old) for b, old in zip(books, before, strict=True)]
        for batch in _blocks(batches):
            x, code, upper, lower = _read(batch, dims)
            found = [p.again(x[:, k].astype(np.int64), code[:, i], upper[:, i], lower[i], True)[:2] for i, (p, k) in enumerate(zip(parts, _slices(dims), strict=True))]
            codes = pa.array([bytes(r).hex() for r in np.stack([c for c, _ in found], 1).astype("u1")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], codes, pa.array(sum(e for _, e in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return shared.map_batches(state, run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def _sums(state: DataFrame, dims: int, entries: int) -> DataFrame:
    """(part, entry, n, sums) of the parts that are assigned to each entry."""
    width = dims // PARTS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            x, code = _matrix(batch.column(0), "<i4", dims).astype(np.int64), _matrix(batch.column(1), "u1", PARTS)
            for p, k in enumerate(_slices(dims)):
                order = np.argsort(code[:, p], kind="stable")
                entry, at = np.unique(code[order, p], return_index=True)
                if len(at):
                    sums[p, entry] += np.add.reduceat(x[order][:, k], at)
                    n[p, entry] += np.diff(np.append(at, len(order)))
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    own = shared.map_batches(state.select("x", "code"), run, "part int, entry int, n bigint, sums array<bigint>")
    total = F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)])
    return own.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("sums"))


def _slices(dims: int) -> list[slice]:
    width = dims // PARTS
    return [slice(p * width, (p + 1) * width) for p in range(PARTS)]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _read(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    x, code = _matrix(batch.column(2), "<i4", dims), _matrix(batch.column(3), "u1", PARTS).astype(np.int64)
    upper, lower, scale = _matrix(batch.column(4), "<f8", PARTS), _matrix(batch.column(5), "u1", PARTS, -1), _matrix(batch.column(6), "<f4", PARTS)
    return x, code, upper, [lower[:, p] * scale[:, p, None].astype(np.float64) * (1 - ROOM) for p in range(PARTS)]


def _state(keys: list[pa.Array], x: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
    codes, uppers, packed = np.stack([c for c, _, _ in found], 1), np.stack([u for _, u, _ in found], 1), [_pack(low) for _, _, low in found]
    lowers, scales = np.stack([b for b, _ in packed], 1), np.stack([s for _, s in packed], 1)
    return pa.RecordBatch.from_arrays(
        [*keys, _binary(x), _binary(codes.astype("u1")), _binary(uppers.astype("<f8")), _binary(lowers), _binary(scales.astype("<f4"))],
        names=["vec_id", "label", "x", "code", "upper", "lower", "scale"],
    )


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, whole) of the vectors that hold only finite numbers, and the length that all are filled up to."""
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(finite, F.lit(False)))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = max(1, -(-longest // PARTS)) * PARTS
    most = limit(dims // PARTS)
    bounded = lambda x: F.greatest(F.least(x * scale, F.lit(float(most))), F.lit(float(-most)))
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(bounded(x)).cast("int")).alias("whole")), dims


def quantise(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of vectors (vec_id, embedding, label), and the codebooks of the parts."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    whole, dims = whole_numbers(vectors)
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()  # bounded by entries
    seeds = np.zeros((len(first), dims), np.int64)
    for row, r in zip(seeds, first, strict=True):
        row[: len(r["whole"])] = r["whole"]
    books = [seeds[:, k] for k in _slices(dims)]
    if not first:
        return whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    before, state = books, shared.stash(_first(whole, dims, books), "codes")
    for n in range(rounds):
        if n:
            old, state = state, shared.stash(_next(state, dims, books, before), "codes")
            shared.discard(old)
        before, books = books, [b.copy() for b in books]
        for r in _sums(state, dims, len(first)).collect():  # at most a row for each entry
            books[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return _last(state, dims, books, before), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantise(shared.read_table(spark, sf_dir, "embeddings"))
    coded = shared.stash(coded, "codes")
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    # of the labels' sums, combined on the map side; Spark broadcasts them if they turn out small
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB: parts in long form, every distance, four rounds."""
    far = lambda n: (
        f"d{n} AS (SELECT x.v, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{n} b ON x.p = b.p AND x.i = b.i GROUP BY x.v, x.p, b.e),\n"
        f"a{n} AS (SELECT v, p, min({{'d': d, 'e': e}}) AS m FROM d{n} GROUP BY v, p)"
    )
    steps = [far(0)]
    for n in range(1, ROUNDS + 1):
        steps.append(
            f"m{n} AS (SELECT x.p, a.m.e AS e, x.i, CAST((sum(x.c) - (sum(x.c) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS c FROM x JOIN a{n - 1} a ON x.v = a.v AND x.p = a.p GROUP BY x.p, a.m.e, x.i),\n"
            f"b{n} AS (SELECT o.p, o.e, o.i, coalesce(m.c, o.c) AS c FROM b{n - 1} o LEFT JOIN m{n} m ON o.p = m.p AND o.e = m.e AND o.i = m.i),\n" + far(n)
        )
    body = ",\n".join(steps)
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS v, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
l AS (SELECT v, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS c, generate_subscripts(embedding, 1) - 1 AS j, len(embedding) // {PARTS} AS w FROM k),
x AS (SELECT v, j // w AS p, j % w AS i, c FROM l),
b0 AS (SELECT p, v AS e, i, c FROM x WHERE v < {ENTRIES}),
{body},
r AS (SELECT v, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY v),
t AS (SELECT k.vec_id, k.label, r.code, r.error FROM k JOIN r ON k.v = r.v),
s AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM t GROUP BY label),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT t.vec_id, t.code, t.error, s.label_error, h.codebooks_sha256 FROM t JOIN s ON t.label IS NOT DISTINCT FROM s.label, h
"""


OP13_SQL = _sql()
