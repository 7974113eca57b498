"""Packing documents into fixed windows of tokens: concatenate and cut.

Two passes. The first tokenises every partition once and writes the ids with a running start inside the partition;
the partitions' token totals give each its global offset by a prefix sum. The second cuts the global stream at
multiples of the window: a document's pieces follow from its global start alone, and a piece that a window's edge
makes is a boundary record. Nothing is sorted and no text is shuffled; the only gathered rows are one total per
partition. Every sequence but the last is full, so padding is at most one window in the whole corpus.

Cases: a null or empty text has one id, the end id; a text of any length is tokenised whole, by seams where the
tokenizer splits anyway, and cut into as many pieces as it needs; repeated rows are packed each; other columns,
whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.plans.adapters import texts

from . import shared

SEQUENCE, END_ID = 1024, 0
#: Characters of text that are tokenised at a time; longer texts are cut where the tokenizer itself splits.
CHUNK = 1 << 16

#: Where tiktoken and tokenizers split alike beyond doubt: printable ASCII, line ends and Latin letters.
_PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ſ]*")
#: A blank between a character that is no white space and a letter always begins a token of its own.
_SEAM = re.compile(r"(?<=[^\s]) (?=[A-Za-z])")


@functools.lru_cache(1)
def _exact(vocabulary: str):
    from tokenizers import Tokenizer

    import public_tokenizers

    out = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    out.encode_special_tokens = True
    return out


@functools.lru_cache(1)
def _fast(ranks: str):
    import tiktoken

    import public_tokenizers

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def pieces_of(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """text in pieces of about chunk characters whose ids, joined, are those of text (whole where no seam is found)."""
    start = 0
    while len(text) - start > chunk:
        seam = _SEAM.search(text, start + chunk)
        if not seam:
            break
        yield text[start : seam.start()]
        start = seam.start()
    yield text[start:]


def encode(text: str, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """The ids that tokenizers gives text with this vocabulary, specials in the text being ordinary text.

    Plain Latin text takes tiktoken with the same vocabulary, four times as fast; all else tokenizers itself.
    """
    ids: list[int] = []
    for part in pieces_of(text):
        if _PLAIN.fullmatch(part):
            ids += _fast(ranks).encode_ordinary(part)
        else:
            ids += _exact(vocabulary).encode(part, add_special_tokens=False).ids
    return np.asarray(ids, dtype="<u4")


def tokenise(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, part, at, n, ids): ids are little-endian, 16 bits each if all fit, else 32; n counts them with the
    end id; at is the count before the document in its partition. Null texts are empty: their one id is the end id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            texts, rows, size = batch.column(2), [], 0
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py() or "", vocabulary, ranks)
                ids = np.append(ids, np.uint32(END_ID))
                wide = bool(ids.max() > 0xFFFF)
                rows.append((i, at, len(ids), wide, ids.astype("<u4" if wide else "<u2").tobytes()))
                at += len(ids)
                size += 4 * len(ids)
                if size > 1 << 24 or i == batch.num_rows - 1:
                    where, starts, counts, wides, blobs = zip(*rows)
                    took = pa.array(where)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(took),
                            batch.column(1).take(took),
                            pa.array(starts, pa.int64()),
                            pa.array(counts, pa.int64()),
                            pa.array(wides, pa.bool_()),
                            pa.array(blobs, pa.binary()),
                        ],
                        names=["doc_id", "part", "at", "n", "wide", "ids"],
                    )
                    rows, size = [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.spark_partition_id().alias("part"), F.col("text").cast("string").alias("text"))
    return shared.map_batches(source, run, f"doc_id {kind}, part int, at bigint, n bigint, wide boolean, ids binary")


def pack(docs: DataFrame, sequence: int = SEQUENCE, with_ids: bool = False, **vocabulary) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, last (and ids, if asked).

    Every document appears whole, in one piece or more. sequence_id * sequence + offset is a piece's place in the corpus.
    """
    ids = shared.stash(tokenise(docs, **vocabulary), "packing")
    # one row for each partition that was tokenised, however many documents there are
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    placed = ids.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("at"), "n", "wide", "ids"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            at, n, wide = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column(4)[i].as_buffer(), "<u4" if wide[i] else "<u2").astype("<u4")
                start = 0
                while start < n[i]:
                    number, offset = divmod(at[i] + start, sequence)
                    length = min(sequence - offset, n[i] - start)
                    own = tokens[start : start + length].tobytes()
                    out.append((i, start, length, zlib.crc32(own), n[i], number, offset, own if with_ids else None))
                    start += length
                size += len(tokens) * 4 if with_ids else 64
                if out and (size > 1 << 24 or i == batch.num_rows - 1):
                    rows = list(zip(*out))
                    arrays = [batch.column(0).take(pa.array(rows[0]))]
                    arrays += [pa.array(r, pa.int64()) for r in rows[1:7]]
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                    if with_ids:
                        arrays, names = [*arrays, pa.array(rows[7], pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    out, size = [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return shared.map_batches(placed, run, schema + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, sequence: int = SEQUENCE, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, used) of pieces with ids: each row holds sequence ids; a row that is not full, the last, is
    padded to the next power of two."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    joined = pieces.groupBy("sequence_id").agg(
        F.unhex(F.array_join(parts, "")).alias("raw"), F.sum("length").alias("used")
    )
    size = F.when(F.col("used") == sequence, sequence).otherwise(F.pow(2.0, F.ceil(F.log2("used")))).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), size - F.col("used").cast("int")))
    return joined.select("sequence_id", F.concat("raw", pad).alias("ids"), "used")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(texts(spark, sf_dir, "doc_id", "text"))
