"""From raw documents to packed sequences: the operators of codestrata.llm as stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as the next one's docs. What
a stage keeps for itself in the shared folder is deleted when the next one begins, unless that one's docs still read it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import minhash_dedup, mixing, packing, quality_rules, secret_scan, shared

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The folders of what stages have written besides their rows, until nothing reads them: of each run and thread its own.
_left: ContextVar[list[str] | None] = ContextVar("left", default=None)


def _stage(function: Stage) -> Stage:
    """function, which first deletes what stages before it wrote and docs doesn't read: their rows are written by then.

    Stages may be chained without being written: what docs reads is kept. Whoever interleaves stages of several chains in
    one thread writes a stage's rows before the next one of another chain begins. The last stage's tables stay, as its
    rows are read from them."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.get()
        if left is None:
            _left.set(left := [])
        if left:
            read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
            done = [p for p in left if p.rsplit("/", 1)[-1] not in read]
            shared.delete(spark, *done)
            left[:] = [p for p in left if p not in done]
        with shared.watched() as made:
            out = function(spark, docs, sf_dir)
        left.extend(x.stashed_at for x in made if function.__name__ != "pack")
        return out

    return run


def _whole(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column that holds all of a row, and its name."""
    (row,) = shared.fresh(docs, "_row")
    return docs.withColumn(row, F.struct(*map(shared.column, docs.columns))), row


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by its own verdict whatever its doc_id.

    Null and empty texts fail the base rules; equal rows share their verdict; a text of any length is judged whole; an
    empty table stays empty. All columns of docs are returned, whatever their names.
    """
    rows, row = _whole(docs)
    measured = shared.stash(quality_rules.metrics(rows, keep=(row,)), "quality")
    judged = quality_rules.judge(measured, quality_rules.thresholds(measured, shared.read_table(spark, sf_dir, "labels")))
    return judged.where("kept").select(f"{row}.*")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id; rows that share it all stay.

    Rows with a null doc_id stay. Null and empty texts are one group; a text without a word or with few, equal to no
    other, is a group of its own; a text of any length is compared whole; an empty table stays empty. All columns of
    docs are returned, whatever their names.
    """
    (gone_id,) = shared.fresh(docs, "_gone")
    gone = minhash_dedup.find_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, the secrets in their texts replaced by a mark (n_chars follows).

    Null, empty and secret-free texts stay as they are; a text of any length is scanned whole; equal rows are redacted
    alike; an empty table stays empty. All columns of docs are returned, whatever their names.
    """
    return secret_scan.redact(docs, secret_scan.default_forest(spark))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it, whatever its doc_id.

    Null names are a source of their own; null, empty and blank texts have no tokens and are taken as often as their
    leaf has whole epochs, or once more; equal rows are taken equally often; an empty table stays empty. All columns of
    docs are returned, whatever their names.
    """
    rows, row = _whole(docs)
    taken = mixing.mix(rows, keep=(row,)).where("copies > 0")
    return taken.select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(f"{row}.*")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids.

    Null and empty texts have the one piece of their end id; a text of any length is cut into as many pieces as it
    needs; equal rows are packed each; an empty table has no pieces. Other columns are not looked at.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages hash shingles, train trees and tokenise, which SQL does not express: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. A stage's docs are deleted when the next one's are written; what the result reads
    stays in the shared folder."""
    own = _left.set([])
    try:
        docs = shared.read_table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            out = shared.stash(stage(spark, docs, sf_dir), name)
            shared.discard(docs)
            docs = out
        out = STAGES[-1][1](spark, docs, sf_dir)
        shared.discard(docs)
        return out
    finally:
        _left.reset(own)
