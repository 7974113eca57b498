"""Helpers that several operators of this package use: the shared folder, written intermediate tables, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank and the control characters from tab to carriage return.
WS_CHARS = " \t\n\x0b\f\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local master may do without: a temporary folder is then made and set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="codestrata-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and computes it once.

    A lost executor loses nothing of it, unlike cached or locally checkpointed blocks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    for kept in _watched.get():
        kept.append(out)
    return out


#: Of each thread its own: pipelines may run side by side.
_watched: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("watched", default=())


@contextlib.contextmanager
def watched():
    """The list of the stash() tables that are written inside, to be discarded when nothing reads them any more."""
    made: list[DataFrame] = []
    before = _watched.set((*_watched.get(), made))
    try:
        yield made
    finally:
        _watched.reset(before)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stash() tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stashed_at", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders, those that are gone already aside."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of rows that go to a Python worker at a time, unless the session sets a limit of its own.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by bytes, as texts differ in length, and with the memory that a
    task has freed given back to the system when it ends: workers idle between stages."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    if not conf.contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def trimmed(batches):
        yield from run(batches)
        _give_back()

    return df.mapInArrow(trimmed, schema)


def _give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(text: Column) -> Column:
    """The maximal runs of characters that are not white space; an empty array for a null or blank text."""
    trimmed = F.trim(text, F.lit(WS_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WS_CLASS + "+")
    )


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that start with stems and that df, however it names its columns, does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in taken:
            name, n = f"{stem}_{n}", n + 1
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of this very name, with dots or blanks in it too."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a higher-order function binds it to a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_chars(text: Column, chars: str) -> Column:
    """text without any of the given ASCII characters (plain byte searches, no regular expression)."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_chars(text: Column, chars: str) -> Column:
    """How many of the given ASCII characters text holds, as a long; 0 for null."""
    return F.coalesce(F.octet_length(text) - F.octet_length(without_chars(text, chars)), F.lit(0)).cast("long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: rows (node, component), component the smallest node reachable.

    edges has two comparable columns a and b; loops and repeated rows do no harm, null ends are dropped.
    Large-star and small-star rounds: each is two aggregations by minimum (combined before the shuffle) and
    two joins whose hot keys adaptive execution can split, so no node's neighbours are ever gathered in one
    place. Each round is written to the shared folder. Nodes without an edge do not appear.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stash(edges, "cc")
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node moves to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "cc")
        # small star: a node's smaller neighbours, and the node, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        small = stash(small, "cc")
        # settled when no node has two parents and no parent has a parent of its own
        many = small.groupBy("u").count().where("count > 1").limit(1)
        chained = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").select("v").limit(1)
        settled = not many.union(chained.select(F.col("v").alias("u"), F.lit(1).alias("count"))).take(1)
        discard(edges, large)
        edges = small
        if settled:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    root = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)


def in_cells(rows: DataFrame, keys: list[str], salt: Column, most: int) -> DataFrame:
    """rows with cell_i, cell_j and chunk, so that every two rows of a group meet in exactly one cell of bounded size.

    A group of n rows gets c = ceil(n / most) chunks by the hash salt, and cells (i, j), i <= j. A row of chunk k goes
    to the c cells that have k. Groups of one row are dropped. Groups of at most `most` rows have the one cell (0, 0)
    and are not copied. The table of the larger groups is written first, so that Spark broadcasts it only if it is
    small.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = stash(sizes.withColumn("_c", F.ceil(F.col("_n") / most).cast("int")), "cells")
    dealt = rows.join(sizes, keys).withColumn("chunk", F.pmod(salt, F.col("_c")).cast("int"))
    cell = lambda x: F.struct(F.least("chunk", x).alias("i"), F.greatest("chunk", x).alias("j"))
    dealt = dealt.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("_c") - 1), cell)))
    return dealt.select(*rows.columns, "chunk", F.col("_cell.i").alias("cell_i"), F.col("_cell.j").alias("cell_j"))


def least_reachable(linked) -> list[int]:
    """For a symmetric boolean matrix, the least index that each index reaches (itself included)."""
    import numpy as np

    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least
