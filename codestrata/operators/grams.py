"""Search in source text by an index of three-character groups (grams).

write() puts lines in order of path and line number, numbers them, and writes them in row groups of a few thousand
lines, so that a block of lines can be read alone. The index has, for each gram and block, the sorted places of the
lines that hold the gram, in lower case; no posting list outgrows a block, however frequent a gram is. A search takes
the rarest few grams of each word, intersects their places block by block, and reads and tests only the lines left, so
its rows are those of a full scan. first() reads blocks in order, in growing rounds, until enough hits are found.

Cases: words shorter than a gram are looked for in all lines; an empty word is found nowhere; null and empty lines hold
nothing; a word that is asked for twice is looked for once; null paths come before all others.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths, symbols
from codestrata.functions.text import standing
from codestrata.operators.search import checked

#: Characters of a gram, lines of a block (a power of two, as a shift; places in it are 16-bit numbers), grams of a word that are looked up.
GRAM, SHIFT, RAREST = 3, 12, 4
#: Blocks or grams that a scan is told to read by a filter; of more, those to read are found by a join.
NAMED = 128
#: Bounds of a search of the workspace: hits and files.
MOST_HITS, MOST_FILES = 200, 20_000
#: Row groups and pages of few rows: a lookup reads those whose bounds fit.
_FINE = {"parquet.block.row.count.limit": 1 << SHIFT, "parquet.page.row.count.limit": 256, "parquet.block.size": 1 << 22}


def grams(text: Column) -> Column:
    """The distinct grams of a word in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def write(lines: DataFrame, place: str) -> None:
    """Write the lines (path, line_no, line) and their index below place."""
    spark = lines.sparkSession
    ordered = lines.select("path", "line_no", "line").repartitionByRange("path", "line_no").sortWithinPartitions("path", "line_no")
    numbered = ordered.withColumn("at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("block", F.shiftright("at", SHIFT)).withColumn("at", F.col("at").bitwiseAND((1 << SHIFT) - 1).cast("int"))
    numbered.write.options(**_FINE).parquet(f"{place}/lines")
    written = spark.read.parquet(f"{place}/lines")  # numbers are those written, whatever a lost task would give
    lists = _lists(written).groupBy("gram", "block").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    lists.sortWithinPartitions("gram", "block").write.options(**_FINE).parquet(f"{place}/grams")  # bounds are those of sorted row groups
    counts = spark.read.parquet(f"{place}/grams").groupBy("gram").agg(F.sum(F.size("places")).alias("lines"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.options(**_FINE).parquet(f"{place}/counts")


def _lists(lines: DataFrame) -> DataFrame:
    """(gram, block, places) of lines (block, at, line), a row for each batch: grams are numbers of three code points,
    told apart from those of other lines by sorting."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
            if len(chars) < GRAM:
                continue
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            whole = row[2:] == row[:-2]
            which, row, known = _by_gram(chars, row[2:][whole], whole, len(texts))
            block, at = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            starts = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            names = np.array([chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in known.tolist()], object)
            ends = pa.array(np.append(starts, len(which)), pa.int32())
            places = pa.ListArray.from_arrays(ends, pa.array(at, pa.int16()))
            yield pa.RecordBatch.from_arrays([pa.array(names[which[starts]], pa.string()), pa.array(block[starts], pa.int64()), places], names=["gram", "block", "places"])

    source = lines.select("block", "at", F.lower("line").alias("line")).where(F.length("line") >= GRAM)
    return source.mapInArrow(run, "gram string, block bigint, places array<smallint>")


def _by_gram(chars: np.ndarray, row: np.ndarray, whole: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, line) of each gram of a line once, by gram and line, and what the grams' numbers stand for."""
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    a = len(alphabet)
    if a**3 * n < 1 << 62:  # a gram and its line are one number, so that one sort tells them apart
        code = np.zeros(0x110000, np.int64)
        code[alphabet] = np.arange(a)
        c = code[chars]
        pairs = (((c[:-2] * a + c[1:-1]) * a + c[2:])[whole]) * n + row
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        gram, row = np.divmod(pairs, n)
        new = np.diff(gram, prepend=-1) != 0
        own = gram[new]
        return np.cumsum(new) - 1, row, alphabet[own // (a * a)] << 42 | alphabet[own // a % a] << 21 | alphabet[own % a]
    known, which = np.unique((chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[whole], return_inverse=True)
    which, row = np.divmod(np.unique(which * n + row), n)
    return which, row, known


def candidates(spark: SparkSession, place: str, words: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(word, block, at) of the lines that hold the rarest grams of a word; words of fewer characters than a gram lack."""
    asked = words.select("word").where(F.length("word") >= GRAM).distinct()
    own = asked.select("word", F.explode(grams(F.col("word"))).alias("gram"))
    counted = own.join(_named(spark.read.parquet(f"{place}/counts"), "gram", own), "gram", "left").fillna(0, ["lines"])
    chosen = counted.groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("lines", "gram"))), 1, rarest).alias("g"))  # of one word's grams
    needed = chosen.select("word", F.size("g").alias("needed"), F.explode("g.gram").alias("gram"))
    index = _named(spark.read.parquet(f"{place}/grams"), "gram", needed)
    found = index.join(checked(needed), "gram").groupBy("word", "block", "needed").agg(F.collect_list("places").alias("lists"))
    # a block is a candidate if it has all of them; each list has at most the lines of a block
    both = F.aggregate(F.slice("lists", 2, rarest), F.element_at("lists", 1), lambda s, x: F.array_intersect(s, x))
    met = found.where(F.size("lists") == F.col("needed")).select("word", "block", F.explode(both).alias("at")).withColumn("at", F.col("at").cast("int"))
    aside = f"{place}/found-{uuid.uuid4().hex}"  # looked up once, used for bounds and for the join
    met.write.parquet(aside)
    return spark.read.schema(met.schema).parquet(aside)


def _lines(spark: SparkSession, place: str, found: DataFrame) -> DataFrame:
    """The lines, restricted to about those of found (block, at) where these are in few blocks."""
    lines = spark.read.parquet(f"{place}/lines")
    spans = found.groupBy("block").agg(F.min("at").alias("low"), F.max("at").alias("high")).limit(NAMED + 1).collect()
    if len(spans) > NAMED:
        return lines
    inside = [(F.col("block") == s["block"]) & (F.col("at") >= s["low"]) & (F.col("at") <= s["high"]) for s in spans]
    return lines.where(reduce(operator.or_, inside, F.lit(False)))


def _named(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """table, restricted to the values of wanted where these are few; the join that follows does so in any case."""
    some = [r[0] for r in wanted.select(column).distinct().limit(NAMED + 1).collect()]
    return table.where(_is_one_of(column, some)) if len(some) <= NAMED else table


def _is_one_of(column: str, values: list) -> Column:
    """Single comparisons: they reach the statistics of row groups, of a long list of values only its bounds do."""
    return reduce(operator.or_, [F.col(column) == v for v in values], F.lit(False))


def find(spark: SparkSession, place: str, words: DataFrame) -> DataFrame:
    """(word, path, line_no, col) of every place where a word of words (word) stands by itself; col counts from 1."""
    found = candidates(spark, place, words)
    met = _lines(spark, place, found).join(found, ["block", "at"])
    short = checked(words.select("word").where((F.length("word") < GRAM) & (F.col("word") != "")).distinct())
    every = spark.read.parquet(f"{place}/lines").join(short, F.col("line").contains(F.col("word")))
    columns = ["word", "path", "line_no", "line"]
    both = met.select(*columns).unionByName(every.select(*columns))
    return both.select("word", "path", "line_no", F.explode(standing("line", "word")).alias("col"))


def find_with_scan(lines: DataFrame, words: DataFrame) -> DataFrame:
    """What find() gives, by a test of every line: for texts that have no index."""
    asked = checked(words.select("word").where("word <> ''").distinct())
    return lines.join(asked, F.col("line").contains(F.col("word"))).select("word", "path", "line_no", F.explode(standing("line", "word")).alias("col"))


def first(spark: SparkSession, place: str, word: str, verify: Callable[[DataFrame], DataFrame], most: int = MOST_HITS, most_files: int = MOST_FILES) -> DataFrame:
    """The first `most` rows of verify(lines that may hold word), by path and line, in the first `most_files` files.

    Candidate blocks are read in order, 1, 2, 4 ... at a time, until the hits suffice. verify must keep path and
    line_no and work line by line."""
    asked = spark.range(1).select(F.lit(word).alias("word"))
    last = spark.read.parquet(f"{place}/lines").select("path").distinct().orderBy("path").limit(most_files).agg(F.max("path")).first()[0]
    inside = (F.col("path") <= F.lit(last)) | F.col("path").isNull()
    if len(word) < GRAM:
        return verify(spark.read.parquet(f"{place}/lines").where(inside)).orderBy("path", "line_no").limit(most)
    found = candidates(spark, place, asked).select("block", "at")
    blocks, step, seen = [], 1, -1
    while True:
        new = [r[0] for r in found.where(F.col("block") > seen).select("block").distinct().orderBy("block").limit(step).collect()]
        blocks += new
        met = found.where(_is_one_of("block", blocks))
        hits = verify(_lines(spark, place, met).join(met, ["block", "at"], "left_semi").where(inside))
        if len(new) < step or hits.limit(most).count() >= most:
            return hits.orderBy("path", "line_no").limit(most)
        step, seen = min(2 * step, NAMED), new[-1]


def workspace_symbols(spark: SparkSession, place: str, query: str, most: int = MOST_HITS, most_files: int = MOST_FILES) -> DataFrame:
    """(path, line_no, kind, name): the first symbols whose name holds query, whatever its case."""
    return first(spark, place, query.lower(), lambda lines: symbols.workspace_symbols(lines, query), most, most_files)


def references(spark: SparkSession, place: str, word: str, most: int = MOST_HITS, most_files: int = MOST_FILES) -> DataFrame:
    """(path, line_no, col): the first places where word stands by itself, in files that searches look at."""

    def verify(lines: DataFrame) -> DataFrame:
        shown = lines.where(~paths.skipped_by_search(F.col("path").cast("string")) & F.col("line").contains(word))
        return shown.select("path", "line_no", F.explode(standing("line", F.lit(word))).alias("col"))

    return first(spark, place, word, verify, most, most_files)
