"""Summaries of tool output: what many lines say in few. Input: lines (source, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_by_folder(lines: DataFrame, folders: int = 20, samples: int = 3) -> DataFrame:
    """(folder, files, sample) of a list of paths, the fullest folders first."""
    rows = lines.where(F.trim("line") != "").select(F.regexp_extract("line", "^(.*)/[^/]*$", 1).alias("folder"), "line")
    counted = rows.groupBy("folder").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(folders)
    # the limit of a window is applied before the shuffle too, so no folder's paths are gathered
    first = F.row_number().over(Window.partitionBy("folder").orderBy("line"))
    some = rows.withColumn("n", first).where(F.col("n") <= samples).groupBy("folder").agg(F.array_sort(F.collect_list("line")).alias("sample"))
    return counted.join(some, "folder").select("folder", "files", "sample").orderBy(F.desc("files"), "folder")


def grep_by_file(lines: DataFrame, most: int = 15) -> DataFrame:
    """(file, matches) of file:line:text."""
    rows = lines.select(F.regexp_extract("line", "^([^:]+):", 1).alias("file")).where("file <> ''")
    return rows.groupBy("file").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "file").limit(most)


def status_counts(lines: DataFrame) -> DataFrame:
    """(code, files) of a short status."""
    rows = lines.select(F.trim(F.substring("line", 1, 2)).alias("code")).where("code <> ''")
    return rows.groupBy("code").agg(F.count("*").alias("files"))


def diff_by_file(lines: DataFrame) -> DataFrame:
    """(file, added, removed) of a unified diff; the file of a line is that of the last header before it."""
    order = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.nullif(F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1), F.lit(""))
    rows = lines.withColumn("file", F.last(name, ignorenulls=True).over(order)).where("file is not null")
    added, removed = F.col("line").rlike(r"^\+(?!\+\+ )"), F.col("line").rlike(r"^-(?!-- )")
    return rows.groupBy("file").agg(F.count_if(added).alias("added"), F.count_if(removed).alias("removed"))


def log_head(lines: DataFrame, most: int = 15) -> DataFrame:
    """The first commits and how many more there are."""
    total = lines.agg(F.count("*").alias("n"))
    return lines.orderBy("line_no").limit(most).crossJoin(F.broadcast(total)).select("line", F.greatest(F.col("n") - most, F.lit(0)).alias("earlier"))


def test_kind(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.contains("fail") | low.contains("panic") | low.contains("error["), "failure").when(low.contains("error:"), "error")


def test_output(lines: DataFrame, most: int = 20) -> DataFrame:
    """(kind, line): the first failures and errors of a test run, and its last summary."""
    found = lines.withColumn("kind", test_kind(F.col("line"))).where("kind is not null")
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("line_no"))).where(F.col("n") <= most)
    last = lines.where(F.col("line").rlike(r"(?i)test result|\b\d+ (passed|failed)")).agg(F.max_by("line", "line_no").alias("line")).where("line is not null")
    return first.select("kind", "line").unionByName(last.select(F.lit("summary").alias("kind"), "line"))


def savings(raw_bytes: Column, compressed_bytes: Column) -> Column:
    return F.when(raw_bytes > 0, (1 - compressed_bytes / raw_bytes) * 100).otherwise(0.0)


def branches(lines: DataFrame) -> DataFrame:
    """(name, current) of a list of branches."""
    rows = lines.where(F.trim("line") != "")
    return rows.select(F.regexp_replace(F.trim("line"), r"^\*\s+", "").alias("name"), F.col("line").startswith("*").alias("current"))


def diff_stat(lines: DataFrame) -> DataFrame:
    """(file, changes) of a diff stat; its last line gives no row."""
    rows = lines.select(F.regexp_extract("line", r"^\s*(\S.*?)\s+\|\s+([0-9]+)", 1).alias("file"), F.regexp_extract("line", r"\|\s+([0-9]+)", 1).alias("n"))
    return rows.where("file <> ''").select("file", F.col("n").cast("long").alias("changes"))


def packages(output: Column) -> Column:
    """An array of (name, version) of package metadata in JSON."""
    kind = "struct<packages:array<struct<name:string,version:string>>>"
    return F.from_json(output, kind)["packages"]


def listing(lines: DataFrame) -> DataFrame:
    """(folders, files) of a long listing."""
    rows = lines.where(F.col("line").rlike("^[d-][rwxst-]{9}"))
    return rows.agg(F.count_if(F.col("line").startswith("d")).alias("folders"), F.count_if(F.col("line").startswith("-")).alias("files"))


def listing_head(lines: DataFrame, most: int = 15, short: int = 20) -> DataFrame:
    """(line_no, line, folders, files, more) of a long listing (line_no, line): its first entries, how many folders and
    files it has, and how many entries are left out; a listing of at most `short` entries is given whole."""
    rows = lines.where("line <> ''")
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("line").startswith("d")).alias("folders"), F.count_if(F.col("line").startswith("-")).alias("files"))
    head = rows.orderBy("line_no").limit(short).crossJoin(F.broadcast(total))  # one row of totals
    shown = head.withColumn("place", F.row_number().over(Window.orderBy("line_no"))).where((F.col("n") <= short) | (F.col("place") <= most))
    return shown.select("line_no", "line", "folders", "files", F.when(F.col("n") <= short, 0).otherwise(F.col("n") - most).alias("more"))
