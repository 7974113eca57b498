"""Coverage and flaky tests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions import text as T


def percent(covered, total):
    return F.when(total > 0, covered / total * 100).otherwise(0.0)


def file_coverage(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., path, lines_total, lines_covered, percent) of line coverage (path, line, hits)."""
    counted = lines.groupBy(*by, "path").agg(F.count("*").alias("lines_total"), F.count_if(F.col("hits") > 0).alias("lines_covered"))
    return counted.withColumn("percent", percent(F.col("lines_covered"), F.col("lines_total")))


def overall(files: DataFrame) -> DataFrame:
    sums = files.agg(F.coalesce(F.sum("lines_total"), F.lit(0)).alias("lines_total"), F.coalesce(F.sum("lines_covered"), F.lit(0)).alias("lines_covered"))
    return sums.withColumn("percent", percent(F.col("lines_covered"), F.col("lines_total")))


def best_report(files: DataFrame) -> DataFrame:
    """Of a path in several reports the one with the highest percentage; the first report of equals."""
    return files.groupBy("path").agg(
        F.min_by(F.struct("report", "lines_total", "lines_covered", "percent"), F.struct(-F.col("percent"), "report")).alias("x")
    ).select("path", "x.*")


def ranges(lines: DataFrame) -> DataFrame:
    """(path, start, end): runs of consecutive numbers in (path, line), repeats aside."""
    order = Window.partitionBy("path").orderBy("line")
    islands = lines.select("path", "line").distinct().withColumn("island", F.col("line") - F.row_number().over(order))
    return islands.groupBy("path", "island").agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("island")


def flaky(commits: DataFrame, commit_files: DataFrame, least: float = 0.2) -> DataFrame:
    """(file, total, isolated, suspicious, reverts, score, signals) of test files whose history looks flaky.

    commits: (sha, subject); commit_files: (sha, file), and test where files are no paths. isolated: commits that touch
    nothing but tests. All files are shuffled as marks of their commits, only tests by name.
    """
    files = commit_files if "test" in commit_files.columns else commit_files.withColumn("test", paths.is_test(F.col("file")))
    only_tests = files.groupBy("sha").agg(F.bool_and("test").alias("only_tests"), F.bool_or("test").alias("any")).where("any")
    subject = F.lower("subject")
    flags = commits.select(
        "sha",
        subject.rlike("|".join(map(re.escape, T.FLAKY_WORDS))).alias("suspicious"),
        subject.rlike("|".join(map(re.escape, T.REVERT_WORDS))).alias("revert"),
    )
    counted = (
        files.where("test")
        .select("sha", "file")
        .repartition("sha")
        .distinct()
        .join(only_tests, "sha")
        .join(flags, "sha")
        .groupBy("file")
        .agg(
            F.count("*").alias("total"),
            F.count_if("only_tests").alias("isolated"),
            F.count_if("suspicious").alias("suspicious"),
            F.count_if("revert").alias("reverts"),
        )
    )
    return score(counted).where(F.col("score") >= least)


def score(counted: DataFrame) -> DataFrame:
    alone = F.when(F.col("isolated") >= 3, F.least((F.col("isolated") - 2) * 0.15, F.lit(0.6))).otherwise(0.0)
    signals = F.array_compact(
        F.array(
            F.when(F.col("suspicious") > 0, F.lit("suspicious_messages")),
            F.when(F.col("reverts") > 0, F.lit("reverts")),
            F.when(F.col("isolated") >= 3, F.lit("isolated_edits")),
        )
    )
    total = F.col("suspicious") * 0.5 + F.col("reverts") * 0.7 + alone
    return counted.withColumn("score", F.least(total, F.lit(2.0))).withColumn("signals", signals)


def untested(files: DataFrame, tests: DataFrame) -> DataFrame:
    """The files (path) for whose stem no test file (path) exists."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(paths.stem(F.col("path"))), "^test_", ""), "(_test|_spec|[.]test|[.]spec)$", "")
    return files.withColumn("_stem", F.lower(paths.stem(F.col("path")))).join(tests.select(plain.alias("_stem")), "_stem", "left_anti").drop("_stem")
