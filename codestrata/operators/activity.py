"""Activity of paths and people: hot and frozen zones, ownership, orphans, branches, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions import text as T


def zones(touches: DataFrame, reference: Column, hot_days: int = 30, hot_commits: int = 10, frozen_days: int = 180) -> DataFrame:
    """(path, commits, recent, last_at, zone): hot by recent commits, frozen by silence, else normal. touches: (path, at)."""
    recent = F.count_if(F.col("at") >= reference - F.make_interval(days=F.lit(hot_days)))
    counted = touches.groupBy("path").agg(F.count("*").alias("commits"), recent.alias("recent"), F.max("at").alias("last_at"))
    zone = F.when(F.col("recent") >= hot_commits, "hot").when(F.col("last_at") < reference - F.make_interval(days=F.lit(frozen_days)), "frozen").otherwise("normal")
    return counted.withColumn("zone", zone)


def ownership(touches: DataFrame) -> DataFrame:
    """(path, author, commits, share, rank, authors, clear_owner): contributions to each path. touches: (path, author).

    No clear owner: more than ten authors of whom none has 30 percent.
    """
    counted = touches.groupBy("path", "author").agg(F.count("*").alias("commits"))
    whole = Window.partitionBy("path")
    share = F.col("commits") / F.sum("commits").over(whole)
    order = whole.orderBy(F.desc("commits"), "author")
    ranked = counted.withColumn("share", share).withColumn("rank", F.row_number().over(order)).withColumn("authors", F.count("*").over(whole))
    return ranked.withColumn("clear_owner", ~((F.col("authors") > 10) & (F.max("share").over(whole) < 0.3)))


def owners(touches: DataFrame) -> DataFrame:
    """(path, author, rank, clear_owner): the rows of ownership() that rank first, by sums alone."""
    counted = touches.groupBy("path", "author").agg(F.count("*").alias("commits"))
    first = F.min_by("author", F.struct((-F.col("commits")).alias("n"), "author")).alias("author")
    unclear = (F.count("*") > 10) & (F.max("commits") / F.sum("commits") < 0.3)
    return counted.groupBy("path").agg(first, F.lit(1).alias("rank"), (~unclear).alias("clear_owner"))


def orphans(touches: DataFrame, reference: Column, path_days: int = 365, author_days: int = 180) -> DataFrame:
    """(path, creator, last_at, creator_last_at): paths long untouched whose first author is long gone."""
    by_path = touches.groupBy("path").agg(F.max("at").alias("last_at"), F.min_by("author", F.struct("at", "author")).alias("creator"))
    seen = touches.groupBy(F.col("author").alias("creator")).agg(F.max("at").alias("creator_last_at"))
    before = lambda c, days: F.col(c) < reference - F.make_interval(days=F.lit(days))
    return by_path.where(before("last_at", path_days)).join(seen, "creator").where(before("creator_last_at", author_days))


def branch_status(age_days: Column) -> Column:
    return F.when(age_days < 7, "active").when(age_days <= 30, "stale").otherwise("abandoned")


def is_wip(name: Column) -> Column:
    return F.lower(name).rlike("wip|draft|temp|experiment")


def naming_votes(stems: DataFrame) -> DataFrame:
    """(kebab, snake, camel, winner) of (stem)."""
    style = T.naming_style(F.col("stem"))
    votes = stems.agg(*[F.count_if(style == s).alias(s) for s in ("kebab", "snake", "camel")])
    winner = (
        F.when(F.col("kebab") + F.col("snake") + F.col("camel") == 0, F.lit(None).cast("string"))
        .when((F.col("snake") >= F.col("camel")) & (F.col("snake") >= F.col("kebab")), "snake")
        .when(F.col("camel") > F.col("kebab"), "camel")
        .otherwise("kebab")
    )
    return votes.withColumn("winner", winner)


def samples(files: DataFrame, reference: Column, most: int = 50) -> DataFrame:
    """(category, path): of each category's files (category, path, lines, changed_at, is_test) the ten longest, the five
    last changed within 30 days, and three tests of each folder, at most `most` in all; long ones first."""
    recent = F.col("changed_at") >= reference - F.make_interval(days=F.lit(30))
    rank = lambda first: F.row_number().over(Window.partitionBy("category").orderBy(F.desc(first), "path"))
    tests = Window.partitionBy("category", "is_test", paths.folder(F.col("path"))).orderBy("path")
    marked = files.select(
        "category",
        "path",
        (rank("lines") <= 10).alias("long"),
        (recent & (rank("changed_at") <= 5)).alias("new"),
        (F.col("is_test") & (F.row_number().over(tests) <= 3)).alias("test"),
    )
    order = Window.partitionBy("category").orderBy(F.desc("long"), F.desc("new"), "path")
    chosen = marked.where("long or new or test").withColumn("n", F.row_number().over(order))
    return chosen.where(F.col("n") <= most).select("category", "path")


def top_per(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each value of `by`, with rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
