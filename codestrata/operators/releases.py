"""Releases: order and contents, unreleased work, and which release a file came with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as T


def ordered(tags: DataFrame) -> DataFrame:
    """tags (tag, ...) with previous_tag and is_semver, in version order."""
    order = Window.orderBy(T.version_numbers(F.col("tag")), "tag")  # as many rows as there are tags
    return tags.withColumn("previous_tag", F.lag("tag").over(order)).withColumn("is_semver", T.is_semver(F.col("tag")))


def contents(commit_release: DataFrame) -> DataFrame:
    """(tag, commits, authors) of commits with the release that first contains them."""
    return commit_release.where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))


def first_release(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """commits with tag: the earliest tag (tag, tagged_at) not before authored_at; null if none. For a linear history.

    A tag holds the time since the one before it. Times and commits meet by month, an equi-join; commits from before the
    first tag's month meet in that.
    """
    each = tags.groupBy("tagged_at").agg(F.min("tag").alias("tag"))
    month = lambda c: F.trunc(F.to_date(c), "month")
    before = F.lag("tagged_at").over(Window.orderBy("tagged_at"))  # as many rows as there are tags
    held = each.withColumn("_after", before).withColumn(
        "_month", F.explode(F.sequence(month(F.coalesce("_after", "tagged_at")), month(F.col("tagged_at")), F.expr("interval 1 month")))
    )
    first = each.agg(month(F.min("tagged_at")).alias("_first"))  # one row
    rows = commits.drop("tag").crossJoin(F.broadcast(first)).withColumn("_at", F.greatest(month(F.col("authored_at")), "_first"))
    inside = (F.col("authored_at") <= F.col("_until")) & (F.col("_after").isNull() | (F.col("authored_at") > F.col("_after")))
    held = held.select("_month", "_after", F.col("tagged_at").alias("_until"), "tag")
    return rows.join(held, (F.col("_at") == F.col("_month")) & inside, "left").drop("_first", "_at", "_month", "_after", "_until")


def reachable_release(parents: DataFrame, tags: DataFrame) -> DataFrame:
    """(repo, sha, tag): the first tag, in version order, whose commit reaches sha by parents; null if none does.

    parents: (repo, sha, parent), parent null for a first commit; tags: (repo, tag, sha). Branches and merges are
    followed. A repository's graph of ids is walked in one task, each edge once; texts and files don't take part.
    """

    def walk(key: tuple, edges: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        above: dict = {}
        for sha, parent in zip(edges["sha"], edges["parent"], strict=True):
            above.setdefault(sha, [])
            if parent is not None:
                above[sha].append(parent)
        first: dict = {}
        for tag, sha in zip(*(named.sort_values("place")[c] for c in ("tag", "sha")), strict=True):
            todo = [sha]
            while todo:
                x = todo.pop()
                if x in above and x not in first:
                    first[x] = tag
                    todo += above[x]
        return pd.DataFrame({"repo": [key[0]] * len(above), "sha": list(above), "tag": [first.get(x) for x in above]}, dtype=object)

    order = Window.partitionBy("repo").orderBy(T.version_numbers(F.col("tag")), "tag")
    placed = tags.select("repo", "tag", "sha", F.row_number().over(order).alias("place"))
    return parents.groupBy("repo").cogroup(placed.groupBy("repo")).applyInPandas(walk, "repo string, sha string, tag string")


def touched_files(commit_files: DataFrame) -> DataFrame:
    """(file, touches) of the commits (sha, file, tag) without a release; a file counts once in a commit."""
    rows = commit_files.where(F.col("tag").isNull()).select("sha", "file").distinct()
    return rows.groupBy("file").agg(F.count("*").alias("touches"))


def unreleased(commit_release: DataFrame) -> DataFrame:
    """(author, commits) without a release, and whether any of them breaks."""
    return (
        commit_release.where(F.col("tag").isNull())
        .groupBy("author")
        .agg(F.count("*").alias("commits"), F.bool_or(T.is_breaking_subject(F.col("subject"))).alias("has_breaking"))
    )


def file_releases(commit_files: DataFrame) -> DataFrame:
    """(file, introduced_in, last_modified_in, is_unreleased, commit_count) of (file, sha, authored_at, tag)."""
    by = F.struct("authored_at", "sha")
    grouped = commit_files.groupBy("file").agg(
        F.min_by("tag", by).alias("introduced_in"), F.max_by("tag", by).alias("last_modified_in"), F.countDistinct("sha").alias("commit_count")
    )
    return grouped.withColumn("is_unreleased", F.col("last_modified_in").isNull())


def changelog_versions(lines: DataFrame) -> DataFrame:
    """(line_no, version, date) of the headings "## [v] - date" and "## v"."""
    t = F.trim("line")
    version = F.coalesce(F.nullif(F.regexp_extract(t, r"^## \[([^\]]*)\]", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^## ([^\s\[]\S*)", 1), F.lit("")))
    date = F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return lines.select("line_no", version.alias("version"), date.alias("date")).where("version is not null")


def match_changelog(tags: DataFrame, versions: DataFrame) -> DataFrame:
    """tags with changelog_entry: the version without leading v that the changelog names."""
    plain = lambda c: F.regexp_replace(c, "^v+", "")
    known = versions.select(plain(F.col("version")).alias("_v"), "version").groupBy("_v").agg(F.min("version").alias("changelog_entry"))
    return tags.withColumn("_v", plain(F.col("tag"))).join(known, "_v", "left").drop("_v")
