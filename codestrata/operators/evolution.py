"""Deprecations, changelog sections, breaking commits, replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as T


def deprecations(lines: DataFrame) -> DataFrame:
    """lines (path, line_no, line) that hold a marker, with marker, replacement, since, remove_after and severity."""
    found = lines.withColumn("marker", T.deprecation_marker(F.col("line"))).where("marker is not null")
    t = F.trim("line")
    return (
        found.withColumn("replacement", T.replacement(t))
        .withColumn("since", T.since(t))
        .withColumn("remove_after", T.remove_after(t))
        .withColumn("severity", T.deprecation_severity(t))
    )


def changelog(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., line_no, version, section, text): bullets under Deprecated, Removed and Changed headings of a version.

    The version and the section are carried forward from their headings; a new version ends the section.
    """
    t = F.trim("line")
    low = F.lower(t)
    version = F.coalesce(
        F.nullif(F.regexp_extract(t, r"^## \[([^\]]*)\]", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^## ([^\s\[]\S*)", 1), F.lit(""))
    )
    section = F.when(
        t.startswith("### "),
        F.when(low.contains("deprecated"), "deprecated").when(low.contains("removed"), "removed").when(low.contains("changed") | low.contains("breaking"), "changed").otherwise("none"),
    )
    marked = lines.select(*by, "line_no", t.alias("t"), version.alias("v"), F.when(version.isNotNull(), F.lit("none")).otherwise(section).alias("s"))
    order = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumn("version", F.last("v", ignorenulls=True).over(order)).withColumn("section", F.last("s", ignorenulls=True).over(order))
    text = F.regexp_extract("t", "^- (.*)$", 1)
    return (
        carried.where("version is not null and section <> 'none'")
        .withColumn("text", text)
        .where(F.octet_length("text") > 5)
        .select(*by, "line_no", "version", "section", F.trim("text").alias("text"))
    )


def breaking(commits: DataFrame) -> DataFrame:
    return commits.withColumn("kind", T.breaking_kind(F.col("subject"), F.col("body"))).where("kind is not null")


def replacements(commit_files: DataFrame, least: float = 0.5) -> DataFrame:
    """(sha, removed, added, confidence): a removed and an added or changed file of a commit with like names.

    commit_files: (sha, file, status, renamed_from): a rename removes its old and changes its new name.
    """
    gone = commit_files.select(
        "sha", F.when(F.col("status") == "D", F.col("file")).when(F.col("status").startswith("R"), F.col("renamed_from")).alias("removed")
    ).where("removed is not null")
    new = commit_files.where(F.col("status").isin("A", "M", "R", "C") | F.col("status").rlike("^R[0-9]+$")).select("sha", F.col("file").alias("added"))
    pairs = gone.join(new, "sha").withColumn("confidence", T.path_similarity(F.col("removed"), F.col("added")))
    return pairs.where(F.col("confidence") >= least)


def debt(lines: DataFrame) -> DataFrame:
    """(path, todo, fixme, hack, xxx, disabled): marks of debt by file."""
    marks = {
        "todo": r"\bTODO\b",
        "fixme": r"\bFIXME\b",
        "hack": r"\b(HACK|WORKAROUND)\b",
        "xxx": r"\b(XXX|WTF)\b",
        "disabled": r"\b(xit|t\.Skip|it\.skip|describe\.skip)\b|@pytest\.mark\.skip|#\[ignore\]",
    }
    counts = [F.sum(F.regexp_count("line", F.lit(p))).alias(k) for k, p in marks.items()]
    summed = lines.groupBy("path").agg(*counts)
    return summed.where(" + ".join(marks) + " > 0")


def intents(lines: DataFrame, branches: DataFrame, commits: DataFrame) -> DataFrame:
    """(source, text): what is meant to be built, from comments, branches (name) and commits (subject)."""
    comments = lines.where(F.col("line").rlike(r"(?i)\b(TODO|FIXME):?\s+implement\b|\bPLANNED\b")).select(F.lit("comment").alias("source"), F.trim("line").alias("text"))
    named = branches.where(F.col("name").rlike("(^|/)feat/")).select(F.lit("branch").alias("source"), F.col("name").alias("text"))
    done = commits.where(F.col("subject").rlike(r"^feat(\([^)]*\))?!?:")).select(F.lit("commit").alias("source"), F.col("subject").alias("text"))
    return comments.unionByName(named).unionByName(done)
