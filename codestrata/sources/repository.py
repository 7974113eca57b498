"""Loaders: source trees, version-control logs, registries and earlier snapshots as tables of facts."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.text import lines_of
from codestrata.operators.graph import checkpoint

#: Larger files are not read as source.
MAX_BYTES = 500_000


def files(spark: SparkSession, root: str, repo: str = "", max_bytes: int | None = None, prune: tuple = paths.SKIPPED_PARTS, extensions: tuple = ()) -> DataFrame:
    """(repo, path, content, size_bytes, mtime) of all files below root, or of those with the extensions. Names are tested
    when files are listed, sizes before contents are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        found = found.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    found = found.load(root)
    base = found.select(F.lit(repo).alias("repo"), F.col("path").alias("_full"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    if max_bytes:
        base = base.where(F.col("size_bytes") < max_bytes)
    start = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("_full", "^[a-z]+:(//)?", ""), "^" + re.escape(start.split("://")[-1]) + "/", "")
    out = base.withColumn("path", relative).where(~paths.in_folder(F.col("path"), prune))
    return out.select("repo", "path", F.decode("content", "UTF-8").alias("content"), "size_bytes", "mtime")


def lines(found: DataFrame) -> DataFrame:
    """(repo, path, line_no, line) of files."""
    return lines_of(found, "content", "repo", "path")


def path_list(spark: SparkSession, place: str) -> DataFrame:
    """(path): the lines of a text file that aren't blank."""
    return spark.read.text(place).select(F.trim("value").alias("path")).where("path <> ''")


def _git(root: str, *args: str) -> str:
    if not os.path.exists(os.path.join(root, ".git")):
        raise FileNotFoundError(f"{root} is no repository")
    # %x1f and the like are git's own; names come unquoted
    return subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], check=True, capture_output=True, text=True, errors="replace").stdout


def git_log(spark: SparkSession, root: str, repo: str = "", since_days: int | None = None, merges: bool = True, revisions: str = "HEAD") -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of a repository's history, as parse_name_status gives them, read once on the driver.

    revisions: what git takes, as "v1.0..HEAD" for all after a tag. since_days: only the last so many days.
    """
    args = ["log", "--name-status", "-M", "--date=iso-strict", "--pretty=format:COMMIT:%H%x1f%an%x1f%ad%x1f%s%x1f%b%x1e"]
    args += [] if merges else ["--no-merges"]
    args += [f"--since={since_days} days ago"] if since_days else []
    records = ["COMMIT:" + r for r in re.split("(?m)^COMMIT:", _git(root, *args, revisions, "--"))[1:]]
    return parse_name_status(spark.createDataFrame([(repo, r) for r in records], "repo string, content string"))


def git_tags(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(repo, tag, sha, tagged_at): tags with the commits that they name."""
    form = "%(refname:short)%1f%(objectname)%1f%(*objectname)%1f%(creatordate:iso-strict)"
    rows = [x.split("\x1f") for x in _git(root, "for-each-ref", f"--format={form}", "refs/tags").splitlines()]
    table = spark.createDataFrame([(repo, tag, peeled or sha, at) for tag, sha, peeled, at in rows], "repo string, tag string, sha string, at string")
    return table.select("repo", "tag", "sha", F.to_timestamp("at").alias("tagged_at"))


def git_parents(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(repo, sha, parent): the commit graph, a null parent for a first commit."""
    rows = [x.split() for x in _git(root, "rev-list", "--all", "--parents").splitlines()]
    return spark.createDataFrame([(repo, r[0], p) for r in rows for p in r[1:] or [None]], "repo string, sha string, parent string")


def read_logs(spark: SparkSession, *places: str, marker: str = "COMMIT:") -> DataFrame:
    """(repo, content) of log files that begin with a marker line, a row for each commit: for parse_log() and
    parse_name_status(). A file is read by as many tasks as it has splits, and no row holds more than a commit.

    repo is that of folders named repo=..., or the file's name without its ending.
    """
    rows = spark.read.option("lineSep", f"\n{marker}").text(list(places))
    repo = F.col("repo").cast("string") if "repo" in rows.columns else F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    whole = F.when(F.col("value").startswith(marker), F.col("value")).otherwise(F.concat(F.lit(marker), "value"))
    return rows.select(repo.alias("repo"), whole.alias("content"))


def _records(marker: str) -> Column:
    """(record): the texts after each marker line's start, null for a log that has none."""
    return F.explode_outer(F.slice(F.split("content", f"(?m)^{marker}", -1), 2, 1 << 30)).alias("record")


def parse_log(logs: DataFrame, marker: str = "COMMIT:") -> DataFrame:
    """(repo, sha, file) of logs (repo, content): a marker line begins a commit, every other line that isn't blank is a file.

    What precedes the first marker is dropped; a commit without files has one row with a null file.
    """
    records = logs.select("repo", _records(marker)).where("record is not null")
    split = records.select("repo", F.split("record", r"\r?\n").alias("rows"))
    names = F.filter(F.transform(F.slice("rows", 2, 1 << 30), lambda x: F.trim(x)), lambda x: x != "")
    return split.select("repo", F.trim(F.get("rows", F.lit(0))).alias("sha"), F.explode_outer(names).alias("file"))


def parse_name_status(logs: DataFrame, marker: str = "COMMIT:", fields: str = "\x1f") -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of logs (repo, content): marker lines with sha, author, ISO date, subject and body, then
    status lines; R<score> names the old and the new path, other scored statuses are left out."""
    records = logs.select("repo", _records(marker)).where("record is not null")
    head = F.split(F.substring_index("record", "\x1e", 1), fields)
    parts = records.select(
        "repo", *[F.trim(F.get(head, F.lit(i))).alias(c) for i, c in enumerate(("sha", "author", "authored_at", "subject", "body"))], F.regexp_extract("record", "(?s)\x1e(.*)$", 1).alias("_rest")
    )
    commits = parts.drop("_rest").withColumn("authored_at", F.to_timestamp("authored_at")).fillna("", ["body"])
    rows = parts.select("repo", "sha", F.explode(F.split("_rest", r"\r?\n")).alias("row")).withColumn("c", F.split("row", "\t"))
    status = F.get("c", F.lit(0))
    moved = status.rlike("^R[0-9]*$")
    made = rows.where((F.size("c") >= 2) & (status.isin("A", "M", "D", "C") | moved))
    touched = made.select(
        "repo", "sha", F.when(moved, F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(1))).alias("file"), F.when(moved, "R").otherwise(status).alias("status"), F.when(moved, F.get("c", F.lit(1))).alias("renamed_from")
    )
    return commits, touched.where("file is not null")


def current_names(renames: DataFrame, rounds: int = 32) -> DataFrame:
    """(old, new): every earlier name of a file with its last one; renames: (renamed_from, file), without cycles."""
    out = checkpoint(renames.select(F.col("renamed_from").alias("old"), F.col("file").alias("new")).distinct())
    for _ in range(rounds):
        step = out.select(F.col("old").alias("new"), F.col("new").alias("_next"))
        joined = checkpoint(out.join(step, "new", "left"))  # names jump to their last known one, so lines halve
        if not joined.where("_next is not null").take(1):
            return out
        out = joined.select("old", F.coalesce("_next", "new").alias("new")).distinct()
    raise ValueError("renames run in a circle")


def sibling_repos(parent: str, depth: int = 2) -> list[tuple[str, str]]:
    """(name, path) of folders below parent that hold a version-control folder, by name."""
    found = []
    for folder, below, _ in os.walk(parent):
        if folder != parent and ".git" in below:
            found.append((os.path.basename(folder), folder))
            below[:] = []
        elif os.path.relpath(folder, parent).count(os.sep) >= depth - 1 and folder != parent:
            below[:] = []
    return sorted(found)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Endpoints written by an earlier run."""
    schema = "repo string, spec_file string, path string, method string, operation_id string, summary string, tags array<string>"
    return spark.read.schema(schema).json(path)


def sections(found: DataFrame) -> DataFrame:
    """(number, name, file, content) of a folder of numbered sections: INDEX.md of each, else its first .md by name."""
    top = F.regexp_extract("path", "^([0-9]{2}-[^/]+)/", 1)
    name = F.regexp_extract("path", "^[^/]+/([^/]+[.]md)$", 1)
    rows = found.select(top.alias("section"), name.alias("file"), "content").where("section <> '' and file <> ''")
    best = rows.groupBy("section").agg(F.min_by(F.struct("file", "content"), F.struct(F.col("file") != "INDEX.md", "file")).alias("x"))
    return best.select(F.substring("section", 1, 2).cast("int").alias("number"), F.substr("section", F.lit(4)).alias("name"), "x.*")
