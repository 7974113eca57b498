"""Sinks: reports as a JSON envelope or as Markdown tables; large tables as Parquet."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelope(schema: str, parts: dict[str, DataFrame], most: int = 1000, began: float | None = None) -> str:
    """A JSON document of the first rows of each part, with the schema's name and the time it took.

    Only `most` rows of a part come to the driver. A part with more of them is named in "omitted" with how many are left
    out; write_parts() writes all.
    """
    began = time.time() if began is None else began
    body, omitted = {}, {}
    for name, df in parts.items():
        rows = df.select(F.to_json(F.struct("*"))).limit(most + 1).collect()
        body[name] = [json.loads(r[0]) for r in rows[:most]]
        if len(rows) > most:
            omitted[name] = df.count() - most
    head = {"$schema": schema, "generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "elapsed_ms": int((time.time() - began) * 1000)}
    return json.dumps(head | ({"omitted": omitted} if omitted else {}) | body, ensure_ascii=False, indent=2)


def write_parts(parts: dict[str, DataFrame], place: str, mode: str = "errorifexists") -> None:
    """All rows of each part as lines of JSON in a folder of its name, by the executors."""
    for name, df in parts.items():
        df.write.mode(mode).json(f"{place}/{name}")


def markdown(df: DataFrame, most: int = 20) -> str:
    """A table of the first rows."""
    clean = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [df.columns, ["---"] * len(df.columns), *([clean(v) for v in r] for r in df.limit(most).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


#: Reports by name: a title, and parts as (table, heading, order, rows shown at most). A leading "-" orders downwards.
REPORTS = {
    "coverage": ("Test coverage", (("overall", "Overall", (), 1), ("files", "Worst files", ("percent", "path"), 20), ("ranges", "Uncovered", ("path", "start"), 60))),
    "flaky": ("Flaky tests", (("flaky", "Candidates", ("-score", "file"), 50),)),
    "ci": ("Pipelines", (("triggers", "Triggers", ("repo",), 50), ("jobs", "Jobs", ("file", "job"), 100))),
    "openapi": ("Endpoints", (("endpoints", "Endpoints", ("path", "method"), 200),)),
    "protobuf": ("Remote calls", (("rpcs", "Calls", ("file", "service", "rpc"), 200), ("messages", "Messages", ("file", "message"), 200))),
    "graphql": ("Operations", (("graphql", "Operations and types", ("kind", "type_name", "name"), 200),)),
    "crossref": ("Evidence", (("statuses", "By status", ("status",), 3), ("crossref", "Identifiers", ("status", "identifier"), 100))),
    "deprecations": ("Deprecations", (("markers", "Markers", ("severity", "path", "line_no"), 100),)),
    "changelog": ("Changelog", (("changelog", "Entries", ("version", "line_no"), 100),)),
    "breaking": ("Breaking commits", (("breaking", "Commits", ("-authored_at", "sha"), 50),)),
    "replacements": ("Replacements", (("replacements", "Pairs", ("-confidence", "removed", "added", "sha"), 50),)),
    "releases": ("Releases", (("releases", "Releases", ("tag",), 100),)),
    "unreleased": ("Unreleased work", (("authors", "Authors", ("-commits", "author"), 50), ("touched", "Files", ("-touches", "file"), 50), ("commits", "Commits", ("-authored_at", "sha"), 50))),
    "file_releases": ("Files by release", (("introduced", "Releases", ("-file_count", "release"), 50), ("files", "Files", ("file",), 200))),
    "contract_diff": ("Changes of contracts", (("summary", "Summary", (), 1), ("changes", "Changes", ("method", "path"), 500))),
    "cochange": ("Files that change together", (("pairs", "Pairs", ("-ratio", "-shared", "file_a", "file_b"), 100), ("clusters", "Clusters", ("-size", "component"), 50))),
    "glance": ("At a glance", (("stacks", "Stacks", ("stack",), 20), ("entry_points", "Entry points", ("path",), 10), ("hot_files", "Hot files", ("-commits", "path"), 5), ("active_authors", "Active authors", ("-commits", "author"), 5))),
    "overview": ("Overview", (("stacks", "Stacks", ("stack",), 20), ("tree", "Tree", ("path",), 200), ("commands", "Commands", ("command",), 20))),
}


def ordered(df: DataFrame, *order: str, most: int | None = None) -> DataFrame:
    """df by the given columns, downwards where a "-" leads, and its first rows if so many are asked for."""
    keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    out = df.orderBy(*keys) if keys else df
    return out if most is None else out.limit(most)


def part(name: str, key: str, df: DataFrame) -> DataFrame:
    """The rows of a report's part in its order."""
    order, most = next((o, m) for k, _, o, m in REPORTS[name][1] if k == key)
    return ordered(df, *order, most=most)


def render(name: str, tables: dict[str, DataFrame]) -> str:
    """The report of this name as Markdown, of the tables that are given; the others' parts are left out."""
    title, parts = REPORTS[name]
    out = [f"# {title}"]
    for key, heading, order, most in parts:
        if key in tables:
            out += [f"## {heading}", markdown(ordered(tables[key], *order), most)]
    return "\n\n".join(out) + "\n"


def write(df: DataFrame, path: str, *partition: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def gate(changes: DataFrame) -> None:
    """Fail if a change breaks clients."""
    broken = changes.where("breaking").limit(5).collect()
    if broken:
        raise SystemExit("breaking changes: " + ", ".join(f"{r['method']} {r['path']} {r['change']}" for r in broken))
