"""API contracts: differences between snapshots, evidence of implementation in code, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators import matching

#: Paths that every service has and that prove nothing.
GENERIC_PATHS = ("/", "/*", "/health", "/ping", "/status", "/version")
FIELDS = ("operation_id", "summary", "tags", "spec_file")


def _last(endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: that of the last spec file."""
    keyed = endpoints.withColumn("method", F.upper("method"))
    rest = [c for c in keyed.columns if c not in keys]
    return keyed.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("spec_file", "operation_id", "summary")).alias("x")).select(*keys, "x.*")


def diff(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """(by..., method, path, change, fields, breaking): one full outer join for all repositories at once.

    Removing an endpoint and changing its operation id break clients; summaries, tags and the file do not.
    """
    keys = [*by, "method", "path"]
    old = _last(before, keys).select(*keys, F.struct(*FIELDS).alias("old"))
    new = _last(after, keys).select(*keys, F.struct(*FIELDS).alias("new"))
    tags = lambda side: F.array_join(F.array_sort(F.coalesce(F.col(f"{side}.tags"), F.array().cast("array<string>"))), ",")
    changed = lambda f: ~(tags("old") == tags("new")) if f == "tags" else ~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}"))
    fields = F.array_compact(F.array(*[F.when(changed(f), F.lit(f)) for f in FIELDS]))
    joined = old.join(new, keys, "full_outer").withColumn(
        "change", F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("modified")
    )
    empty = F.array().cast("array<string>")
    return (
        joined.withColumn("fields", F.when(F.col("change") == "modified", fields).otherwise(empty))
        .where((F.col("change") != "modified") | (F.size("fields") > 0))
        .select(*keys, "change", "fields", ((F.col("change") == "removed") | F.array_contains("fields", "operation_id")).alias("breaking"))
    )


def summary(changes: DataFrame, *by: str) -> DataFrame:
    out = changes.groupBy(*by) if by else changes.groupBy()
    return out.agg(F.count("*").alias("total"), F.count_if("breaking").alias("breaking"), F.count_if(~F.col("breaking")).alias("non_breaking"))


def check(repos: DataFrame, changes: DataFrame) -> DataFrame:
    """(repo, status, total, breaking) for every row of repos (repo, has_baseline)."""
    counted = repos.join(summary(changes, "repo"), "repo", "left").fillna(0, ["total", "breaking"])
    status = (
        F.when(~F.col("has_baseline"), "skipped").when(F.col("breaking") > 0, "breaking").when(F.col("total") > 0, "changed").otherwise("clean")
    )
    return counted.select("repo", status.alias("status"), "total", "breaking")


def crossref(identifiers: DataFrame, lines: DataFrame, most: int = 20, all_occurrences: bool = True) -> DataFrame:
    """(identifier, status, evidence_count): how often an identifier is found in lines (path, line_no, line).

    An identifier counts where no ASCII letter, digit or underscore adjoins, one with a slash anywhere. At most `most`
    lines count: 0 PHANTOM, 1 or 2 CANDIDATE, more IMPLEMENTED. all_occurrences=False tests only the first occurrence
    in a line.

    All identifiers are looked for in one pass over the lines, by an automaton (see matching); blank ones have no
    evidence.
    """
    wanted = identifiers.select("identifier").where(F.octet_length("identifier") >= 3).where(~F.col("identifier").isin(*GENERIC_PATHS))
    found = matching.line_counts(lines, wanted.where(~matching.is_blank(F.col("identifier"))), all_occurrences)
    counted = found.select(F.col("word").alias("identifier"), F.least("lines", F.lit(most)).alias("evidence_count"))
    status = F.when(F.col("evidence_count") == 0, "PHANTOM").when(F.col("evidence_count") < 3, "CANDIDATE").otherwise("IMPLEMENTED")
    return identifiers.select("identifier").distinct().join(counted, "identifier", "left").fillna(0, ["evidence_count"]).withColumn("status", status)


def status_counts(crossref: DataFrame) -> DataFrame:
    """(status, identifiers) of crossref()."""
    return crossref.groupBy("status").agg(F.count("*").alias("identifiers"))


def counts(endpoints: DataFrame, rpcs: DataFrame, messages: DataFrame, graph: DataFrame) -> DataFrame:
    """(repo, endpoints, services, rpcs, messages, operations, types): how much of each kind of contract there is."""
    parts = [
        endpoints.groupBy("repo").agg(F.count("*").alias("endpoints")),
        rpcs.groupBy("repo").agg(F.countDistinct("file", "service").alias("services"), F.count("*").alias("rpcs")),
        messages.groupBy("repo").agg(F.count("*").alias("messages")),
        graph.groupBy("repo").agg(F.count_if(F.col("kind") == "operation").alias("operations"), F.count_if(F.col("kind") != "operation").alias("types")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "repo", "full_outer")
    return out.fillna(0)


def evidence(hits: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` lines of each identifier, by path and line; hits may come from matching.occurrences()."""
    order = Window.partitionBy("identifier").orderBy("path", "line_no")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def with_status(endpoints: DataFrame, statuses: DataFrame) -> DataFrame:
    """endpoints with the status of their operation id, else of their path, "?" where neither was looked for."""
    by_id = statuses.select(F.col("identifier").alias("operation_id"), F.col("status").alias("_a"))
    by_path = statuses.select(F.col("identifier").alias("path"), F.col("status").alias("_b"))
    joined = endpoints.join(by_id, "operation_id", "left").join(by_path, "path", "left")
    return joined.withColumn("status", F.coalesce("_a", "_b", F.lit("?"))).drop("_a", "_b")


def entities(endpoints: DataFrame, rpcs: DataFrame, operations: DataFrame) -> DataFrame:
    """(source_kind, file, identifier, path, method) of all three kinds of contracts."""
    name = F.coalesce("operation_id", "path")
    rest = endpoints.select(F.lit("openapi").alias("source_kind"), F.col("spec_file").alias("file"), name.alias("identifier"), "path", "method")
    calls = rpcs.select(F.lit("protobuf").alias("source_kind"), "file", F.col("rpc").alias("identifier"))
    graph = operations.select(F.lit("graphql").alias("source_kind"), F.col("schema_file").alias("file"), F.col("name").alias("identifier"))
    return rest.unionByName(calls, allowMissingColumns=True).unionByName(graph, allowMissingColumns=True)
