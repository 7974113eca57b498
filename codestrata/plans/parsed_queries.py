"""Queries that write the benchmark tables as files, logs, reports and definitions, and read them back by the parsers.

The SQL gives the facts from the tables themselves, without any text between.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import display, paths, symbols, syntax
from codestrata.functions import text as T
from codestrata.operators import activity, contracts, evolution, files, graph, knowledge, project, quality, releases, search, summaries
from codestrata.sources import coverage, repository, specs, vectors
from codestrata.streaming import watch

from . import fact_queries, report, search_queries
from .adapters import PATH_SQL, SUBJECT_SQL, TAGS_SQL, order_commits, part_path, release_tags, table, texts

_NOW, _NOW_SQL = "2000-01-01", "TIMESTAMP '2000-01-01'"


def _pick(names: tuple, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))


def _case(names: tuple, key: str) -> str:
    quoted = [n.replace("'", "''") for n in names]
    return f"CASE {key} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(quoted)) + " END"


def _text(rows: DataFrame, by: tuple, order: str, line: Column, name: str = "content", between: str = "\n") -> DataFrame:
    """(by..., content): the lines of each group in order, as one text."""
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return grouped.select(*by, F.array_join(F.transform("x", lambda x: x["l"]), between).alias(name))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_size", part_path().alias("path"))


_P = f"p AS (SELECT p_partkey AS k, p_name, p_brand, p_size, {PATH_SQL} AS path FROM part)"

# --- logs ----------------------------------------------------------------------------------------------------------


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, author, at, subject, file, line): the parts of orders as files of commits, each once."""
    # one exchange by part for the grouping and the join with parts, one by commit for all that follows
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").repartition("l_partkey")
    items = lines.groupBy(F.col("l_orderkey").alias("sha"), "l_partkey").agg(F.min("l_linenumber").alias("line"))
    commits = order_commits(spark, sf_dir).withColumn("repo", F.concat(F.lit("r"), (F.col("author") % 20).cast("string")))
    named = items.join(_parts(spark, sf_dir).select(F.col("k").alias("l_partkey"), F.concat("path", F.lit("_"), "k").alias("file")), "l_partkey")
    return commits.join(named, "sha")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, content): a row for each commit, with its files in order of their first lines, as read_logs() gives them."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("line"))
    named = items.join(_parts(spark, sf_dir), "k").select("sha", "line", F.concat("path", F.lit("_"), "k").alias("file"))
    # a commit's files are gathered before its repository is joined, so that commits are sorted, not their files
    files = named.repartition("sha").groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("line", "file"))).alias("x"))
    content = F.array_join(F.array_distinct(F.transform("x", lambda x: x["file"])), "\n")
    commits = order_commits(spark, sf_dir).select("sha", F.concat(F.lit("r"), (F.col("author") % 20).cast("string")).alias("repo"))
    return commits.join(files, "sha").select("repo", F.concat(F.lit("COMMIT:"), "sha", F.lit("\n\n"), content, F.lit("\n")).alias("content"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.parse_log(_log(spark, sf_dir))


def log_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _pick(("R090\told/", "A\t", "M\t", "D\t", "C75\tx\t"), F.col("line"))
    moved = F.when(F.col("line") % 5 == 0, F.concat("file", F.lit("\t"), "file")).otherwise(F.col("file"))
    commits = _text(_touched(spark, sf_dir), ("repo", "sha", "author", "authored_at", "subject"), "line", F.concat(status, moved))
    at = F.date_format("authored_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit("COMMIT:"), F.concat_ws("\x1f", "sha", "author", at, "subject", F.concat(F.lit("body of "), "sha", F.lit("\nmore"))), F.lit("\x1e\n"))
    logs = commits.select("repo", F.concat(head, "content", F.lit("\n")).alias("content"))  # a row for each commit, as read_logs() gives them
    read, touched = repository.parse_name_status(logs)
    facts = read.select("repo", "sha", "author", F.unix_timestamp("authored_at").alias("made_at"), "subject", F.substring_index("body", "\n", 1).alias("body"))
    return touched.join(facts, ["repo", "sha"]).drop("repo")


def renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files that are renamed to the next of their nation, so that the last names the whole line."""
    k = F.col("c_custkey")
    renames = table(spark, sf_dir, "customer").where(k >= 40).select((k - 40).alias("renamed_from"), k.alias("file"))
    return repository.current_names(renames)


def reachable_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as commits: a repository's main line by key, every seventh a side branch that nothing merges."""
    k, repo = F.col("c_custkey"), F.concat(F.lit("r"), (F.col("c_custkey") % 10).cast("string"))
    listed = table(spark, sf_dir, "customer").select(repo.alias("repo"), "c_custkey", (k % 7 != 3).alias("main"))
    last = F.max(F.when(F.col("main"), k)).over(Window.partitionBy("repo").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, -1))
    parents = listed.select("repo", k.cast("string").alias("sha"), last.cast("string").alias("parent"))
    tags = listed.where("main and c_custkey % 130 < 10 and c_custkey >= 130").select("repo", F.concat(F.lit("v1."), k.cast("string")).alias("tag"), k.cast("string").alias("sha"))
    return releases.reachable_release(parents, tags).where("tag is not null")


def unreleased_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = releases.first_release(order_commits(spark, sf_dir), release_tags(spark, sf_dir)).select("sha", "tag")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file"))
    return releases.touched_files(items.join(released, "sha"))


def changelog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases against a changelog that names every other of them."""
    tags = release_tags(spark, sf_dir)
    minor = F.regexp_extract("tag", r"\.([0-9]+)\.", 1).cast("int")
    heads = tags.where(minor % 2 == 1).select(F.lit(1).alias("one"), "tag", F.concat(F.lit("## ["), F.substr("tag", F.lit(2)), F.lit("] - "), F.date_format("tagged_at", "yyyy-MM-dd"), F.lit("\n### Changed\n- things")).alias("h"))
    lines = T.lines_of(_text(heads, ("one",), "tag", F.col("h")))
    return releases.match_changelog(tags, releases.changelog_versions(lines)).select("tag", "changelog_entry")


_TOUCHED = f"""{_P}, t AS (SELECT l_orderkey AS sha, l_partkey, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
f AS (SELECT 'r' || o_custkey % 20 AS repo, CAST(sha AS VARCHAR) AS sha, CAST(o_custkey AS VARCHAR) AS author, CAST(epoch(o_orderdate) AS BIGINT) AS made_at, {SUBJECT_SQL} AS subject, path || '_' || k AS file, line
  FROM t JOIN p ON k = l_partkey JOIN orders ON o_orderkey = sha)"""

# --- coverage reports ----------------------------------------------------------------------------------------------


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, path, line, hits) as in the coverage queries: brands as files, shipping days as lines."""
    items = table(spark, sf_dir, "lineitem").join(_parts(spark, sf_dir).select(F.col("k").alias("l_partkey"), F.col("p_brand").alias("path")), "l_partkey")
    line = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return items.groupBy(F.col("l_linestatus").alias("report"), "path", line.alias("line")).agg(F.count_if(F.col("l_returnflag") != "N").alias("hits"))


def _report(spark: SparkSession, sf_dir: str, line: Column, before: Column, after: str, head: str = "", tail: str = "") -> DataFrame:
    """Reports as files: a block of lines for each path, between before and after."""
    blocks = _text(_covered(spark, sf_dir), ("report", "path"), "line", line)
    content = _text(blocks, ("report",), "path", F.concat(before, "content", F.lit(after)))
    return content.select(F.lit("r").alias("repo"), F.col("report").alias("path"), F.concat(F.lit(head), "content", F.lit(tail)).alias("content"))


def lcov_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("DA:"), "line", F.lit(","), "hits")
    return coverage.lcov(_report(spark, sf_dir, line, F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n")), "\nLF:1\nend_of_record"))


def cobertura_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('<line number="'), "line", F.lit('" hits="'), "hits", F.lit('"/>'))
    before = F.concat(F.lit('<class name="x" filename="'), "path", F.lit('" line-rate="1"><methods/><lines>'))
    return coverage.cobertura(_report(spark, sf_dir, line, before, "</lines></class>", "<coverage><classes>", "</classes></coverage>"))


def jacoco_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('<line nr="'), "line", F.lit('" mi="0" ci="'), "hits", F.lit('" mb="0" cb="0"/>'))
    before = F.concat(F.lit('<sourcefile name="'), "path", F.lit('.java">'))
    return coverage.jacoco(_report(spark, sf_dir, line, before, "</sourcefile>", '<report name="r"><package name="com/acme"><class name="com/acme/X"/>', "</package></report>"))


def go_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("path", F.lit(":"), "line", F.lit(".2,"), F.col("line") + 3, F.lit(".9 1 "), "hits")
    return coverage.go_profile(_report(spark, sf_dir, line, F.lit(""), "", "mode: set\n"))


def jest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.file_coverage(_covered(spark, sf_dir), "report")
    numbers = F.concat(F.lit('{"lines":{"total":'), "lines_total", F.lit(',"covered":'), "lines_covered", F.lit(',"skipped":0,"pct":'), F.round("percent", 2), F.lit("}}"))
    content = _text(found, ("report",), "path", F.concat(F.lit('"'), "path", F.lit('":'), numbers), between=",")
    head = F.lit('{"total":{"lines":{"total":9,"covered":9,"pct":100}},')
    return coverage.jest_summary(content.select(F.col("report").alias("path"), F.concat(head, "content", F.lit("}")).alias("content")))


_COV = """cov AS (SELECT l_linestatus AS report, p_brand AS path, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS line,
  count(*) FILTER (l_returnflag <> 'N') AS hits FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

# --- contracts and pipelines ---------------------------------------------------------------------------------------

_METHODS = {"F": "get", "O": "post", "P": "put"}


def _api_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as endpoints in an OpenAPI file of each of 25 repositories."""
    k = F.col("o_orderkey").cast("string")
    method = F.create_map(*[F.lit(x) for kv in _METHODS.items() for x in kv])[F.col("o_orderstatus")]
    operation = F.struct(F.concat(F.lit("op"), k).alias("operationId"), F.col("o_orderpriority").alias("summary"), F.array(F.lit("b"), F.lit("a")).alias("tags"))
    entry = F.to_json(F.create_map(F.concat(F.lit("/orders/"), k), F.create_map(method, operation)))
    entry = F.substr(entry, F.lit(2), F.length(entry) - 2)  # its braces are those of all paths
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 25).cast("string")).alias("repo"), entry.alias("e"))
    content = F.concat(F.lit('{"openapi":"3.0.0","paths":{'), F.array_join(F.collect_list("e"), ","), F.lit("}}"))
    grouped = rows.groupBy("repo").agg(content.alias("content"))
    return grouped.select("repo", F.lit("docs/openapi.json").alias("path"), "content")


def openapi_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = specs.openapi_json(_api_files(spark, sf_dir))
    return found.select("repo", "path", "method", "operation_id", "summary", F.array_join("tags", ",").alias("tags"))


def _proto_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as calls: a file for each size, a service for each brand."""
    k = F.col("k").cast("string")
    call = F.concat(F.lit("  rpc Call"), k, _pick((" (Req) returns (Rep);", " (stream Req) returns (Rep) {}", "(Req) returns (stream Rep);", " (stream a.Req) returns (stream Rep);"), F.col("k")))
    rows = _parts(spark, sf_dir).withColumn("service", F.regexp_replace("p_brand", "#", ""))
    services = _text(rows, ("p_size", "service"), "k", call)
    block = F.concat(F.lit("service "), "service", F.lit(" {\n  // rpc Old (A) returns (B);\n  option x = { y: 1 };\n"), "content", F.lit("\n}\nmessage For"), "service", F.lit(" {\n  string message = 1;\n}"))
    whole = _text(services, ("p_size",), "service", block)
    size = F.col("p_size").cast("string")
    head = F.concat(F.lit('syntax = "proto3";\npackage acme.p'), size, F.lit(";\n"))
    return whole.select(F.concat(F.lit("r"), (F.col("p_size") % 25).cast("string")).alias("repo"), F.concat(F.lit("api/f"), size, F.lit(".proto")).alias("path"), F.concat(head, "content").alias("content"))


def protobuf_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.protobuf(_proto_files(spark, sf_dir)).select("repo", "file", "package", "service", "rpc", "streaming")


def _graphql_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fields of the root types of a schema for each size."""
    field = F.concat(F.lit("  field"), F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, "(id: ID, n: Int)").otherwise(""), F.lit(": T"))
    rows = _parts(spark, sf_dir).withColumn("root", _pick(("Query", "Mutation", "Subscription"), F.col("k")))
    roots = _text(rows, ("p_size", "root"), "k", field)
    whole = _text(roots, ("p_size",), "root", F.concat(F.lit("type "), "root", F.lit(" {\n"), "content", F.lit("\n}")))
    size = F.col("p_size").cast("string")
    types = F.concat(F.lit('"""\ntype Old { x: Int }\n"""\ntype T'), size, F.lit(" {\n  id: ID\n}\ninput I"), size, F.lit(" { n: Int }\nenum E"), size, F.lit(" { A B }\n"))
    return whole.select(F.concat(F.lit("r"), (F.col("p_size") % 25).cast("string")).alias("repo"), F.concat(F.lit("s"), size, F.lit(".graphql")).alias("path"), F.concat(types, "content").alias("content"))


def graphql_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.graphql(_graphql_files(spark, sf_dir))


def contract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    protos = _proto_files(spark, sf_dir)
    return contracts.counts(specs.openapi(_api_files(spark, sf_dir)), specs.protobuf(protos), specs.messages(protos), graphql_fields(spark, sf_dir))


def dedup_entities_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three kinds of contracts as one list, and each name with its first kind."""
    every = contracts.entities(specs.openapi(_api_files(spark, sf_dir)), specs.protobuf(_proto_files(spark, sf_dir)), graphql_fields(spark, sf_dir).where("kind = 'operation'"))
    return every.groupBy("identifier").agg(F.max("source_kind").alias("source_kind"), F.max("path").alias("path"), F.max("method").alias("method"), F.count("*").alias("mentions"))


def endpoint_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints with the status of their operation or path; a third was looked for by either, a third by none."""
    k = F.col("o_orderkey")
    looked = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, F.concat(F.lit("op"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("/orders/"), k.cast("string"))).alias("identifier"),
        _pick(("PHANTOM", "CANDIDATE", "IMPLEMENTED", "PHANTOM"), k).alias("status"),
    )
    found = contracts.with_status(specs.openapi(_api_files(spark, sf_dir)), looked.where("identifier is not null"))
    return found.select("repo", "path", "status")


def snapshot_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints written by one run and read by the next."""
    place = new_folder(spark, "snapshot")
    specs.openapi(_api_files(spark, sf_dir)).write.json(place)
    return repository.snapshot(spark, place).select("repo", "spec_file", "path", "method", "operation_id", "summary", F.array_join("tags", ",").alias("tags"))


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    graph.set_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder there, which is deleted when the session's process ends: the rows of a query may be read until then."""
    place = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, place))
    return place


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_written() -> None:
    for spark, place in _written:
        with contextlib.suppress(Exception):  # the session may be gone
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _ci_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs: nations as repositories, market segments as workflows (JSON is YAML, too)."""
    k = F.col("c_custkey")
    steps = F.array_join(F.slice(F.array(F.lit('{"uses":"x@v1"}'), F.lit('{"run":"make"}'), F.lit('{"name":"n"}')), F.lit(1), (k % 4).cast("int")), ",")
    job = F.concat(F.lit('"j'), k.cast("string"), F.lit('":{"runs-on":"'), _pick(("linux", "mac"), k), F.lit('","steps":['), steps, F.lit("]}"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("segment"), "c_custkey", job.alias("job"))
    jobs = _text(rows, ("c_nationkey", "segment"), "c_custkey", F.col("job"), between=",")
    on = _pick(('"push"', '["push","pull_request"]', '{"schedule":[],"release":null}', '["workflow_dispatch"]'), F.col("c_nationkey") + F.length("segment"))
    content = F.concat(F.lit('{"on":'), on, F.lit(',"jobs":{'), "content", F.lit("}}"))
    return jobs.select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo"), F.concat(F.lit(".github/workflows/"), F.lower("segment"), F.lit(".yml")).alias("path"), content.alias("content"))


def ci_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = specs.ci_jobs(_ci_files(spark, sf_dir))
    return found.select("repo", "file", "job", "runs_on", "steps_count", F.array_join("triggers", ",").alias("triggers"), F.array_join("steps", ",").alias("steps"))


def trigger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = specs.trigger_flags(specs.ci_jobs(_ci_files(spark, sf_dir)))
    return flags.withColumn("on_other", F.array_join("on_other", ","))


_CONTRACTS = f"""{_P}, ep AS (SELECT 'r' || o_custkey % 25 AS repo, '/orders/' || o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' WHEN 'P' THEN 'PUT' END AS method,
  'op' || o_orderkey AS operation_id, o_orderpriority AS summary, 'b,a' AS tags, o_orderkey AS k FROM orders),
rpc AS (SELECT 'r' || p_size % 25 AS repo, 'api/f' || p_size || '.proto' AS file, 'acme.p' || p_size AS package, replace(p_brand, '#', '') AS service, 'Call' || k AS rpc,
  {_case(("Unary", "ClientStream", "ServerStream", "Bidi"), "k")} AS streaming FROM p),
gql AS (SELECT 'r' || p_size % 25 AS repo, 's' || p_size || '.graphql' AS schema_file, 'operation' AS kind, {_case(("Query", "Mutation", "Subscription"), "k")} AS type_name, 'field' || k AS name FROM p
  UNION ALL SELECT DISTINCT 'r' || p_size % 25, 's' || p_size || '.graphql', t.kind, t.letter || p_size, t.letter || p_size FROM p, (VALUES ('type', 'T'), ('input', 'I'), ('enum', 'E')) t(kind, letter))"""
_TRIGGERS = ("push", "push,pull_request", "schedule,release", "workflow_dispatch")
_CI = f"""ci AS (SELECT 'r' || c_nationkey AS repo, '.github/workflows/' || lower(c_mktsegment) || '.yml' AS file, 'j' || c_custkey AS job, {_case(("linux", "mac"), "c_custkey")} AS runs_on,
  CAST(least(c_custkey % 4, 3) AS INTEGER) AS steps_count, {_case(_TRIGGERS, "(c_nationkey + length(c_mktsegment))")} AS triggers,
  {_case(("", "uses: x@v1", "uses: x@v1,run: make", "uses: x@v1,run: make,n"), "c_custkey")} AS steps FROM customer)"""

# --- source lines --------------------------------------------------------------------------------------------------

_EXT = ("go", "rs", "py", "ts", "php", "sh")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, line_no, line): parts as definitions, each with a comment above and a brace below, in files by brand and language."""
    k = F.col("k").cast("string")
    comment = F.concat(F.when(F.col("k") % 6 == 2, "    # ").when(F.col("k") % 6 == 5, "# ").otherwise("// "), F.lit("makes "), "p_name")
    start = _pick(("func Sym", "pub struct Sym", "    def sym_", "export class Sym", "interface Sym", "function sym_"), F.col("k"))
    end = _pick(("(a int) {", " {", "(self):", " {", " {", " {"), F.col("k"))
    rows = _parts(spark, sf_dir).select(
        F.lit("r").alias("repo"),
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("."), _pick(_EXT, F.col("k"))).alias("path"),
        "k",
        F.concat(comment, F.lit("\n"), start, k, end, F.lit("\n}")).alias("block"),
    )
    return T.lines_of(_text(rows, ("repo", "path"), "k", F.col("block")), "content", "repo", "path")


def symbol_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.extract(_code(spark, sf_dir)).select("path", "line_no", "language", "name", "kind", "signature", "doc")


def symbol_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.symbol_documents(symbols.extract(_code(spark, sf_dir)), "path", "line_no")


def workspace_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.workspace_symbols(_code(spark, sf_dir), "YM_1").unionByName(symbols.workspace_symbols(_code(spark, sf_dir), "sym2"))


def syntax_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as classes and parts as methods of Python sources."""
    method = F.concat(F.lit("    def m_"), F.col("k").cast("string"), F.lit('(self):\n        "makes '), "p_name", F.lit('"'))
    found = _text(_parts(spark, sf_dir), ("p_brand",), "k", method)
    name = F.regexp_replace("p_brand", "#", "")
    sources = found.select(F.lit("r").alias("repo"), F.concat("p_brand", F.lit(".py")).alias("path"), F.concat(F.lit("class "), name, F.lit(":\n"), "content").alias("content"))
    return syntax.python_symbols(sources).select("path", "line_no", "end_line", "name", "kind", "doc", "inside")


def sample_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.sample_symbols(_code(spark, sf_dir))


def definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where "self" and "Sym6" stand by themselves on a line with a defining word."""
    code = _code(spark, sf_dir)
    found = symbols.references(code, "self").unionByName(symbols.references(code, "Sym6"))
    return symbols.definitions(found).select("path", "line_no", "col")


def identifier_under_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("line_no") % 15 + 1).cast("int")
    return _code(spark, sf_dir).select("path", "line_no", symbols.identifier_at(F.col("line"), at).alias("identifier"))


def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines: each with the two before and after it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), F.concat_ws(" ", "role", F.length("text")).alias("line"))
    return symbols.hover(turns).select(F.col("path").alias("conv_id"), F.col("line_no").alias("turn"), "context")


def intent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    lines = _parts(spark, sf_dir).select(F.concat(_pick(("// TODO: implement ", "# fixme implement ", "plain ", "  PLANNED "), F.col("k")), k, F.lit(" ")).alias("line"))
    branches = table(spark, sf_dir, "customer").select(F.concat(_pick(("feat/", "x/feat/", "fix/", "defeat/"), F.col("c_custkey")), F.col("c_custkey").cast("string")).alias("name"))
    commits = table(spark, sf_dir, "supplier").select(F.concat(_pick(("feat: ", "feat(api)!: ", "feature: ", "fix: "), F.col("s_suppkey")), F.col("s_suppkey").cast("string")).alias("subject"))
    return evolution.intents(lines, branches, commits)


_CODE = f"""{_P}, d AS (SELECT k, p_name, 'src/' || lower(replace(p_brand, '#', '')) || '.' || {_case(_EXT, "k")} AS path,
  {_case(("go", "rust", "python", "typescript", "php", "bash"), "k")} AS language, {_case(("function", "type", "method", "class", "type", "function"), "k")} AS kind,
  {_case(("Sym", "Sym", "sym_", "Sym", "Sym", "sym_"), "k")} || k AS name,
  {_case(("func ", "pub struct ", "    def ", "export class ", "interface ", "function "), "k")} AS lead, {_case(("(a int) {", " {", "(self):", " {", " {", " {"), "k")} AS tail FROM p),
c AS (SELECT *, CAST(3 * row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS line_no FROM d)"""

# --- tool output ---------------------------------------------------------------------------------------------------


def diff_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as diffs: of each part as many lines added as its line number says, and quantity modulo three removed."""
    items = table(spark, sf_dir, "lineitem").join(_parts(spark, sf_dir).select(F.col("k").alias("l_partkey"), F.concat("path", F.lit("_"), "k").alias("file")), "l_partkey")
    head = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n@@ -1 +1 @@\n same"))
    body = F.concat(F.repeat(F.lit("\n+new"), F.col("l_linenumber")), F.repeat(F.lit("\n-old"), (F.col("l_quantity") % 3).cast("int")))
    diffs = _text(items.withColumn("o", F.struct("l_linenumber", "file")), ("l_orderkey",), "o", F.concat(head, body))
    return summaries.diff_by_file(T.lines_of(diffs, "content", "l_orderkey").withColumnRenamed("l_orderkey", "source"))


def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tool, name, n): what short statuses, diff stats, branches, listings and package metadata of the parts amount to."""
    parts = _parts(spark, sf_dir)
    of = lambda line: parts.select(line.alias("line"))
    key = F.col("k").cast("string")
    status = summaries.status_counts(of(F.concat(_pick((" M ", "A  ", "?? ", "MM "), F.col("k")), "path")))
    stat = summaries.diff_stat(of(F.concat(F.lit(" "), "path", F.lit("_"), key, F.lit(" |  "), "p_size", F.lit(" +++--")))).agg(F.count("*").alias("files"), F.sum("changes").alias("n"))
    branches = summaries.branches(of(F.concat(F.when(F.col("k") == 3, "* ").otherwise("  "), F.lit("b"), key)))
    listing = summaries.listing(of(F.concat(F.when(F.col("k") % 5 == 0, "drwxr-xr-x").otherwise("-rw-r--r--"), F.lit(" 1 u g 0 x"))))
    package = F.to_json(F.struct(F.collect_list(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("1."), "p_size").alias("version"))).alias("packages")))
    found = parts.agg(package.alias("j")).select(F.explode(summaries.packages(F.col("j"))).alias("x"))
    rows = [
        status.select(F.lit("status").alias("tool"), F.col("code").alias("name"), F.col("files").alias("n")),
        stat.select(F.lit("diff_stat").alias("tool"), F.col("files").cast("string").alias("name"), "n"),
        branches.groupBy("current").agg(F.count("*").alias("n"), F.max("name").alias("name")).select(F.lit("branches").alias("tool"), F.when(F.col("current"), F.col("name")).otherwise("other").alias("name"), "n"),
        listing.select(F.lit("listing").alias("tool"), F.col("folders").cast("string").alias("name"), F.col("files").alias("n")),
        found.groupBy("x.version").agg(F.count("*").alias("n")).select(F.lit("packages").alias("tool"), F.col("version").alias("name"), "n"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def find_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.find_by_folder(_parts(spark, sf_dir).select(F.concat("path", F.lit("_"), "k").alias("line")))
    return found.withColumn("sample", F.array_join("sample", " "))


def compress_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of paths against its summary by folders, in bytes."""
    lines = _parts(spark, sf_dir).select(F.concat("path", F.lit("_"), "k").alias("line"))
    size = lambda c: F.sum(F.octet_length(c) + 1).alias("n")
    raw, short = lines.agg(size(F.col("line"))), summaries.find_by_folder(lines).agg(size(F.concat_ws(" ", "folder", "files", F.array_join("sample", " "))))
    both = raw.select(F.col("n").alias("raw_bytes")).crossJoin(F.broadcast(short.select(F.col("n").alias("compressed_bytes"))))  # one row each
    return both.withColumn("savings_pct", F.round(summaries.savings(F.col("raw_bytes"), F.col("compressed_bytes")), 6))


def test_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(_pick(("ok ", "FAILED ", "error: ", "thread panicked at ", "warning "), F.col("k")), F.col("k").cast("string"))
    lines = _parts(spark, sf_dir).select(F.col("k").alias("line_no"), line.alias("line"))
    end = lines.agg(F.max("line_no").alias("m")).select((F.col("m") + 1).alias("line_no"), F.concat(F.lit("test result: "), "m", F.lit(" passed")).alias("line"))
    return summaries.test_output(lines.unionByName(end))


def log_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.log_head(order_commits(spark, sf_dir).select(F.col("sha").alias("line_no"), F.concat_ws(" ", "sha", "subject").alias("line")))


# --- project facts -------------------------------------------------------------------------------------------------

#: Files of projects: path, content, and what they say as part:value.
_FILES = (
    ("Cargo.toml", "[workspace]\ntokio = 1", ("stack:Rust", "framework:cargo test", "variant:Rust/tokio", "variant:Rust/workspace", "server:rust-analyzer", "command:cargo build", "command:cargo test")),
    ("api/go.mod", "module x", ("stack:Go", "framework:go test", "server:gopls", "command:go build ./...", "command:go test ./...")),
    ("package.json", '{"jest": 1, "express": 2}', ("stack:Node", "framework:jest", "variant:Node/Express", "server:typescript-language-server", "command:npm install", "command:npm test")),
    ("svc/pyproject.toml", "fastapi", ("stack:Python", "variant:Python/FastAPI", "server:pyright", "command:pytest")),
    ("a/b/composer.json", "{}", ("server:intelephense",)),
    ("src/main.rs", "fn main() {}", ("variant:Rust/binary",)),
    ("src/app.jl", "x", ()),
    ("conftest.py", "", ("framework:pytest",)),
)


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content): nations as repositories, each with two thirds of the files."""
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("path"), F.lit(c).alias("content")) for i, (p, c, _) in enumerate(_FILES)])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(every).alias("f")).where((F.col("n_nationkey") + F.col("f.i")) % 3 != 0)
    return rows.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repo"), "f.path", "f.content")


def project_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, stacks = _projects(spark, sf_dir), project.stacks(_projects(spark, sf_dir))
    part = lambda df, name, value: df.select("repo", F.lit(name).alias("part"), value.alias("value"))
    out = part(stacks, "stack", F.col("stack"))
    out = out.unionByName(part(project.variants(found), "variant", F.concat_ws("/", "stack", "variant")))
    out = out.unionByName(part(project.test_framework(found), "framework", F.col("framework")))
    out = out.unionByName(part(project.servers(found), "server", F.col("server")))
    return out.unionByName(part(project.commands(stacks), "command", F.col("command")))


def language_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.stacks_by_extension(_projects(spark, sf_dir)).select("repo", "stack", F.round("confidence", 6).alias("confidence"))


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.entry_points(_projects(spark, sf_dir).select(F.concat_ws("/", "repo", "path").alias("path")))


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.tree(_parts(spark, sf_dir))


def glance_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 20).cast("string")).alias("path"), F.col("user_id").alias("author"), F.col("ts").alias("at"))
    found = project.glance(_projects(spark, sf_dir), touches)
    rows = [found[k].select(F.lit(k).alias("part"), F.col(c).cast("string").alias("name"), "commits") for k, c in (("hot_files", "path"), ("active_authors", "author"))]
    return rows[0].unionByName(rows[1])


def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind front matter and a comment: their first 100 bytes, and the excerpt without both."""
    whole = F.concat(F.lit("---\nid: 1\n---\n<!-- note -->"), "text")
    docs = texts(spark, sf_dir, "doc_id", "text").where("text is not null")
    return docs.select("doc_id", project.cut_bytes(F.col("text"), 100).alias("start"), project.excerpt(whole).alias("excerpt"))


def frontmatter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    key = F.when(k % 3 == 0, F.concat(F.lit("id: "), k.cast("string"), F.lit("\n"))).when(k % 3 == 1, "id: none\n").otherwise("")
    date = F.when(k % 4 == 0, "created: 2024-01-02\n").when(k % 4 == 1, "created: today\n").otherwise("")
    title = F.when(k % 2 == 0, "title: x y \n").otherwise("")
    content = F.concat(F.lit("---\n"), key, date, title, F.lit("other: 1\n---\n# Head\nid: 5\n"))
    docs = table(spark, sf_dir, "documents").select(k.alias("path"), content.alias("content"))
    return project.frontmatter_errors(docs, {"id": "int", "created": "date", "title": "string"})


def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a.md"), F.lit("INDEX.md"))).otherwise(F.array(F.lit("b.md"), F.lit("a.md"), F.lit("c.txt")))
    rows = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("number"), F.lower("n_name").alias("name"), F.explode(names).alias("file"))
    found = repository.sections(rows.select(F.concat("number", F.lit("-"), "name", F.lit("/"), "file").alias("path"), F.lit("x").alias("content")))
    return found.select("number", "name", "file")


def path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = new_folder(spark, "paths")
    _parts(spark, sf_dir).select(F.concat(F.when(F.col("k") % 7 == 0, F.lit("\n  ")).otherwise(""), "path").alias("value")).write.text(place)
    return repository.path_list(spark, place)


def path_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _parts(spark, sf_dir).select("k", paths.matches(p, "src").alias("below"), paths.matches(p, "*_test.go").alias("test"), paths.matches(p, "lib/brand?/*").alias("library"), paths.matches(p, "docs/brand1/").alias("docs"))


# --- watching, activity, derived facts -----------------------------------------------------------------------------


def watch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("event_type", _pick((".go", ".md", ".py", "/dist/a.go"), F.col("event_id")))
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), path.alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    found = watch.batches(events, "2 hours")
    return found.select("repo", F.col("started").cast("timestamp_ntz").alias("started"), F.array_join("affected_paths", ",").alias("paths"), F.array_join("languages", ",").alias("languages"), "event_count")


def reuse_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    items = _parts(spark, sf_dir).select(k.alias("doc_id"), _pick(("auth", "crypto", "hook"), k).alias("category"), (k % 17).alias("uses"), (k % 31).alias("changed_at"))
    found = search.reuse(items, _parts(spark, sf_dir).select(k.alias("doc_id"), (F.col("p_size") / 8).alias("score")), "auth").limit(100)
    return found.select("doc_id", "category", "score", "uses", "same")


def file_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_shipdate").alias("changed_at"))
    found = _parts(spark, sf_dir).join(last, "k").select(F.col("p_brand").alias("category"), F.concat("path", F.lit("_"), "k").alias("path"), F.col("p_size").alias("lines"), "changed_at", paths.is_test(F.col("path")).alias("is_test"))
    return activity.samples(found, F.lit("2001-10-20").cast("timestamp_ntz"))


def risk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part paths with all six parts of their risk."""
    # paths are written once with a number each, by which all is joined and grouped
    named = _parts(spark, sf_dir).select("path").distinct().withColumn("test", paths.is_test(F.col("path")))
    named = graph.checkpoint(named.withColumn("file", F.monotonically_increasing_id()))
    parts = _parts(spark, sf_dir).join(named, "path").select("k", F.col("file").alias("path"), "test")
    items = table(spark, sf_dir, "lineitem").join(parts.withColumnRenamed("k", "l_partkey"), "l_partkey")
    lines = parts.select("path", F.lit(1).alias("line_no"), _pick(("// TODO a", "x", "FIXME HACK", "y", "z", "it.skip("), F.col("k")).alias("line"))
    found = knowledge.risk(
        named.select(F.col("file").alias("path")),
        quality.flaky(order_commits(spark, sf_dir), items.select(F.col("l_orderkey").alias("sha"), F.col("path").alias("file"), "test")).withColumnRenamed("file", "path"),
        quality.untested(named.where("not test").select("path", "file"), named.where("test").select("path")).select(F.col("file").alias("path")),
        evolution.debt(lines),
        activity.zones(items.select("path", F.col("l_shipdate").alias("at")), F.lit("2001-06-01").cast("timestamp_ntz"), hot_days=60, hot_commits=2),
        activity.owners(items.select("path", F.col("l_suppkey").alias("author"))),
        parts.where("k % 9 = 0").select("path"),
    )
    columns = [c for c in found.columns if c != "path"]
    return found.withColumnRenamed("path", "file").join(named.select("file", "path"), "file").select("path", *columns).withColumn("fragile", F.round("fragile", 6))


def feature_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("verdict", _pick(("IMPLEMENTED", "DRIFTED", "SPEC_ONLY"), F.col("doc_id") + F.col("quality")))
    return knowledge.breakdown(rows)


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each benchmark text, from a written index."""
    place = new_folder(spark, "index")
    search.write_index(texts(spark, sf_dir, "doc_id", "text"), place)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = search.search_index(spark.read.parquet(f"{place}/postings"), spark.read.parquet(f"{place}/lengths"), asked).withColumn("score", F.round("score", 6))
    return search.top(found, 5, "query_id").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def cochange_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(_touched(spark, sf_dir))


def _ranked(name: str, key: str, query) -> object:
    """A query: the rows of another as a part of a report shows them."""
    return lambda spark, sf_dir: report.part(name, key, query(spark, sf_dir))


#: Parts of reports: the report, the part, and the query and the order in SQL.
_RANKED = {
    "coverage_worst": ("coverage", "files", fact_queries, "coverage_files", "percent, path LIMIT 20"),
    "replacements_top": ("replacements", "replacements", fact_queries, "replacement_pairs", "confidence DESC, removed, added, sha LIMIT 50"),
    "unreleased_top": ("unreleased", "authors", fact_queries, "unreleased", "commits DESC, author LIMIT 50"),
    "contract_changes": ("contract_diff", "changes", fact_queries, "contract_diff", "method, path LIMIT 500"),
    "cochange_top": ("cochange", "pairs", search_queries, "cochange_pairs", "ratio DESC, shared DESC, file_a, file_b LIMIT 100"),
    "clusters_top": ("cochange", "clusters", search_queries, "cochange_clusters", "size DESC, component LIMIT 50"),
}


def humanized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as times and sizes, order dates as ages, for readers."""
    price = F.col("o_totalprice")
    ms, size = F.floor(price * price / 1000).cast("long"), F.floor(price * price / 3).cast("long")
    age = display.humanize_age(F.col("o_orderdate"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", display.humanize_ms(ms).alias("took"), display.humanize_bytes(size).alias("size"), age.alias("age"))


def vector_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as bytes and read back: how many numbers, how many bytes, the first and the last number."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    sizes = vectors.to_bytes(rows, "v").select("vec_id", "v", F.octet_length("v").cast("long").alias("bytes"))
    back = vectors.from_bytes(sizes, "v")
    one = lambda i: F.round(F.element_at("v", i).cast("double"), 5)
    return back.select("vec_id", "bytes", F.size("v").cast("long").alias("n"), one(1).alias("first"), one(-1).alias("last"))


def hash_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.totals(files.hashes(texts(spark, sf_dir, "doc_id", "text"), "text", "doc_id"))


QUERIES = {
    f.__name__: f
    for f in (
        log_files, log_status, renamed_files, reachable_releases, unreleased_files, changelog_match, lcov_lines, cobertura_lines, jacoco_lines,
        go_blocks, jest_files, openapi_endpoints, protobuf_calls, graphql_fields, contract_counts, dedup_entities_union, endpoint_status,
        snapshot_endpoints, ci_jobs, trigger_summary, symbol_list, symbol_documents, workspace_symbols, sample_symbols, definition_lines,
        identifier_under_cursor, conversation_context, intent_list, diff_by_file, tool_counts, find_by_folder, compress_savings, test_triage,
        log_head, project_facts, language_shares, entry_points, tree_paths, glance_lists, text_excerpts, frontmatter_errors, numbered_sections,
        path_list, path_matches, watch_batches, reuse_ranking, file_samples, risk_rollup, feature_breakdown, index_search, hash_totals,
        humanized, vector_bytes, syntax_symbols, cochange_stats,
    )
} | {k: _ranked(name, key, module.QUERIES[q]) for k, (name, key, module, q, _) in _RANKED.items()}
QUERIES["cochange_top"] = _ranked("cochange", "pairs", search_queries.cochange_best)  # the same rows, without writing all pairs out

_STEM = r"lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1'))"
_TEST_SQL = (
    "(regexp_matches(lower(path), '/(test|tests|__tests__|spec)/') OR regexp_matches(lower(path), '^(test|tests|spec)/') OR "
    "regexp_matches(lower(path), '(_test[.](go|py|rs)|[.](test|spec)[.](ts|tsx|js|jsx)|_spec[.]rb)$') OR regexp_matches(lower(path), '(^|/)test_[^/]*$'))"
)
_EXCLUDE_SQL = " OR ".join(
    f"contains(file, '{p[:-1]}')" if p.endswith("/") else f"ends_with(file, '{p[1:]}')" if p.startswith("*") else f"contains(file, '{p}')" for p in paths.DEFAULT_EXCLUDES
)
_FACTS = ", ".join(f"({i}, '{f.split(':', 1)[0]}', '{f.split(':', 1)[1]}')" for i, (_, _, facts) in enumerate(_FILES) for f in facts)
_FLAKY_WORDS = "|".join(T.FLAKY_WORDS)
SQL = {
    "log_files": f"WITH {_TOUCHED} SELECT repo, sha, file FROM f",
    "log_status": f"""WITH {_TOUCHED} SELECT sha, author, made_at, subject, 'body of ' || sha AS body, file, CASE line % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'M' ELSE 'D' END AS status,
  CASE line % 5 WHEN 0 THEN 'old/' || file END AS renamed_from FROM f WHERE line % 5 <> 4""",
    "renamed_files": "WITH m AS (SELECT max(c_custkey) AS top FROM customer) SELECT c_custkey - 40 AS old, c_custkey + 40 * ((top - c_custkey) // 40) AS new FROM customer, m WHERE c_custkey >= 40",
    "reachable_releases": """WITH c AS (SELECT c_custkey % 10 AS r, c_custkey AS k, c_custkey % 7 <> 3 AS main FROM customer),
t AS (SELECT r, k FROM c WHERE main AND k % 130 < 10 AND k >= 130)
SELECT 'r' || c.r AS repo, CAST(c.k AS VARCHAR) AS sha, 'v1.' || min(t.k) AS tag FROM c JOIN t ON t.r = c.r AND t.k >= c.k WHERE main GROUP BY c.r, c.k""",
    "unreleased_files": f"""WITH {TAGS_SQL}, c AS (SELECT o_orderkey AS sha FROM orders WHERE NOT EXISTS (SELECT 1 FROM tags WHERE tagged_at >= o_orderdate))
SELECT l_partkey AS file, count(DISTINCT sha) AS touches FROM lineitem JOIN c ON sha = l_orderkey GROUP BY 1""",
    "changelog_match": f"WITH {TAGS_SQL} SELECT tag, CASE WHEN CAST(split_part(tag, '.', 2) AS INTEGER) % 2 = 1 THEN substr(tag, 2) END AS changelog_entry FROM tags",
    "lcov_lines": f"WITH {_COV} SELECT report, path, CAST(line AS INTEGER) AS line, hits FROM cov",
    "cobertura_lines": f"WITH {_COV} SELECT report, path, CAST(line AS INTEGER) AS line, hits FROM cov",
    "jacoco_lines": f"WITH {_COV} SELECT report, 'com/acme/' || path || '.java' AS path, CAST(line AS INTEGER) AS line, hits FROM cov",
    "go_blocks": f"WITH {_COV} SELECT report, path, CAST(line AS INTEGER) AS line, hits FROM cov",
    "jest_files": f"WITH {_COV} SELECT report, path, count(*) AS lines_total, count(*) FILTER (hits > 0) AS lines_covered, round(100.0 * count(*) FILTER (hits > 0) / count(*), 2) AS percent FROM cov GROUP BY report, path",
    "openapi_endpoints": f"WITH {_CONTRACTS} SELECT repo, path, method, operation_id, summary, tags FROM ep",
    "snapshot_endpoints": f"WITH {_CONTRACTS} SELECT repo, 'docs/openapi.json' AS spec_file, path, method, operation_id, summary, tags FROM ep",
    "protobuf_calls": f"WITH {_CONTRACTS} SELECT * FROM rpc",
    "graphql_fields": f"WITH {_CONTRACTS} SELECT * FROM gql",
    "contract_counts": f"""WITH {_CONTRACTS}, e AS (SELECT repo, count(*) AS endpoints FROM ep GROUP BY 1),
r AS (SELECT repo, count(DISTINCT (file, service)) AS services, count(*) AS rpcs, count(DISTINCT (file, service)) AS messages FROM rpc GROUP BY 1),
g AS (SELECT repo, count(*) FILTER (kind = 'operation') AS operations, count(*) FILTER (kind <> 'operation') AS types FROM gql GROUP BY 1)
SELECT repo, coalesce(endpoints, 0) AS endpoints, coalesce(services, 0) AS services, coalesce(rpcs, 0) AS rpcs, coalesce(messages, 0) AS messages, coalesce(operations, 0) AS operations, coalesce(types, 0) AS types
FROM e FULL JOIN r USING (repo) FULL JOIN g USING (repo)""",
    "dedup_entities_union": f"""WITH {_CONTRACTS} SELECT operation_id AS identifier, 'openapi' AS source_kind, path, method, 1 AS mentions FROM ep
UNION ALL SELECT rpc, 'protobuf', NULL, NULL, 1 FROM rpc UNION ALL SELECT name, 'graphql', NULL, NULL, 1 FROM gql WHERE kind = 'operation'""",
    "endpoint_status": f"WITH {_CONTRACTS} SELECT repo, path, CASE WHEN k % 3 = 2 THEN '?' ELSE {_case(('PHANTOM', 'CANDIDATE', 'IMPLEMENTED', 'PHANTOM'), 'k')} END AS status FROM ep",
    "ci_jobs": f"WITH {_CI} SELECT * FROM ci",
    "trigger_summary": f"""WITH {_CI} SELECT repo, bool_or(contains(triggers, 'push')) AS on_push, bool_or(contains(triggers, 'pull_request')) AS on_pull_request, bool_or(contains(triggers, 'schedule')) AS on_schedule,
  bool_or(triggers = 'workflow_dispatch') AS on_manual, CASE WHEN bool_or(contains(triggers, 'release')) THEN 'release' ELSE '' END AS on_other, count(DISTINCT job) AS jobs FROM ci GROUP BY repo""",
    "symbol_list": f"WITH {_CODE} SELECT path, line_no, language, name, kind, trim(lead || substr(name, length(name) - length(regexp_extract(name, '(Sym|sym_)[0-9]+$')) + 1) || tail) AS signature, 'makes ' || p_name AS doc FROM c",
    "symbol_documents": f"WITH {_CODE} SELECT path, line_no, name || ' ' || path || ' makes ' || p_name AS text, name || chr(10) || trim(lead || name || tail) || chr(10) || 'makes ' || p_name AS embedding_text FROM c",
    "workspace_symbols": f"""WITH {_CODE}, w AS (SELECT path, line_no, CASE split_part(trim(lead), ' ', -1) WHEN 'func' THEN 'function' WHEN 'struct' THEN 'struct' WHEN 'def' THEN 'function' WHEN 'class' THEN 'class' WHEN 'interface' THEN 'interface' ELSE 'function' END AS kind, name FROM c)
SELECT * FROM w WHERE contains(lower(name), 'ym_1') UNION ALL SELECT * FROM w WHERE contains(lower(name), 'sym2')""",
    "sample_symbols": f"WITH {_CODE} SELECT path, line_no, name FROM c WHERE line_no <= 500 ORDER BY path, line_no LIMIT 25",
    "definition_lines": f"""WITH {_CODE}, l AS (SELECT path, line_no, lead || name || tail AS line, name, k FROM c)
SELECT path, line_no, CAST(strpos(line, '(self)') + 1 AS BIGINT) AS col FROM l WHERE k % 6 = 2 UNION ALL SELECT path, line_no, CAST(strpos(line, 'Sym6') AS BIGINT) FROM l WHERE name = 'Sym6'""",
    "identifier_under_cursor": f"""WITH {_CODE}, l AS (SELECT path, line_no - 1 AS line_no, CASE k % 6 WHEN 2 THEN '    # ' WHEN 5 THEN '# ' ELSE '// ' END || 'makes ' || p_name AS line FROM c
  UNION ALL SELECT path, line_no, lead || name || tail FROM c UNION ALL SELECT path, line_no + 1, '}}' FROM c)
SELECT path, line_no, regexp_extract(substr(line, 1, line_no % 15), '([A-Za-z0-9_]*)$', 1) || regexp_extract(substr(line, line_no % 15 + 1), '^([A-Za-z0-9_]*)', 1) AS identifier FROM l""",
    "conversation_context": """SELECT conv_id, turn, array_to_string(list(concat_ws(' ', role, length(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS context FROM conversations""",
    "intent_list": f"""WITH {_P} SELECT 'comment' AS source, CASE k % 4 WHEN 0 THEN '// TODO: implement ' WHEN 1 THEN '# fixme implement ' ELSE 'PLANNED ' END || k AS text FROM p WHERE k % 4 <> 2
UNION ALL SELECT 'branch', CASE c_custkey % 4 WHEN 0 THEN 'feat/' ELSE 'x/feat/' END || c_custkey FROM customer WHERE c_custkey % 4 < 2
UNION ALL SELECT 'commit', CASE s_suppkey % 4 WHEN 0 THEN 'feat: ' ELSE 'feat(api)!: ' END || s_suppkey FROM supplier WHERE s_suppkey % 4 < 2""",
    "diff_by_file": f"WITH {_P} SELECT path || '_' || k AS file, CAST(sum(l_linenumber) AS BIGINT) AS added, CAST(sum(CAST(l_quantity AS BIGINT) % 3) AS BIGINT) AS removed FROM lineitem JOIN p ON k = l_partkey GROUP BY 1",
    "tool_counts": f"""WITH {_P} SELECT 'status' AS tool, {_case(('M', 'A', '??', 'MM'), 'k')} AS name, count(*) AS n FROM p GROUP BY 2
UNION ALL SELECT 'diff_stat', CAST(count(*) AS VARCHAR), CAST(sum(p_size) AS BIGINT) FROM p UNION ALL SELECT 'branches', CASE WHEN k = 3 THEN 'b3' ELSE 'other' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'listing', CAST(count(*) FILTER (k % 5 = 0) AS VARCHAR), count(*) FILTER (k % 5 <> 0) FROM p UNION ALL SELECT 'packages', '1.' || p_size, count(*) FROM p GROUP BY 2""",
    "find_by_folder": f"""WITH {_P}, l AS (SELECT path || '_' || k AS line, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM p)
SELECT folder, count(*) AS files, array_to_string(list_sort(list(line))[1:3], ' ') AS sample FROM l GROUP BY folder ORDER BY files DESC, folder LIMIT 20""",
    "compress_savings": f"""WITH {_P}, l AS (SELECT path || '_' || k AS line, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM p),
s AS (SELECT concat_ws(' ', folder, count(*), array_to_string(list_sort(list(line))[1:3], ' ')) AS s FROM l GROUP BY folder ORDER BY count(*) DESC, folder LIMIT 20),
n AS (SELECT (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) FROM l) AS raw_bytes, (SELECT CAST(sum(strlen(s) + 1) AS BIGINT) FROM s) AS compressed_bytes)
SELECT *, round((1 - compressed_bytes / raw_bytes) * 100, 6) AS savings_pct FROM n""",
    "test_triage": f"""WITH {_P}, l AS (SELECT k, {_case(('ok ', 'FAILED ', 'error: ', 'thread panicked at ', 'warning '), 'k')} || k AS line, CASE k % 5 WHEN 1 THEN 'failure' WHEN 3 THEN 'failure' WHEN 2 THEN 'error' END AS kind FROM p)
SELECT kind, line FROM l WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY k) <= 20 UNION ALL SELECT 'summary', 'test result: ' || max(k) || ' passed' FROM p""",
    "log_head": f"SELECT o_orderkey || ' ' || {SUBJECT_SQL} AS line, greatest((SELECT count(*) FROM orders) - 15, 0) AS earlier FROM orders ORDER BY o_orderkey LIMIT 15",
    "project_facts": f"WITH k(i, part, value) AS (VALUES {_FACTS}) SELECT DISTINCT 'r' || n_nationkey AS repo, part, value FROM nation JOIN k ON (n_nationkey + i) % 3 <> 0",
    "language_shares": f"""WITH f AS (SELECT n_nationkey AS k, i FROM nation, range({len(_FILES)}) t(i) WHERE (n_nationkey + i) % 3 <> 0)
SELECT 'r' || k AS repo, 'Julia' AS stack, round(least(0.7, 1.0 / count(*)), 6) AS confidence FROM f GROUP BY k HAVING bool_or(i = 6)""",
    "entry_points": "SELECT 'r' || n_nationkey || '/src/main.rs' AS path FROM nation WHERE (n_nationkey + 5) % 3 <> 0 ORDER BY 1 LIMIT 10",
    "tree_paths": f"""WITH {_P}, s AS (SELECT string_split(path, '/') AS s FROM p) SELECT DISTINCT array_to_string(s[1:i], '/') AS path FROM s, range(1, 4) t(i) WHERE i <= len(s) ORDER BY 1 LIMIT 200""",
    "glance_lists": """(SELECT 'hot_files' AS part, event_type || '/' || user_id % 20 AS name, count(*) AS commits FROM events GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL (SELECT 'active_authors', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id ORDER BY 3 DESC, user_id LIMIT 5)""",
    "text_excerpts": """SELECT doc_id, substr(text, 1, coalesce(list_max(list_filter(range(0, 101), lambda n: strlen(substr(text, 1, n)) <= 100)), 0)) AS start, substr(trim(text), 1, 400) AS excerpt FROM documents WHERE text IS NOT NULL""",
    "frontmatter_errors": """SELECT doc_id AS path, 'id' AS key, CASE doc_id % 3 WHEN 1 THEN 'not int' ELSE 'missing' END AS error FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'created', CASE doc_id % 4 WHEN 1 THEN 'not date' ELSE 'missing' END FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'title', 'missing' FROM documents WHERE doc_id % 2 <> 0""",
    "numbered_sections": "SELECT n_nationkey AS number, lower(n_name) AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'INDEX.md' ELSE 'a.md' END AS file FROM nation",
    "path_list": f"WITH {_P} SELECT path FROM p",
    "path_matches": f"WITH {_P} SELECT k, starts_with(path, 'src/') AS below, ends_with(path, '_test.go') AS test, regexp_matches(path, '^lib/brand./') AS library, starts_with(path, 'docs/brand1/') AS docs FROM p",
    "watch_batches": """WITH e AS (SELECT user_id, ts, CASE event_id % 4 WHEN 0 THEN event_type || '.go' WHEN 2 THEN event_type || '.py' END AS path, CASE event_id % 4 WHEN 0 THEN 'go' WHEN 2 THEN 'python' END AS lang FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS s FROM e),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT CAST(user_id AS VARCHAR) AS repo, min(ts) AS started, string_agg(DISTINCT path, ',' ORDER BY path) AS paths, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) AS event_count FROM n GROUP BY user_id, b HAVING count(path) > 0""",
    "reuse_ranking": f"""WITH {_P} SELECT k AS doc_id, {_case(('auth', 'crypto', 'hook'), 'k')} AS category, p_size / 8 AS score, k % 17 AS uses, k % 3 = 0 AS same FROM p WHERE p_size / 8 >= 3
ORDER BY same DESC, score DESC, uses DESC, k % 31 DESC, k LIMIT 100""",
    "file_samples": f"""WITH {_P}, m AS (SELECT l_partkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
f AS (SELECT p_brand AS category, path || '_' || k AS path, p_size AS lines, shipped, {_TEST_SQL} AS test FROM p JOIN m ON l_partkey = k),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY lines DESC, path) <= 10 AS long, shipped >= TIMESTAMP '2001-10-20' - INTERVAL 30 DAYS
  AND row_number() OVER (PARTITION BY category ORDER BY shipped DESC, path) <= 5 AS new, test AND row_number() OVER (PARTITION BY category, test, regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY path) <= 3 AS few FROM f)
SELECT category, path FROM r WHERE long OR new OR few QUALIFY row_number() OVER (PARTITION BY category ORDER BY long DESC, new DESC, path) <= 50""",
    "risk_rollup": f"""WITH {_P}, i AS (SELECT l_orderkey AS sha, l_suppkey AS author, l_shipdate AS shipped, path FROM lineitem JOIN p ON k = l_partkey),
x AS (SELECT DISTINCT sha, path, {_TEST_SQL} AS test FROM i), o AS (SELECT sha, bool_and(test) AS alone FROM x GROUP BY sha),
c AS (SELECT o_orderkey AS sha, regexp_matches(lower({SUBJECT_SQL}), '{_FLAKY_WORDS}') AS s, regexp_matches(lower({SUBJECT_SQL}), 'reverts? ') AS r FROM orders),
n AS (SELECT path, count(*) FILTER (alone) AS isolated, count(*) FILTER (s) AS s, count(*) FILTER (r) AS r FROM x JOIN o USING (sha) JOIN c USING (sha) WHERE test GROUP BY path),
fr AS (SELECT path, least(s * 0.5 + r * 0.7 + CASE WHEN isolated >= 3 THEN least((isolated - 2) * 0.15, 0.6) ELSE 0 END, 2)::DOUBLE AS fragile FROM n WHERE s * 0.5 + r * 0.7 + CASE WHEN isolated >= 3 THEN least((isolated - 2) * 0.15, 0.6) ELSE 0 END >= 0.2),
e AS (SELECT DISTINCT path, {_STEM} AS stem, {_TEST_SQL} AS test FROM p),
un AS (SELECT path FROM e WHERE NOT test AND stem NOT IN (SELECT regexp_replace(regexp_replace(stem, '^test_', ''), '(_test|_spec|[.]test|[.]spec)$', '') FROM e WHERE test)),
de AS (SELECT path, CAST(sum(CASE k % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 1 ELSE 0 END) AS BIGINT) AS debt FROM p GROUP BY path),
zo AS (SELECT path, CASE WHEN count(*) FILTER (shipped >= TIMESTAMP '2001-06-01' - INTERVAL 60 DAYS) >= 2 THEN 'hot' WHEN max(shipped) < TIMESTAMP '2001-06-01' - INTERVAL 180 DAYS THEN 'frozen' ELSE 'normal' END AS zone FROM i GROUP BY path),
a AS (SELECT path, author, count(*) AS n FROM i GROUP BY ALL), ow AS (SELECT path, arg_min(author, (-n, author)) AS owner, NOT (count(*) > 10 AND max(n) / sum(n) < 0.3) AS clear_owner FROM a GROUP BY path),
dr AS (SELECT path, count(*) AS drifted FROM p WHERE k % 9 = 0 GROUP BY path),
j AS (SELECT e.path, round(coalesce(fragile, 0), 6) AS fragile, un.path IS NOT NULL AS untested, coalesce(debt, 0) AS debt, zone, owner, clear_owner, coalesce(drifted, 0) AS drifted
  FROM e LEFT JOIN fr USING (path) LEFT JOIN un ON un.path = e.path LEFT JOIN de ON de.path = e.path LEFT JOIN zo ON zo.path = e.path LEFT JOIN ow ON ow.path = e.path LEFT JOIN dr ON dr.path = e.path)
SELECT *, (fragile > 0)::INT + untested::INT + (debt > 0)::INT + coalesce(zone = 'hot', false)::INT + (NOT coalesce(clear_owner, false))::INT + (drifted > 0)::INT AS signals FROM j""",
    "index_search": search_queries.SQL["bm25_multi_query"],
    "feature_breakdown": f"SELECT {_case(('IMPLEMENTED', 'DRIFTED', 'SPEC_ONLY'), '(doc_id + quality)')} AS verdict, count(*) AS features FROM labels GROUP BY 1",
    "humanized": """WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_totalprice / 1000) AS BIGINT) AS ms, CAST(floor(o_totalprice * o_totalprice / 3) AS BIGINT) AS b, date_diff('second', o_orderdate, TIMESTAMP '2001-01-01') AS s FROM orders)
SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000) ELSE (ms // 60000) || 'm' || (ms // 1000 % 60) || 's' END AS took,
CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024) WHEN b < 1073741824 THEN printf('%.1fMB', b / 1048576) ELSE printf('%.1fGB', b / 1073741824) END AS size,
CASE WHEN s < 0 THEN NULL WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM o""",
    "vector_bytes": "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS bytes, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(embedding[-1] AS DOUBLE), 5) AS last FROM embeddings WHERE embedding IS NOT NULL",
    "syntax_symbols": f"""WITH {_P}, c AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY p_brand ORDER BY k) AS INTEGER) AS line_no FROM p)
SELECT p_brand || '.py' AS path, line_no, line_no + 1 AS end_line, 'm_' || k AS name, 'method' AS kind, 'makes ' || p_name AS doc, replace(p_brand, '#', '') AS inside FROM c
UNION ALL SELECT p_brand || '.py', 1, CAST(1 + 2 * count(*) AS INTEGER), replace(p_brand, '#', ''), 'class', NULL, '' FROM p GROUP BY p_brand""",
    "cochange_stats": f"""WITH {_TOUCHED} SELECT count(DISTINCT sha) AS commits, count(DISTINCT CASE WHEN NOT ({_EXCLUDE_SQL}) THEN file END) AS files_analyzed FROM f""",
    "hash_totals": "SELECT count(*) AS files, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS total_bytes FROM documents WHERE text IS NOT NULL",
}
SQL |= {k: f"SELECT * FROM ({module.SQL[q]}) ORDER BY {order}" for k, (_, _, module, q, order) in _RANKED.items()}
