"""Queries of quality, releases, contracts, evolution, activity and derived facts over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions import text as T
from codestrata.operators import activity, contracts, evolution, files, knowledge, quality, releases
from codestrata.streaming import watch

from .adapters import PATH_SQL, SUBJECT_SQL, TAGS_SQL, order_commits, part_path, release_tags, table, texts

# --- coverage ------------------------------------------------------------------------------------------------------


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, path, line, hits): brands as files, shipping days as lines, covered where goods came back or not."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path")), F.col("l_partkey") == F.col("p_partkey"))
    line = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return items.groupBy(F.col("l_linestatus").alias("report"), "path", line.alias("line")).agg(F.count_if(F.col("l_returnflag") != "N").alias("hits"))


def coverage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _coverage(spark, sf_dir).groupBy("path", "line").agg(F.sum("hits").alias("hits"))
    return quality.file_coverage(lines).withColumn("percent", F.round("percent", 6))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.file_coverage(_coverage(spark, sf_dir), "report")


def coverage_best_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.best_report(_reports(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


def coverage_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overall(quality.best_report(_reports(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


def uncovered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _coverage(spark, sf_dir).groupBy("path", "line").agg(F.sum("hits").alias("hits"))
    return quality.ranges(lines.where("hits = 0"))


_COV = """cov AS (SELECT l_linestatus AS report, p_brand AS path, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS line,
  count(*) FILTER (l_returnflag <> 'N') AS hits FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
one AS (SELECT path, line, sum(hits) AS hits FROM cov GROUP BY ALL),
rep AS (SELECT report, path, count(*) AS lines_total, count(*) FILTER (hits > 0) AS lines_covered, 100.0 * count(*) FILTER (hits > 0) / count(*) AS percent FROM cov GROUP BY ALL),
best AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY path ORDER BY percent DESC, report) = 1)"""

# --- paths ---------------------------------------------------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", part_path().alias("path"))


def is_test_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).withColumn("is_test", paths.is_test(F.col("path")))


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).withColumn("language", paths.language(F.col("path")))


def path_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select(
        "p_partkey", paths.excluded(p, paths.excludes(("docs/", "*.lock"))).alias("excluded"), paths.skipped_anywhere(p).alias("skipped"), paths.in_folder(p).alias("pruned"), paths.skipped_by_search(p).alias("unsearched")
    )


_EXCLUDE_SQL = " OR ".join(
    f"contains(path, '{p[:-1]}')" if p.endswith("/") else f"ends_with(path, '{p[1:]}')" if p.startswith("*") else f"contains(path, '{p}')" for p in (*paths.DEFAULT_EXCLUDES, "docs/")
)
_SKIP_SQL = " OR ".join(f"contains(path, '{p}')" for p in paths.SKIPPED_PARTS)
_PRUNE_SQL = "list_has_any(string_split(path, '/'), [" + ", ".join(f"'{p}'" for p in paths.SKIPPED_PARTS) + "])"
_SEARCH_SQL = " OR ".join([*(f"contains(path, '{p}')" for p in paths.GREP_SKIPPED), *(f"ends_with(path, '{p}')" for p in paths.GREP_SKIPPED_ENDS)])
_TEST_SQL = (
    "(regexp_matches(lower(path), '/(test|tests|__tests__|spec)/') OR regexp_matches(lower(path), '^(test|tests|spec)/') OR "
    "regexp_matches(lower(path), '(_test[.](go|py|rs)|[.](test|spec)[.](ts|tsx|js|jsx)|_spec[.]rb)$') OR regexp_matches(lower(path), '(^|/)test_[^/]*$'))"
)
_P = f"p AS (SELECT p_partkey, {PATH_SQL} AS path FROM part)"
_LANG_SQL = "CASE regexp_extract(path, '[^/]+[.]([^./]*)$', 1) " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in paths.LANGUAGES.items()) + " END"

# --- flaky tests, untested files, risk -----------------------------------------------------------------------------


def _order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, file): the parts of an order as the files of a commit."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey")
    return items.join(_paths(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")).select("sha", F.col("path").alias("file"))


def flaky_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.flaky(order_commits(spark, sf_dir), _order_files(spark, sf_dir))
    top = found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), F.desc("total"), "file").limit(50)
    return top.withColumn("signals", F.array_join("signals", ","))


def untested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _paths(spark, sf_dir).select("path").distinct().withColumn("test", paths.is_test(F.col("path")))
    return quality.untested(every.where("not test").select("path"), every.where("test").select("path"))


_FLAKY_WORDS = "|".join(T.FLAKY_WORDS)
_STEM = r"lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1'))"

# --- releases ------------------------------------------------------------------------------------------------------


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.first_release(order_commits(spark, sf_dir), release_tags(spark, sf_dir))


def release_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = releases.ordered(release_tags(spark, sf_dir)).join(releases.contents(_released(spark, sf_dir)), "tag", "left")
    return listed.select("tag", "previous_tag", "is_semver", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("authors", F.lit(0)).alias("authors"))


def unreleased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.unreleased(_released(spark, sf_dir))


def _file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file"))
    return items.distinct().join(_released(spark, sf_dir).select("sha", "authored_at", "tag"), "sha")


def file_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.file_releases(_file_history(spark, sf_dir))


def introduced_by_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_releases(spark, sf_dir).where("introduced_in is not null").groupBy(F.col("introduced_in").alias("release")).agg(F.count("*").alias("file_count"))


def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions from parts' sizes and brands, in version order."""
    v = F.concat(F.lit("v"), (F.col("p_size") % 12).cast("string"), F.lit("."), F.regexp_extract("p_brand", r"([0-9]+)", 1), F.when(F.col("p_size") % 5 == 0, "-rc.1").otherwise(F.lit(".0")))
    versions = table(spark, sf_dir, "part").select(v.alias("version")).distinct()
    order = Window.orderBy(T.version_numbers(F.col("version")), "version")
    return versions.select("version", F.row_number().over(order).cast("long").alias("place"), T.is_semver(F.col("version")).alias("is_semver"))


_RELEASED = f"""{TAGS_SQL}, c AS (SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS authored_at, {SUBJECT_SQL} AS subject,
  (SELECT min_by(tag, tagged_at) FROM tags WHERE tagged_at >= o_orderdate) AS tag FROM orders)"""
_FILES = f"""{_RELEASED}, h AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS file FROM lineitem),
f AS (SELECT file, (list(tag ORDER BY authored_at, sha))[1] AS introduced_in, (list(tag ORDER BY authored_at DESC, sha DESC))[1] AS last_modified_in, count(*) AS commit_count
  FROM h JOIN c USING (sha) GROUP BY file)"""

# --- activity ------------------------------------------------------------------------------------------------------


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, author, at): event types by user group as folders, users as authors."""
    path = F.concat_ws("/", "event_type", (F.col("user_id") % 20).cast("string"))
    return table(spark, sf_dir, "events").select(path.alias("path"), F.col("user_id").alias("author"), F.col("ts").alias("at"))


def _now() -> Column:
    return F.lit("2024-01-31").cast("timestamp_ntz")


def hot_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = activity.zones(_touches(spark, sf_dir), _now(), hot_days=7)
    return found.where("zone = 'hot'").orderBy(F.desc("recent"), "path").limit(20).select("path", "commits", "recent")


def frozen_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order folders without an order in the half year before the last."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("at"))
    return activity.zones(orders, F.lit("2000-01-01").cast("timestamp_ntz")).where("zone = 'frozen'").select("path", "commits", "last_at")


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("path"), F.col("l_suppkey").alias("author"))
    owners = activity.ownership(touches).where("rank <= 3")
    return owners.select("path", "author", "commits", F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"), "authors", "clear_owner")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of single orders as files, seen from half a year before the data's end: long untouched, their supplier, by line, long silent."""
    path, author = F.concat_ws("-", "l_partkey", F.col("l_orderkey") % 5), F.concat_ws("-", "l_suppkey", F.col("l_orderkey") % 40)
    touches = table(spark, sf_dir, "lineitem").select(path.alias("path"), author.alias("author"), F.col("l_shipdate").alias("at"))
    return activity.orphans(touches, F.lit("2002-01-01").cast("timestamp_ntz")).select("path", "creator", "last_at", "creator_last_at")


def branch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    age = F.datediff(_now(), F.col("at"))
    name = F.concat(F.when(F.col("user_id") % 4 == 0, "wip/").otherwise("feat/"), F.col("user_id").cast("string"))
    return last.select("user_id", age.cast("long").alias("age_days"), activity.branch_status(age).alias("status"), activity.is_wip(name).alias("wip"))


def naming_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naming of the hosts' first labels, whose dashes and capitals differ, and of part names."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://(?:www[.]|blog[.]|m[.])?([^./]+)", 1).alias("stem"))
    parts = table(spark, sf_dir, "part").select(F.regexp_replace("p_name", " ", "_").alias("stem"))
    return activity.naming_votes(hosts.unionByName(parts))


def hotfile_topk_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return activity.top_per(counted, "user_id", 2, F.desc("n"), F.col("event_type")).withColumn("rank", F.col("rank").cast("long"))


def sample_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    largest = activity.top_per(docs, "lang", 10, F.desc("n_chars"), F.col("doc_id")).select("doc_id", F.col("lang").alias("category"))
    some = activity.top_per(docs, "source", 3, F.desc("n_chars"), F.col("doc_id")).select("doc_id", F.col("source").alias("category"))
    return largest.unionByName(some)


# --- contracts -----------------------------------------------------------------------------------------------------


def _endpoints(spark: SparkSession, sf_dir: str, after: bool) -> DataFrame:
    """Orders as endpoints, their customers' groups as repositories; the later snapshot differs by rules on the key."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 25).cast("string")).alias("repo"),
        F.col("o_orderstatus").alias("method"),
        F.concat(F.lit("/orders/"), k.cast("string")).alias("path"),
        F.concat(F.lit("op"), k.cast("string"), F.when(F.lit(after) & (k % 11 == 0), "_v2").otherwise("")).alias("operation_id"),
        F.concat(F.col("o_orderpriority"), F.when(F.lit(after) & (k % 13 == 0), " changed").otherwise("")).alias("summary"),
        F.when(F.lit(after) & (k % 17 == 0), F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("tags"),
        F.lit("openapi.yaml").alias("spec_file"),
        k.alias("_k"),
    )
    return rows.where(F.col("_k") % 19 != 0 if after else F.col("_k") % 23 != 0).drop("_k")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.diff(_endpoints(spark, sf_dir, False), _endpoints(spark, sf_dir, True), "repo")


def contract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).withColumn("fields", F.array_join("fields", ","))


def contract_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.summary(_changes(spark, sf_dir))


def contracts_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = spark.range(30).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("repo"), (F.col("id") % 5 != 4).alias("has_baseline"))
    return contracts.check(repos, _changes(spark, sf_dir))


_DIFF = """e AS (SELECT 'r' || o_custkey % 25 AS repo, upper(o_orderstatus) AS method, '/orders/' || o_orderkey AS path, o_orderkey AS k FROM orders),
d AS (SELECT repo, method, path, CASE WHEN k % 19 = 0 THEN 'removed' WHEN k % 23 = 0 THEN 'added' ELSE 'modified' END AS change,
  CASE WHEN k % 19 = 0 OR k % 23 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'operation_id' END, CASE WHEN k % 13 = 0 THEN 'summary' END,
  CASE WHEN k % 17 = 0 THEN 'tags' END], lambda x: x IS NOT NULL), ',') END AS fields, k FROM e WHERE NOT (k % 19 = 0 AND k % 23 = 0)),
ch AS (SELECT repo, method, path, change, fields, change = 'removed' OR contains(fields, 'operation_id') AS breaking FROM d WHERE change <> 'modified' OR fields <> '')"""

# --- evolution -----------------------------------------------------------------------------------------------------

_MARKS = (
    "// @deprecated since: 1.2, use NAME instead", '#[deprecated(since = "0.5.0", note = "use NAME")]', "# TODO(remove-after: 2026-12-01) drop NAME TODO",
    "Deprecated: prefer NAME.", "warnings.warn('NAME', DeprecationWarning) # HACK", "// TODO: remove NAME FIXME XXX", "plain NAME TODOS it.skip(", "DEPRECATED: replaced by \"NAME\" @pytest.mark.skip",
)


def _marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_no, line): all lines of all documents, and one more of each, which names the text's first word."""
    word = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    mark = F.replace(_pick(_MARKS, F.col("doc_id")), F.lit("NAME"), word)
    docs = texts(spark, sf_dir, "doc_id", "text").where("text is not null")
    lines = docs.select(F.col("doc_id").alias("path"), F.posexplode(F.split(F.concat("text", F.lit("\n"), mark), "\n", -1)).alias("at", "line"))
    return lines.select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def deprecation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution.deprecations(_marked_lines(spark, sf_dir)).select("path", "line_no", "marker", "replacement", "since", "remove_after", "severity")


def breaking_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("sha") % 29 == 0, "x\nBREAKING CHANGE: y").otherwise("")
    return evolution.breaking(order_commits(spark, sf_dir).withColumn("body", body)).select("sha", "kind")


def replacement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as a commit's files: odd lines removed, even ones added."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey", "l_linenumber")
    name = F.concat(F.lit("src/"), F.translate(F.lower("p_name"), " ", "_"), F.lit(".rs"))
    files = items.join(table(spark, sf_dir, "part").select("p_partkey", name.alias("file")), F.col("l_partkey") == F.col("p_partkey"))
    files = files.select("sha", "file", F.when(F.col("l_linenumber") % 2 == 1, "D").otherwise("A").alias("status"), F.lit(None).cast("string").alias("renamed_from"))
    return evolution.replacements(files.distinct()).select("sha", "removed", "added", F.round("confidence", 6).alias("confidence"))


_LOG = ("## [2.0.0] - 2026-01-01", "### Removed", "- the old interface", "### Added", "- something new", "## 1.9.0", "### Breaking", "- short", "- changed the format", "text")


def changelog_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changelog of fixed lines for each benchmark item, rotated by its id."""
    numbers = F.sequence(F.lit(0), F.lit(2 * len(_LOG) - 1))
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.explode(numbers).alias("n"))
    line = F.element_at(F.array(*map(F.lit, _LOG)), ((F.col("n") + F.col("item_id")) % len(_LOG) + 1).cast("int"))
    return evolution.changelog(lines.select("item_id", (F.col("n") + 1).cast("long").alias("line_no"), line.alias("line")), "item_id")


def debt_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution.debt(_marked_lines(spark, sf_dir))


# --- derived facts -------------------------------------------------------------------------------------------------


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as findings: kind, first confidence and age follow from the id."""
    kinds = F.array(*map(F.lit, knowledge.TTL_DAYS))
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.element_at(kinds, (F.col("doc_id") % len(knowledge.TTL_DAYS) + 1).cast("int")).alias("kind"),
        F.when(F.col("quality") == 1, 0.95).otherwise(0.7).alias("initial"), (F.col("doc_id") % 211).alias("age_days"), "toxic",
    )
    return knowledge.aged(rows)


def confidence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("doc_id", "age_days", "initial", F.round("current", 6).alias("current"), "expired")


def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = knowledge.ttl_days(F.col("kind"))
    return _findings(spark, sf_dir).select("doc_id", "kind", days.cast("long").alias("ttl_days"), (F.col("age_days") > days).alias("past_ttl"))


def findings_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _findings(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    found = knowledge.section_metrics(joined.withColumn("superseded", F.col("doc_id") % 6 == 0), "lang", "kind")
    return found.withColumns({c: F.round(c, 6) for c in ("avg_initial", "avg_current")})


def _pick(names: tuple, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))


def feature_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    verdict = knowledge.verdict(
        _pick(("none", "partial", "complete", "complete"), k), F.col("quality") == 1, _pick(("none", "active", "obsolete"), k), k % 7 == 0, k % 2 == 0, k % 5, F.lit(10) - F.col("toxic") * 5
    )
    return table(spark, sf_dir, "labels").select("doc_id", verdict.alias("verdict"))


def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    signals = {"ten_uses": k % 2 == 0, "in_tests_too": k % 3 == 0, "documented": F.col("quality") == 1, "recent": k % 5 == 0, "variants": k % 7 == 0, "conflict": F.col("toxic") == 1}
    score = knowledge.confidence(signals)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(score, 6).alias("confidence"), (F.round(score, 6) >= knowledge.CONFIDENT).alias("confident"))


def stale_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.stale_sections(_paths(spark, sf_dir)).distinct()


def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XXH3 of whole texts, which no SQL gives."""
    return files.hashes(texts(spark, sf_dir, "doc_id", "text"), "text", "doc_id")


def file_hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.hashes(texts(spark, sf_dir, "doc_id", "text"), "text", "doc_id", "sha256")


def hash_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    old = docs.where(k % 31 != 0).select(k.alias("path"), F.md5("text").alias("hash"))
    new = docs.where(k % 37 != 0).select(k.alias("path"), F.md5(F.concat("text", F.when(k % 41 == 0, "x").otherwise(""))).alias("hash"))
    return knowledge.stale_files(old, new)


def plan_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the orders of 1995 against parts shipped in 1995."""
    orders = table(spark, sf_dir, "orders").where("year(o_orderdate) = 1995").select("o_orderkey")
    items = table(spark, sf_dir, "lineitem")
    planned = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_partkey").alias("path"))
    return knowledge.plan_against_actual(planned, items.where("year(l_shipdate) = 1995").select(F.col("l_partkey").alias("path")))


def reuse_category_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as symbols with a prefix from their key; their sales as uses."""
    prefix = _pick(("validate_", "log_", "auth_", "fetch_", "query_", "parse_", "mock_", "encrypt_", "view_", "use_", "x_"), F.col("p_partkey"))
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(prefix, F.translate(F.lower("p_name"), " ", "_")).alias("name"))
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"))
    rows = names.withColumn("category", knowledge.category(F.col("name"))).join(uses, "p_partkey", "left").fillna(0, ["uses"])
    return activity.top_per(rows, "category", 30, F.desc("uses"), F.col("p_partkey")).withColumn("rank", F.col("rank").cast("long"))


def phantom_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents as code, features being runs of three words; benchmark texts as a tracker's items, named by their first three."""
    lead = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", lead.alias("feature"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = texts(spark, sf_dir, "doc_id", "text").join(good, "doc_id", "left_semi")
    three = lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))
    # a text is split once: named outside the lambda, it is not split again for each run
    runs = F.get(F.transform(F.array(F.split("text", " ")), lambda words: F.when(F.size(words) >= 3, F.array_distinct(three(words)))), F.lit(0))
    return knowledge.phantom_features(docs.select(F.explode(runs).alias("feature")), items, "feature")


def watch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    found = watch.sessions(events, "1 hour")
    return found.select("repo", F.col("started").cast("timestamp_ntz").alias("started"), "event_count", F.array_join("paths", ",").alias("paths"))


QUERIES = {
    f.__name__: f
    for f in (
        coverage_files, coverage_best_report, coverage_overall, uncovered_ranges, is_test_file, lang_detect, path_exclude, flaky_candidates,
        untested_files, unreleased, file_releases, introduced_by_release, version_sort, hot_zones, frozen_zones, ownership,
        orphans, branch_status, naming_votes, hotfile_topk_per_author, sample_per_category, contract_diff,
        contract_diff_summary, contracts_check, deprecation_markers, breaking_kind, replacement_pairs, changelog_sections, debt_markers,
        confidence_decay, ttl_expiry, findings_metrics, feature_verdict, confidence_score, stale_sections, file_hash, file_hash_sha256,
        hash_stale, plan_vs_actual, reuse_category_topk, phantom_features, watch_sessions,
    )
} | {"releases": release_list}


def _case(cases: tuple, key: str) -> str:
    quoted = [c.replace("'", "''") for c in cases]
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(quoted)) + " END"


_F = f"""f AS (SELECT doc_id, {_case(tuple(knowledge.TTL_DAYS), 'doc_id')} AS kind, CASE WHEN quality = 1 THEN 0.95 ELSE 0.7 END::DOUBLE AS initial, doc_id % 211 AS age_days FROM labels),
g AS (SELECT *, initial * CASE WHEN age_days < 7 THEN 1.0 WHEN age_days <= 30 THEN 0.95 WHEN age_days <= 90 THEN 0.85 WHEN age_days <= 180 THEN 0.7 ELSE 0.5 END::DOUBLE AS current FROM f)"""
_SECTION_SQL = " UNION ALL ".join(
    f"SELECT path, unnest({list(s)}) AS section FROM p WHERE " + " OR ".join("regexp_matches(path, '^" + g.replace(".", "[.]").replace("*", ".*") + "$')" for g in globs.split("|"))
    for globs, s in knowledge.SECTION_RULES
)


def _phrase_sql(line: str, phrases: tuple, ends: str, most: int, any_case: bool, strip: str = "") -> str:
    """What follows the first phrase that gives something, as SQL."""
    found = []
    for p in phrases:
        rest = f"regexp_extract({line}, '{'(?i)' if any_case else ''}{p}(.*)$', 1)"
        value = f"trim(CASE WHEN regexp_matches({rest}, '[{ends}]') THEN regexp_extract({rest}, '^([^{ends}]*)', 1) ELSE substr({rest}, 1, {most}) END)"
        value = f"regexp_replace({value}, '{strip}', '')" if strip else value
        found.append(f"CASE WHEN strlen({value}) BETWEEN 1 AND 99 THEN {value} END")
    return f"coalesce({', '.join(found)})"


_MARKED_SQL = f"""d AS (SELECT doc_id, string_split(text || chr(10) || replace({_case(_MARKS, 'doc_id')}, 'NAME', regexp_extract(text, '^([A-Za-z]+)', 1)), chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id AS path, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM d)"""
_REMOVE_SQL = _phrase_sql("regexp_replace(t, '(?i)(remove[- _]after:)[ ]+', '\\1')", T.REMOVE_PHRASES, '),"', 30, True)
SQL = {
    "coverage_files": f"WITH {_COV} SELECT path, count(*) AS lines_total, count(*) FILTER (hits > 0) AS lines_covered, round(100.0 * count(*) FILTER (hits > 0) / count(*), 6) AS percent FROM one GROUP BY path",
    "coverage_best_report": f"WITH {_COV} SELECT path, report, lines_total, lines_covered, round(percent, 6) AS percent FROM best",
    "coverage_overall": f"WITH {_COV} SELECT CAST(sum(lines_total) AS BIGINT) AS lines_total, CAST(sum(lines_covered) AS BIGINT) AS lines_covered, round(100.0 * sum(lines_covered) / sum(lines_total), 6) AS percent FROM best",
    "uncovered_ranges": f"WITH {_COV}, i AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM one WHERE hits = 0) SELECT path, min(line) AS start, max(line) AS \"end\" FROM i GROUP BY path, g",
    "is_test_file": f"WITH {_P} SELECT p_partkey, path, {_TEST_SQL} AS is_test FROM p",
    "lang_detect": f"WITH {_P} SELECT p_partkey, path, {_LANG_SQL} AS language FROM p",
    "path_exclude": f"WITH {_P} SELECT p_partkey, {_EXCLUDE_SQL} AS excluded, {_SKIP_SQL} AS skipped, {_PRUNE_SQL} AS pruned, {_SEARCH_SQL} AS unsearched FROM p",
    "flaky_candidates": f"""WITH {_P}, x AS (SELECT DISTINCT l_orderkey AS sha, path AS file, {_TEST_SQL} AS test FROM lineitem JOIN p ON l_partkey = p_partkey),
o AS (SELECT sha, bool_and(test) AS alone FROM x GROUP BY sha),
c AS (SELECT o_orderkey AS sha, regexp_matches(lower({SUBJECT_SQL}), '{_FLAKY_WORDS}') AS s, regexp_matches(lower({SUBJECT_SQL}), 'reverts? ') AS r FROM orders),
n AS (SELECT file, count(*) AS total, count(*) FILTER (alone) AS isolated, count(*) FILTER (s) AS suspicious, count(*) FILTER (r) AS reverts FROM x JOIN o USING (sha) JOIN c USING (sha) WHERE test GROUP BY file),
z AS (SELECT *, round(least(suspicious * 0.5 + reverts * 0.7 + CASE WHEN isolated >= 3 THEN least((isolated - 2) * 0.15, 0.6) ELSE 0 END, 2)::DOUBLE, 6) AS score,
  array_to_string(list_filter([CASE WHEN suspicious > 0 THEN 'suspicious_messages' END, CASE WHEN reverts > 0 THEN 'reverts' END, CASE WHEN isolated >= 3 THEN 'isolated_edits' END], lambda v: v IS NOT NULL), ',') AS signals FROM n)
SELECT * FROM z WHERE score >= 0.2 ORDER BY score DESC, total DESC, file LIMIT 50""",
    "untested_files": f"""WITH {_P}, d AS (SELECT DISTINCT path, {_STEM} AS stem, {_TEST_SQL} AS test FROM p)
SELECT path FROM d WHERE NOT test AND stem NOT IN (SELECT regexp_replace(regexp_replace(stem, '^test_', ''), '(_test|_spec|[.]test|[.]spec)$', '') FROM d WHERE test)""",
    "releases": f"""WITH {_RELEASED}, n AS (SELECT tag, count(*) AS commits, count(DISTINCT author) AS authors FROM c GROUP BY tag)
SELECT tag, lag(tag) OVER (ORDER BY tagged_at) AS previous_tag, true AS is_semver, coalesce(commits, 0) AS commits, coalesce(authors, 0) AS authors FROM tags LEFT JOIN n USING (tag)""",
    "unreleased": f"WITH {_RELEASED} SELECT author, count(*) AS commits, bool_or(regexp_matches(subject, '^(feat|fix|refactor|perf)!| (feat|fix)!|BREAKING CHANGE')) AS has_breaking FROM c WHERE tag IS NULL GROUP BY author",
    "file_releases": f"WITH {_FILES} SELECT file, introduced_in, last_modified_in, commit_count, last_modified_in IS NULL AS is_unreleased FROM f",
    "introduced_by_release": f"WITH {_FILES} SELECT introduced_in AS release, count(*) AS file_count FROM f WHERE introduced_in IS NOT NULL GROUP BY 1",
    "version_sort": r"""WITH v AS (SELECT DISTINCT 'v' || p_size % 12 || '.' || regexp_extract(p_brand, '([0-9]+)', 1) || CASE WHEN p_size % 5 = 0 THEN '-rc.1' ELSE '.0' END AS version FROM part),
n AS (SELECT version, list_transform(list_filter(regexp_split_to_array(substr(version, 2), '[.-]'), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: CAST(x AS BIGINT)) AS k FROM v)
SELECT version, row_number() OVER (ORDER BY k, version) AS place, NOT contains(version, '-rc') OR regexp_full_match(version, 'v[0-9]+[.][0-9]+-rc[.]1') AS is_semver FROM n""",
    "hot_zones": """SELECT event_type || '/' || user_id % 20 AS path, count(*) AS commits, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS recent FROM events GROUP BY 1
HAVING count(*) FILTER (ts >= TIMESTAMP '2024-01-24') >= 10 ORDER BY recent DESC, path LIMIT 20""",
    "frozen_zones": """SELECT o_custkey AS path, count(*) AS commits, max(o_orderdate) AS last_at FROM orders GROUP BY 1
HAVING max(o_orderdate) < TIMESTAMP '2000-01-01' - INTERVAL 180 DAYS AND count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 30 DAYS) < 10""",
    "ownership": """WITH c AS (SELECT l_partkey % 500 AS path, l_suppkey AS author, count(*) AS commits FROM lineitem GROUP BY ALL),
r AS (SELECT *, commits / sum(commits) OVER w AS share, row_number() OVER (PARTITION BY path ORDER BY commits DESC, author) AS rank, count(*) OVER w AS authors, max(commits) OVER w / sum(commits) OVER w AS best
  FROM c WINDOW w AS (PARTITION BY path))
SELECT path, author, commits, round(share, 6) AS share, rank, authors, NOT (authors > 10 AND best < 0.3) AS clear_owner FROM r WHERE rank <= 3""",
    "orphans": """WITH t AS (SELECT l_partkey || '-' || l_orderkey % 5 AS path, l_suppkey || '-' || l_orderkey % 40 AS author, l_shipdate AS shipped FROM lineitem),
s AS (SELECT author AS creator, max(shipped) AS creator_last_at FROM t GROUP BY 1), p AS (SELECT path, arg_min(author, (shipped, author)) AS creator, max(shipped) AS last_at FROM t GROUP BY 1)
SELECT path, creator, last_at, creator_last_at FROM p JOIN s USING (creator) WHERE last_at < TIMESTAMP '2002-01-01' - INTERVAL 365 DAYS AND creator_last_at < TIMESTAMP '2002-01-01' - INTERVAL 180 DAYS""",
    "branch_status": """WITH a AS (SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') AS age_days FROM events GROUP BY 1)
SELECT user_id, age_days, CASE WHEN age_days < 7 THEN 'active' WHEN age_days <= 30 THEN 'stale' ELSE 'abandoned' END AS status, user_id % 4 = 0 AS wip FROM a""",
    "naming_votes": """WITH s AS (SELECT regexp_extract(url, '://(?:www[.]|blog[.]|m[.])?([^./]+)', 1) AS s FROM pages UNION ALL SELECT replace(p_name, ' ', '_') FROM part),
k AS (SELECT CASE WHEN contains(s, '-') THEN 'kebab' WHEN contains(s, '_') THEN 'snake' WHEN regexp_matches(s, '^[a-z]') AND regexp_matches(s, '[A-Z]') THEN 'camel' WHEN s <> '' THEN 'snake' END AS k FROM s),
v AS (SELECT count(*) FILTER (k = 'kebab') AS kebab, count(*) FILTER (k = 'snake') AS snake, count(*) FILTER (k = 'camel') AS camel FROM k)
SELECT *, CASE WHEN kebab + snake + camel = 0 THEN NULL WHEN snake >= camel AND snake >= kebab THEN 'snake' WHEN camel > kebab THEN 'camel' ELSE 'kebab' END AS winner FROM v""",
    "hotfile_topk_per_author": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM c QUALIFY rank <= 2",
    "sample_per_category": """SELECT doc_id, lang AS category FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 10
UNION ALL SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3""",
    "contract_diff": f"WITH {_DIFF} SELECT * FROM ch",
    "contract_diff_summary": f"WITH {_DIFF} SELECT count(*) AS total, count(*) FILTER (breaking) AS breaking, count(*) FILTER (NOT breaking) AS non_breaking FROM ch",
    "contracts_check": f"""WITH {_DIFF}, r AS (SELECT 'r' || i AS repo, i % 5 <> 4 AS base FROM range(30) t(i)), n AS (SELECT repo, count(*) AS total, count(*) FILTER (breaking) AS breaking FROM ch GROUP BY repo)
SELECT repo, CASE WHEN NOT base THEN 'skipped' WHEN coalesce(breaking, 0) > 0 THEN 'breaking' WHEN coalesce(total, 0) > 0 THEN 'changed' ELSE 'clean' END AS status, coalesce(total, 0) AS total, coalesce(breaking, 0) AS breaking FROM r LEFT JOIN n USING (repo)""",
    "deprecation_markers": f"""WITH {_MARKED_SQL}, t AS (SELECT path, line_no, trim(line) AS t, lower(trim(line)) AS low FROM l WHERE regexp_matches(lower(line), 'deprecat|todo')),
m AS (SELECT *, CASE WHEN contains(low, '@deprecated') OR contains(low, '#[deprecated') THEN 'annotation' WHEN regexp_matches(low, 'todo(\\(|: )(deprecate|remove)') THEN 'todo'
  WHEN regexp_matches(low, '^(// deprecated|# deprecated|/[*] deprecated|deprecated:)') OR contains(t, 'DEPRECATED:') THEN 'comment' WHEN contains(low, 'deprecationwarning') THEN 'runtime-warn' END AS marker FROM t),
f AS (SELECT path, line_no, marker, {_phrase_sql('t', T.REPLACEMENT_PHRASES, ')"' + "''", 80, True, '[.,;]+$')} AS replacement, {_phrase_sql('t', T.SINCE_PHRASES, '"), ', 30, False)} AS since, {_REMOVE_SQL} AS remove_after FROM m WHERE marker IS NOT NULL)
SELECT *, CASE WHEN remove_after IS NOT NULL THEN 'critical' WHEN since IS NOT NULL OR replacement IS NOT NULL THEN 'warning' ELSE 'info' END AS severity FROM f""",
    "breaking_kind": """SELECT sha, kind FROM (SELECT o_orderkey AS sha, CASE WHEN o_orderkey % 29 = 0 THEN 'breaking_change_footer' WHEN o_orderkey % 8 = 0 THEN 'conventional_breaking'
WHEN o_orderkey % 8 = 4 THEN 'migrate_keyword' WHEN o_orderkey % 8 = 6 THEN 'refactor_keyword' END AS kind FROM orders) WHERE kind IS NOT NULL""",
    "replacement_pairs": """WITH x AS (SELECT DISTINCT l_orderkey AS sha, replace(lower(p_name), ' ', '_') AS s, l_linenumber % 2 AS odd FROM lineitem JOIN part ON l_partkey = p_partkey),
j AS (SELECT a.sha, a.s AS r, b.s AS n, list_distinct(string_split(a.s, '_')) AS p, list_distinct(string_split(b.s, '_')) AS q FROM x a JOIN x b ON a.sha = b.sha AND a.odd = 1 AND b.odd = 0),
c AS (SELECT sha, 'src/' || r || '.rs' AS removed, 'src/' || n || '.rs' AS added, CASE WHEN r = n THEN 0.9 ELSE least(len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))) + 0.2, 1) END AS confidence FROM j)
SELECT sha, removed, added, round(confidence, 6) AS confidence FROM c WHERE confidence >= 0.5""",
    "changelog_sections": f"""WITH l AS (SELECT item_id, n + 1 AS line_no, {_case(_LOG, '(n + item_id)')} AS line FROM benchmark, range({2 * len(_LOG)}) t(n)),
m AS (SELECT *, nullif(regexp_extract(line, '^## \\[?([^\\] ]+)', 1), '') AS v, CASE WHEN line LIKE '## %' THEN 'none' WHEN line = '### Removed' THEN 'removed' WHEN line = '### Breaking' THEN 'changed' WHEN line LIKE '### %' THEN 'none' END AS s FROM l),
c AS (SELECT item_id, line_no, line, last_value(v IGNORE NULLS) OVER w AS version, last_value(s IGNORE NULLS) OVER w AS section FROM m WINDOW w AS (PARTITION BY item_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT item_id, line_no, version, section, substr(line, 3) AS text FROM c WHERE line LIKE '- %' AND length(line) > 7 AND version IS NOT NULL AND section <> 'none'""",
    "debt_markers": f"""WITH {_MARKED_SQL}, n AS (SELECT path, len(regexp_extract_all(line, '\\bTODO\\b')) AS todo, len(regexp_extract_all(line, '\\bFIXME\\b')) AS fixme, len(regexp_extract_all(line, '\\b(HACK|WORKAROUND)\\b')) AS hack,
  len(regexp_extract_all(line, '\\b(XXX|WTF)\\b')) AS xxx, len(regexp_extract_all(line, '\\b(xit|t[.]Skip|it[.]skip|describe[.]skip)\\b|@pytest[.]mark[.]skip|#\\[ignore\\]')) AS disabled FROM l),
y AS (SELECT path, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('todo', 'fixme', 'hack', 'xxx', 'disabled'))} FROM n GROUP BY path)
SELECT * FROM y WHERE todo + fixme + hack + xxx + disabled > 0""",
    "confidence_decay": f"WITH {_F} SELECT doc_id, age_days, initial, round(current, 6) AS current, current < 0.5 AS expired FROM g",
    "ttl_expiry": f"WITH {_F}, t AS (SELECT *, CASE kind WHEN 'pattern' THEN 30 WHEN 'fact' THEN 14 WHEN 'rule' THEN 60 WHEN 'risk' THEN 30 WHEN 'feature' THEN 7 ELSE 30 END AS d FROM f) SELECT doc_id, kind, CAST(d AS BIGINT) AS ttl_days, age_days > d AS past_ttl FROM t",
    "findings_metrics": f"""WITH {_F} SELECT lang, kind, count(*) AS findings, count(*) FILTER (current >= 0.5 AND doc_id % 6 <> 0) AS active, count(*) FILTER (doc_id % 6 = 0) AS superseded, count(*) FILTER (current < 0.5 AND doc_id % 6 <> 0) AS expired,
round(avg(initial), 6) AS avg_initial, round(avg(current), 6) AS avg_current FROM g JOIN documents USING (doc_id) GROUP BY lang, kind""",
    "feature_verdict": """WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'complete' END AS p, quality = 1 AS t, doc_id % 3 AS b, doc_id % 7 = 0 AS pr, doc_id % 5 >= 0.3 * (10 - 5 * toxic) AS dr FROM labels)
SELECT doc_id, CASE WHEN p = 'complete' AND t AND dr THEN 'DRIFTED' WHEN p = 'complete' AND t THEN 'IMPLEMENTED' WHEN p = 'partial' AND b = 2 AND NOT pr THEN 'ABANDONED'
WHEN p <> 'none' OR b = 1 OR pr THEN 'IN_PROGRESS' WHEN doc_id % 2 = 0 THEN 'SPEC_ONLY' ELSE 'NOT_STARTED' END AS verdict FROM x""",
    "confidence_score": """WITH x AS (SELECT doc_id, round(least(greatest(0.5 * (doc_id % 2 = 0)::INT + 0.2 * (doc_id % 3 = 0)::INT + 0.2 * (quality = 1)::INT + 0.1 * (doc_id % 5 = 0)::INT
- 0.3 * (doc_id % 7 = 0)::INT - 0.3 * (toxic = 1)::INT, 0), 1)::DOUBLE, 6) AS confidence FROM labels) SELECT doc_id, confidence, confidence >= 0.7 AS confident FROM x""",
    "stale_sections": f"WITH {_P} SELECT DISTINCT path, section FROM ({_SECTION_SQL})",
    "file_hash_sha256": "SELECT doc_id, sha256(text) AS hash, strlen(text) AS size_bytes FROM documents WHERE text IS NOT NULL",
    "hash_stale": """SELECT path, change FROM (SELECT doc_id AS path, CASE WHEN doc_id % 31 = 0 AND doc_id % 37 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN 'added' WHEN doc_id % 37 = 0 THEN 'removed'
WHEN doc_id % 41 = 0 THEN 'changed' END AS change FROM documents) WHERE change IS NOT NULL""",
    "plan_vs_actual": """WITH p AS (SELECT DISTINCT l_partkey AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1995), a AS (SELECT DISTINCT l_partkey AS y FROM lineitem WHERE year(l_shipdate) = 1995),
c AS (SELECT count(*) FILTER (x = y) AS done, count(*) FILTER (y IS NULL) AS missed, count(*) FILTER (x IS NULL) AS unplanned FROM p FULL JOIN a ON x = y)
SELECT *, CASE WHEN unplanned > 3 THEN 'DIVERGED' WHEN missed > 0 THEN 'INCOMPLETE' ELSE 'MATCHES' END AS verdict FROM c""",
    "reuse_category_topk": f"""WITH n AS (SELECT p_partkey, {_case(('validate_', 'log_', 'auth_', 'fetch_', 'query_', 'parse_', 'mock_', 'encrypt_', 'view_', 'use_', 'x_'), 'p_partkey')} || replace(lower(p_name), ' ', '_') AS name FROM part),
u AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1),
c AS (SELECT p_partkey, name, CASE """ + " ".join(f"WHEN regexp_matches(name, '{w}') THEN '{c}'" for c, w in knowledge.CATEGORIES) + """ ELSE 'other' END AS category, coalesce(uses, 0) AS uses FROM n LEFT JOIN u ON p_partkey = l_partkey)
SELECT *, row_number() OVER (PARTITION BY category ORDER BY uses DESC, p_partkey) AS rank FROM c QUALIFY rank <= 30""",
    "phantom_features": """WITH i AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS feature FROM benchmark), g AS (SELECT string_split(text, ' ') AS w FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
r AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS feature FROM g) SELECT item_id, i.feature FROM i JOIN r USING (feature)""",
    "watch_sessions": """WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT CAST(user_id AS VARCHAR) AS repo, min(ts) AS started, count(*) AS event_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM n GROUP BY user_id, k""",
}
