"""Queries of what histories say of projects, and of coverage reports that are found, or read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import project
from codestrata.sources import coverage, repository, specs
from codestrata.streaming import watch

from .adapters import SUBJECT_SQL, order_commits, table
from .parsed_queries import _COV, _TOUCHED, _covered, _log, _parts, _report, _text, new_folder

_REFERENCE = "1997-06-01"


def history_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, each seventh as a merge, in the ninety days before a moment."""
    now = F.lit(_REFERENCE).cast("timestamp")
    commits = order_commits(spark, sf_dir).select(
        F.concat(F.lit("r"), (F.col("author") % 20).cast("string")).alias("repo"), "sha", F.col("author").cast("string").alias("author"),
        F.col("authored_at").cast("timestamp").alias("at"), "subject", F.when(F.col("sha") % 7 == 0, 2).otherwise(1).alias("parents"),
    )
    # items meet their commits before they get names, so that those outside the window are dropped unnamed
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("k"))
    touches = project.recent(commits, now).select("repo", "sha").join(items, "sha").join(_parts(spark, sf_dir), "k").select("repo", "sha", F.concat("path", F.lit("_"), "k").alias("path"))
    found = project.history_signals(commits, touches, now)
    return found.withColumn("rank", F.col("rank").cast("long"))


def coverage_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three forms, some at places where none is looked for; lines and covered lines of each file."""
    at = lambda df, usual, other: df.withColumn("path", F.when(F.col("path") == "O", usual).otherwise(other))
    line = F.concat(F.lit("DA:"), "line", F.lit(","), "hits")
    lcov = _report(spark, sf_dir, line, F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n")), "\nLF:1\nend_of_record")
    line = F.concat(F.lit('<line hits="'), "hits", F.lit('" number="'), "line", F.lit('"/>'))
    before = F.concat(F.lit('<class line-rate="1" filename="'), "path", F.lit('" name="x"><methods/><lines>'))
    xml = _report(spark, sf_dir, line, before, "</lines></class>", "<coverage><classes>", "</classes></coverage>")
    line = F.concat("path", F.lit(":"), "line", F.lit(".2,"), F.col("line") + 3, F.lit(".9 1 "), "hits")
    go = _report(spark, sf_dir, line, F.lit(""), "", "mode: set\n")
    files = at(lcov, "coverage/lcov.info", "lcov.info").unionByName(at(xml, "old/coverage.xml", "cobertura.xml")).unionByName(at(go, "cover.out", "sub/cover.out"))
    found = coverage.discover(files)
    return found.groupBy("report", "path").agg(F.count("*").alias("lines"), F.count_if(F.col("hits") > 0).alias("covered"))


def coverage_from_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes written to XML files with attributes in two orders, entities, CDATA, and comments that hold elements."""
    number, hits = F.concat(F.lit('number="'), "line", F.lit('"')), F.concat(F.lit('hits="'), "hits", F.lit('"'))
    order = F.when(F.col("line") % 2 == 0, F.concat_ws(" ", number, hits)).otherwise(F.concat(hits, F.lit(" branch='false'\n "), number))
    line = F.concat(F.lit("<line "), order, F.when(F.col("line") % 3 == 0, F.lit("></line>")).otherwise(F.lit("/>")), F.lit('<!-- </class><line number="7" hits="7"/> -->'))
    blocks = _text(_covered(spark, sf_dir), ("report", "path"), "line", line)
    head = F.concat(F.lit('<class name="a &lt; b" filename="'), F.replace("path", F.lit("#"), F.lit("&#35;")), F.lit('&amp;co">\n<doc><![CDATA[</class> <line number="1" hits="1"/>]]></doc>'))
    place = new_folder(spark, "reports")
    whole = F.concat(F.lit("<?xml version='1.0'?>\n<coverage><packages><package><classes>"), head, F.lit("<methods/><lines>"), "content", F.lit("</lines></class></classes></package></packages></coverage>"))
    blocks.select("report", F.xxhash64("path").alias("n"), whole.alias("value")).write.partitionBy("report", "n").text(place)  # a file for each
    found = coverage.read_cobertura(spark, place)
    return found.groupBy("path", "line", "hits").agg(F.count("*").alias("times"))


def coverage_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LCOV files and coverprofiles written record by record, and read by splits."""
    place, covered = new_folder(spark, "reports"), _covered(spark, sf_dir)
    records = _text(covered, ("report", "path"), "line", F.concat(F.lit("DA:"), "line", F.lit(","), "hits"))
    records.select("report", F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n"), "content", F.lit("\nLF:1\nend_of_record"))).write.partitionBy("report").text(f"{place}/lcov")
    covered.select("report", F.concat(F.lit("go/"), "path", F.lit(":"), "line", F.lit(".2,"), F.col("line") + 3, F.lit(".9 1 "), "hits")).write.partitionBy("report").text(f"{place}/go")
    found = coverage.read_lcov(spark, f"{place}/lcov").unionByName(coverage.read_go_profile(spark, f"{place}/go"))
    return found.groupBy("path", "line", "hits").agg(F.count("*").alias("times"))


def log_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits written to a log file of each repository, and read commit by commit; files of each repository by commits."""
    place = new_folder(spark, "logs")
    _log(spark, sf_dir).write.partitionBy("repo").text(place)
    # dealt by file: a file's commits are told apart where they are counted, without a second exchange
    read = repository.parse_log(repository.read_logs(spark, place)).repartition("repo", "file")
    return read.groupBy("repo", "file").agg(F.count_distinct("sha").alias("commits"))


def ci_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs of three further kinds of CI definitions, with entries that are no jobs; a file for each nation."""
    k = F.col("c_custkey")
    name, n = F.concat(F.lit("j"), k.cast("string")), (k % 4).cast("int")
    steps = lambda one: F.array_join(F.array_repeat(F.lit(one), n), ",")
    kind = F.col("c_nationkey") % 3
    gitlab = F.concat(F.lit('"'), name, F.lit('":{"stage":"'), F.lower("c_mktsegment"), F.lit('","script":['), steps('"make"'), F.lit("]}"))
    circle = F.concat(F.lit('"'), name, F.lit('":{"docker":[{"image":"img'), n.cast("string"), F.lit('"}],"steps":['), steps('"checkout"'), F.lit("]}"))
    jenkins = F.concat(F.lit("    stage('"), name, F.lit("') { steps { sh 'stage(1)' } }"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(kind == 0, gitlab).when(kind == 1, circle).otherwise(jenkins).alias("job"))
    jobs = _text(rows, ("c_nationkey",), "c_custkey", F.concat("job", F.when(kind < 2, F.lit(",")).otherwise(F.lit(""))))
    head = F.when(kind == 0, F.lit('{"stages":["a"],"variables":{"x":{}},".hidden":{"script":[1]},"note":"text",')).when(kind == 1, F.lit('{"version":2,"jobs":{')).otherwise(F.lit("pipeline {\n  triggers { pollSCM('') }\n  stages {\n"))
    tail = F.when(kind == 0, F.lit('"default":{}}')).when(kind == 1, F.lit('"m":{"machine":"m"}}}')).otherwise(F.lit("\n  }\n}"))
    path = F.when(kind == 0, F.lit(".gitlab-ci.yml")).when(kind == 1, F.lit(".circleci/config.yml")).otherwise(F.lit("Jenkinsfile"))
    files = jobs.select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo"), path.alias("path"), F.concat(head, "content", tail).alias("content"))
    return specs.ci_jobs(files).select("repo", "provider", F.array_join("triggers", ",").alias("triggers"), "job", "runs_on", "steps_count")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of an hour that begin every half hour; users as repositories."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), "ts")
    return watch.windows(events, "1 hour", "30 minutes").select("repo", "started", "event_count")


QUERIES = {f.__name__: f for f in (history_signals, coverage_discovered, coverage_from_xml, coverage_from_files, log_from_files, ci_forms, event_windows)}
_RANK = "row_number() OVER (PARTITION BY repo ORDER BY {}) AS rank"
SQL = {
    "history_signals": f"""WITH {_TOUCHED}, c AS (SELECT 'r' || o_custkey % 20 AS repo, o_orderkey AS sha, CAST(o_custkey AS VARCHAR) AS author, CAST(o_orderdate AS TIMESTAMP) AS ts, {SUBJECT_SQL} AS subject,
  CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS parents FROM orders),
w AS (SELECT * FROM c WHERE ts >= TIMESTAMP '{_REFERENCE}' - INTERVAL 90 DAY AND ts <= TIMESTAMP '{_REFERENCE}'),
parts AS (SELECT repo, 'last_commits' AS part, {_RANK.format('ts DESC, sha DESC')}, substr(CAST(sha AS VARCHAR), 1, 7) || ' ' || subject AS value, CAST(NULL AS BIGINT) AS count, 10 AS most FROM c WHERE ts <= TIMESTAMP '{_REFERENCE}'
UNION ALL SELECT repo, 'subjects', {_RANK.format('ts DESC, sha DESC')}, subject, NULL, 30 FROM w WHERE parents = 1
UNION ALL SELECT repo, 'commits', 1, NULL, count(*), 1 FROM w WHERE parents = 1 GROUP BY repo
UNION ALL SELECT repo, 'top_files', {_RANK.format('n DESC, file')}, file, n, 15 FROM (SELECT f.repo, file, count(DISTINCT f.sha) AS n FROM f JOIN w ON f.sha = CAST(w.sha AS VARCHAR) GROUP BY ALL)
UNION ALL SELECT repo, 'active_authors', {_RANK.format('n DESC, author')}, author, n, 5 FROM (SELECT repo, author, count(*) AS n FROM w GROUP BY ALL))
SELECT repo, part, rank, value, count FROM parts WHERE rank <= most""",
    "coverage_discovered": f"""WITH {_COV}, r AS (SELECT *, CASE report WHEN 'O' THEN 'coverage/lcov.info' ELSE 'lcov.info' END AS place FROM cov
UNION ALL SELECT *, 'cobertura.xml' FROM cov WHERE report = 'F' UNION ALL SELECT *, 'cover.out' FROM cov WHERE report = 'O')
SELECT place AS report, path, count(*) AS lines, count(*) FILTER (hits > 0) AS covered FROM r GROUP BY ALL""",
    "coverage_from_xml": f"WITH {_COV} SELECT path || '&co' AS path, CAST(line AS INTEGER) AS line, hits, count(*) AS times FROM cov GROUP BY ALL",
    "ci_forms": """SELECT 'r' || c_nationkey AS repo, CASE c_nationkey % 3 WHEN 0 THEN 'gitlab' WHEN 1 THEN 'circleci' ELSE 'jenkins' END AS provider,
  CASE c_nationkey % 3 WHEN 0 THEN 'push,merge_request' WHEN 1 THEN 'push' ELSE 'scm-poll' END AS triggers, 'j' || c_custkey AS job,
  CASE c_nationkey % 3 WHEN 0 THEN 'stage:' || lower(c_mktsegment) WHEN 1 THEN 'img' || c_custkey % 4 END AS runs_on, CASE WHEN c_nationkey % 3 = 2 THEN 0 ELSE CAST(c_custkey % 4 AS INTEGER) END AS steps_count FROM customer
UNION ALL SELECT DISTINCT 'r' || c_nationkey, 'circleci', 'push', 'm', 'm', 0 FROM customer WHERE c_nationkey % 3 = 1""",
    "event_windows": """WITH w AS (SELECT user_id AS repo, time_bucket(INTERVAL 30 MINUTE, CAST(ts AS TIMESTAMP)) - to_minutes(CAST(30 * unnest([0, 1]) AS BIGINT)) AS started FROM events WHERE ts IS NOT NULL)
SELECT repo, started, count(*) AS event_count FROM w GROUP BY ALL""",
    "coverage_from_files": f"""WITH {_COV} SELECT p AS path, CAST(line AS INTEGER) AS line, hits, count(*) AS times
FROM (SELECT path AS p, line, hits FROM cov UNION ALL SELECT 'go/' || path, line, hits FROM cov) GROUP BY ALL""",
    "log_from_files": f"WITH {_TOUCHED} SELECT repo, file, count(DISTINCT sha) AS commits FROM f GROUP BY ALL",
}
