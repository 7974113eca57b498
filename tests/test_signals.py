"""Coverage reports read as XML, and heads of listings."""

import pytest
from pyspark.sql import functions as F

from codestrata.operators import project, summaries
from codestrata.sources import coverage

COBERTURA = """<?xml version="1.0"?><!DOCTYPE coverage SYSTEM "x.dtd">
<!-- <class filename="no"><lines><line number="1" hits="1"/></lines></class> -->
<coverage><packages><package name="p"><classes>
<class line-rate="1" filename="a&amp;b.py" name="A"><methods><method name="m"><lines><line hits="2" number="3"/></lines></method></methods>
 <lines><line number="3" hits="2"/><!-- </class> --><line branch="true" hits='0'
   number="9"/><line number="x" hits="1"/></lines></class>
<class name="B" filename="c.py"><doc><![CDATA[</class><line number="5" hits="5"/>]]></doc><methods/><lines/></class>
<class name="D" filename="d.py"><methods/><lines><line number="1" hits="7"></line></lines></class>
</classes></package></packages></coverage>"""
JACOCO = """<report name="r"><group name="g"><package name="com/acme"><class name="com/acme/X"><counter type="LINE"/></class>
<sourcefile name="X.java"><line ci="4" mi="0" nr="12" cb="0" mb="0"/><line nr="13" mi="2" ci="0"/><counter type="LINE"/></sourcefile></package></group>
<package name=""><sourcefile name="Y.java"><line nr="1" ci="1"/></sourcefile></package></report>"""


def test_reports_as_xml(spark, tmp_path):
    (tmp_path / "one.xml").write_text(COBERTURA)
    (tmp_path / "two.xml").write_text(COBERTURA.replace("d.py", "e.py"))
    rows = coverage.read_cobertura(spark, str(tmp_path / "*.xml")).collect()
    assert len({r.report for r in rows}) == 2
    one = sorted((r.path, r.line, r.hits) for r in rows if r.report.endswith("one.xml"))
    assert one == [("a&b.py", 3, 2), ("a&b.py", 3, 2), ("a&b.py", 9, 0), ("d.py", 1, 7)]
    (tmp_path / "j.jacoco").write_text(JACOCO)
    got = sorted((r.path, r.line, r.hits) for r in coverage.read_jacoco(spark, str(tmp_path / "j.jacoco")).collect())
    assert got == [("Y.java", 1, 1), ("com/acme/X.java", 12, 4), ("com/acme/X.java", 13, 0)]


def test_discover(spark):
    lcov, go = "SF:a.c\nDA:1,2\nDA:2,0\nend_of_record\n", "mode: set\nm/x.go:3.1,4.2 1 5\n"
    files = spark.createDataFrame([("lcov.info", lcov), ("sub/lcov.info", lcov), ("c.out", go), ("coverage.xml", COBERTURA), ("README.md", "x")], "path string, content string")
    got = {(r.report, r.path, r.line, r.hits) for r in coverage.discover(files).collect()}
    assert {("lcov.info", "a.c", 1, 2), ("lcov.info", "a.c", 2, 0), ("c.out", "m/x.go", 3, 5)} <= got and {r[0] for r in got} == {"lcov.info", "c.out", "coverage.xml"}


def test_listing_head(spark):
    lines = lambda n: spark.createDataFrame([(i, ("d" if i % 3 == 0 else "-") + f"rw-r--r-- f{i}") for i in range(n)] + [(99, "")], "line_no int, line string")
    long, short = summaries.listing_head(lines(40)).collect(), summaries.listing_head(lines(20)).collect()
    assert [r.line_no for r in long] == list(range(15)) and long[0][2:] == (14, 26, 25)
    assert len(short) == 20 and short[0].more == 0 and summaries.listing_head(lines(0)).count() == 0


def test_folders_show_their_first_paths(spark):
    rows = [(f"src/f{i:02d}.rs",) for i in range(30)] + [("a/x",), ("top",), (" ",)]
    got = [(r.folder, r.files, r["sample"]) for r in summaries.find_by_folder(spark.createDataFrame(rows, "line string")).collect()]
    assert got == [("src", 30, ["src/f00.rs", "src/f01.rs", "src/f02.rs"]), ("", 1, ["top"]), ("a", 1, ["a/x"])]


def test_project_signals(spark):
    files = [("r", "README.txt", "later"), ("r", "README.md", "é" * 5000), ("r", "go.mod", "module x"), ("r", "sub/go.mod", "no"), ("r", "package.json", None), ("q", "README", "")]
    got = {(r.repo, r.part, r.path): r.excerpt for r in project.file_signals(spark.createDataFrame(files, "repo string, path string, content string")).collect()}
    assert got == {("r", "readme", "README.md"): "é" * 4000, ("r", "manifest", "go.mod"): "module x", ("q", "readme", "README"): ""}
    commits = [("r", f"{i:08d}", f"a{i % 7}", i, f"s{i}", 1 + (i % 5 == 0)) for i in range(100)]
    table = spark.createDataFrame(commits, "repo string, sha string, author string, day int, subject string, parents int").withColumn("at", F.timestamp_seconds(F.col("day") * 86400))
    touches = spark.createDataFrame([("r", f"{i:08d}", f"f{i % 20}") for i in range(100)] * 2, "repo string, sha string, path string")
    rows = project.history_signals(table, touches, F.timestamp_seconds(F.lit(99 * 86400))).collect()
    part = lambda name: [(r.value, r["count"]) for r in sorted(rows, key=lambda r: r["rank"]) if r.part == name]
    assert part("last_commits") == [(f"{i:08d}"[:7] + f" s{i}", None) for i in range(99, 89, -1)]
    plain = [i for i in range(9, 100) if i % 5]
    assert part("subjects") == [(f"s{i}", None) for i in plain[::-1][:30]] and part("commits") == [(None, len(plain))]
    assert len(part("top_files")) == 15 and part("top_files")[0] == ("f10", 5) and len(part("active_authors")) == 5


def test_files_are_split_into_records(spark, tmp_path):
    """A report and a history that many tasks read, each record whole; none lost where a file is cut."""
    from codestrata.sources import repository

    (tmp_path / "lcov.info").write_text("".join(f"SF:f{i}.c\nDA:{i},{i % 3}\nDA:1,1\nend_of_record\n" for i in range(3000)))
    (tmp_path / "app.log").write_text("".join(f"COMMIT:{i}\n\nsrc/{i}.c\nsrc/all.c\n\n" if i % 10 else f"COMMIT:{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        report, logs = coverage.read_lcov(spark, str(tmp_path / "lcov.info")), repository.read_logs(spark, str(tmp_path / "app.log"))
        assert logs.rdd.getNumPartitions() > 5
        assert {(r.path, r.line): r.hits for r in report.collect()} == {(f"f{i}.c", n): h for i in range(3000) for n, h in ((1, 1), (i, i % 3))} | {("f1.c", 1): 1}
        got = repository.parse_log(logs).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = sorted([("app", str(i), f) for i in range(3000) if i % 10 for f in (f"src/{i}.c", "src/all.c")] + [("app", str(i), None) for i in range(0, 3000, 10)], key=str)
    assert sorted(map(tuple, got), key=str) == expected


def test_touched_files_shuffle_items_twice(spark):
    from codestrata.plans import parsed_queries

    from .test_indexes import rows_shuffled

    data, was = "/root/testdata/sf0.001", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    items = spark.read.parquet(f"{data}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = rows_shuffled(spark, lambda: parsed_queries._touched(spark, data).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert shuffled < 2.6 * items  # by part and by commit, besides the commits; a third exchange for their grouping is spared


def test_a_path_is_made_once_where_it_is_tested(spark):
    """The filter moves to where the path is made; its expression must not be repeated for each sign of a test."""
    from codestrata.functions import paths

    made = spark.range(9).select(F.concat(F.translate(F.col("id").cast("string"), "1", "x"), F.lit("_test.go")).alias("path")).distinct()
    found = made.where(paths.is_test(F.col("path")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 3  # the filter, a test for null, the column
    assert found.count() == 9


def test_signs_of_test_paths_as_one_pattern(spark):
    from codestrata.functions import paths

    known = {
        "TESTS/a": True, "spec/a.c": True, "__tests__/a": False, "a/__tests__/b": True, "tests": False, "a/test_": True, "test_a/b": False, "a\n/b_test.go": True,
        "a_test.go\n": False, "a_test.go/b": False, "aXtest.ts": False, "x/Y.Test.Ts": True, "": False, None: None, "a/test_\nb": True, "x\ntests/b": False, "x\ntest_b": False,
    }
    rows = spark.createDataFrame([(p,) for p in known], "path string")
    assert {r.path: r.t for r in rows.select("path", paths.is_test(F.col("path")).alias("t")).collect()} == known


def test_owners_are_those_that_rank_first(spark):
    from codestrata.operators import activity

    rows = [("many", str(i)) for i in range(11)] + [("ten", str(i)) for i in range(10)] + [("own", "b")] * 9 + [("own", str(i)) for i in range(11)]
    rows += [("null", None), ("null", "a"), (None, "z"), (None, "y"), ("one", "b"), ("one", "a"), ("one", "b")]
    touches = spark.createDataFrame(rows, "path string, author string")
    columns = ["path", "author", "rank", "clear_owner"]
    expected = activity.ownership(touches).where("rank = 1").select(columns).collect()
    assert sorted(map(str, activity.owners(touches).select(columns).collect())) == sorted(map(str, expected))


def test_flaky_files_by_number(spark):
    """Files that are numbers with a mark give what their paths give; repeated files count once."""
    from codestrata.operators import quality

    touched = [(s, f) for s in range(6) for f in (("tests/a", "tests/a") if s < 4 else ("tests/a", "src/b"))] + [(9, "src/b"), (7, "tests/lost")]
    commits = spark.createDataFrame([(s, "fix flaky" if s % 2 else "Revert it") for s in (0, 1, 2, 3, 4, 5, 9)], "sha int, subject string")
    files = spark.createDataFrame(touched, "sha int, file string")
    number = F.when(F.col("file") == "tests/a", 1).when(F.col("file") == "src/b", 2).otherwise(3)
    marked = files.select("sha", number.alias("file"), F.col("file").startswith("tests/").alias("test"))
    named, numbered = (quality.flaky(commits, x).collect() for x in (files, marked))
    assert [tuple(r)[1:] for r in named] == [tuple(r)[1:] for r in numbered] and [r.file for r in numbered] == [1]
    assert (named[0].file, named[0].total, named[0].isolated, named[0].suspicious, named[0].reverts) == ("tests/a", 6, 4, 3, 3)


@pytest.mark.parametrize(("name", "most"), [("history_signals", 2.0), ("log_from_files", 3.4)])
def test_histories_shuffle_items_once_for_each_need(spark, name, most):
    """Items outside the window get no names (2.4 rows an item before); what is read from logs is shuffled once (3.8 before)."""
    from codestrata.plans import signal_queries

    from .test_indexes import rows_shuffled

    data, was = "/root/testdata/sf0.001", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    items = spark.read.parquet(f"{data}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = rows_shuffled(spark, lambda: signal_queries.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert shuffled < most * items


def test_records_are_split_once(spark):
    """A record's lines are split once, not for each use; what precedes a marker and empty logs give nothing."""
    from codestrata.sources import repository

    logs = spark.createDataFrame([("r", "x\nCOMMIT:1\r\n\r\na b\r\n c \nCOMMIT: 2 \n"), ("r", "none"), ("r", ""), ("r", None), ("s", "COMMIT:"), ("s", "COMMIT:3\nCOMMIT:3\nd")], "repo string, content string")
    found = repository.parse_log(logs)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("r", "1", "a b"), ("r", "1", "c"), ("r", "2", None), ("s", "", None), ("s", "3", "d"), ("s", "3", None)], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(record") == 1
