"""Streams give what batches give."""

import json

from pyspark.sql import functions as F

from codestrata.plans import report
from codestrata.streaming import watch

EVENTS = [
    ("r", "main.go", 0), ("r", "lib.rs", 3), ("r", "script.sh", 4), ("r", "README.md", 5), ("r", "target/x.rs", 6), ("r", "a.py", 100), ("q", "x.ts", 2),
]


def events(spark):
    rows = spark.createDataFrame(EVENTS, "repo string, path string, s int")
    return rows.select("repo", "path", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))


def test_batches(spark):
    got = {(r.repo, tuple(r.affected_paths), tuple(r.languages), r.event_count) for r in watch.batches(events(spark)).collect()}
    assert got == {("r", ("lib.rs", "main.go", "script.sh"), ("bash", "go", "rust"), 5), ("r", ("a.py",), ("python",), 1), ("q", ("x.ts",), ("typescript",), 1)}


def test_stream_equals_batch(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = watch.run(watch.sessions(stream, "5 seconds", "1 minute"), str(tmp_path / "cp"), lambda df, _: df.write.mode("append").parquet(out), "append")
    query.awaitTermination(120)
    whole = {(r.repo, r.started, tuple(r.paths)) for r in watch.sessions(events(spark)).collect()}
    got = {(r.repo, r.started, tuple(r.paths)) for r in spark.read.parquet(out).collect()}
    assert got and got <= whole and len(whole) - len(got) == 1  # the last session is still open


def test_stale_stream(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    watch.run(watch.stale_sections(stream), str(tmp_path / "cp"), lambda df, _: df.write.mode("append").parquet(out)).awaitTermination(120)
    assert {r.section for r in spark.read.parquet(out).where("path = 'README.md'").collect()} == {"09-features"}


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")
    assert '"n": 1' in report.envelope("x/v1", {"rows": df.orderBy("n")})
    assert report.markdown(df.orderBy("n")).splitlines()[2:] == ["| 1 | a\\|b |", "| 2 |  |"]
    report.write(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    whole = json.loads(report.envelope("x/v1", {"rows": df.orderBy("n"), "none": df.where("n > 5")}, most=1))
    assert whole["omitted"] == {"rows": 1} and len(whole["rows"]) == 1 and whole["none"] == []
    report.write_parts({"rows": df}, str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all" / "rows")).count() == 2


def test_windows_as_stream_drop_what_is_late(spark, tmp_path):
    """Tumbling and sliding windows: a stream gives what a batch gives; an event behind the watermark is dropped."""
    at = lambda rows: spark.createDataFrame(rows, "repo string, path string, s int").select("repo", "path", F.timestamp_seconds(F.col("s") + 1_700_000_040).alias("ts"))
    first, second, late = [("r", "a", 1), ("r", "b", 59), ("r", "a", 61), ("q", "x", 5)], [("r", "c", 400), ("r", "d", 70)], [("r", "z", 10), ("r", "e", 900), ("r", "e", 2000)]
    key = lambda df: sorted((r.repo, r.started, r.files, r.event_count) for r in df.collect())
    for n, (size, slide) in enumerate((("1 minute", None), ("2 minutes", "1 minute"))):
        folder, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        for rows in (first, second, late):
            at(rows).coalesce(1).write.mode("append").parquet(folder)
            stream = watch.windows(spark.readStream.schema(at(first).schema).parquet(folder), size, slide, "30 seconds")
            watch.run(stream, str(tmp_path / f"cp{n}"), lambda df, _, out=out: df.write.mode("append").parquet(out)).awaitTermination(120)
        whole = watch.windows(at([*first, *second, *[x for x in late if x[1] != "z"]]), size, slide)
        last = max(r.started for r in whole.collect())
        assert key(spark.read.parquet(out)) == key(whole.where(F.col("ended") <= F.timestamp_seconds(F.lit(2000 + 1_700_000_040 - 30)))) and key(whole)[-1][1] == last
