"""Folder changes as a stream, and bursts that end by a timer."""

import os
import time

import pytest
from pyspark.sql import functions as F

from codestrata.streaming import debounce, folders, watch


def put(root, path, at, text="x"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)
    os.utime(full, (at, at))


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_folder_stream_with_restart(spark, tmp_path):
    folders.register(spark)
    root, out, cp = str(tmp_path / "root"), str(tmp_path / "out"), str(tmp_path / "cp")
    now = int(time.time()) - 100
    made = [("r", "main.go", now), ("r", "src/lib.rs", now + 3), ("q", "x.ts", now + 2), ("r", "target/x.rs", now + 4)]
    for repo, path, at in made:
        put(root, f"{repo}/{path}", at)

    def run():
        stream = spark.readStream.format("folder_changes").option("path", root).option("settle", 0).load().where("kind = 'file'")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.repo, r.path, int(r.ts.timestamp())) for r in spark.read.parquet(out).collect())

    assert run() == sorted(made)
    assert run() == sorted(made)  # nothing new
    later = int(time.time())
    time.sleep(1.1)
    more = [("r", "main.go", later + 1), ("new", "deep/a/b.py", later + 1)]
    for repo, path, at in more:
        put(root, f"{repo}/{path}", at)
    time.sleep(0.5)
    assert run() == sorted(made + more)  # a restart goes on where it was
    events = spark.read.parquet(out)
    got = {(r.repo, tuple(r.affected_paths)) for r in watch.batches(events).collect()}
    assert got == {("r", ("main.go", "src/lib.rs")), ("q", ("x.ts",)), ("r", ("main.go",)), ("new", ("deep/a/b.py",))}


def test_last_burst_ends_by_timer(stateful, tmp_path):
    spark = stateful
    rows = [("r", "a.go", 0), ("r", "b.go", 3), ("r", "a.go", 8), ("r", "z.go", 20), ("q", "x", 1), ("q", None, 2), ("r", "c.go", 21)]
    events = spark.createDataFrame(rows, "repo string, path string, s long").select("repo", "path", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = debounce.debounced(stream, 5.0).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).start()
    expected = {(r.repo, r.started, r.ended, tuple(r.paths), r.event_count) for r in watch.sessions(events.withColumn("path", F.col("path"))).collect()}
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("bursts").count() < len(expected):
            time.sleep(1)
        got = [(r.repo, r.started, r.ended, tuple(r.paths), r.event_count) for r in spark.table("bursts").collect()]
    finally:
        query.stop()
    assert len(got) == len(expected) == 3 and set(got) == expected
