"""File watching as a stream: bursts of events become batches, and changed paths mark sections stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.functions import paths
from codestrata.operators import knowledge


def sessions(events: DataFrame, gap: str = "5 seconds", late: str | None = None) -> DataFrame:
    """(repo, started, ended, paths, event_count): events (repo, path, ts) of a repository until it is quiet for gap.

    Two events exactly one gap apart share a session. `late` sets a watermark, which streams need to drop state.
    """
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy("repo", F.session_window("ts", gap).alias("w")).agg(
        F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("event_count")
    )
    return grouped.select("repo", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths", "event_count")


def batches(events: DataFrame, gap: str = "5 seconds", late: str | None = None) -> DataFrame:
    """sessions with languages; paths to skip and of unknown language are left out of paths, not of event_count."""
    path, lang = F.col("path"), paths.language(F.col("path"))
    shown = F.when(~paths.skipped_anywhere(path) & lang.isNotNull(), path)
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.withColumn("_shown", shown).withColumn("_lang", F.when(shown.isNotNull(), lang)).groupBy("repo", F.session_window("ts", gap).alias("w")).agg(
        F.array_sort(F.collect_set("_shown")).alias("affected_paths"), F.array_sort(F.collect_set("_lang")).alias("languages"), F.count("*").alias("event_count")
    )
    return grouped.where(F.size("affected_paths") > 0).select("repo", F.col("w.start").alias("started"), "affected_paths", "languages", "event_count")


def windows(events: DataFrame, size: str = "1 minute", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(repo, started, ended, files, event_count) of windows of a fixed size: tumbling, or sliding by `slide`.

    An event belongs to every window that it falls into. In a stream, `late` is how long a window waits for late events;
    later ones are dropped. The number of files is estimated (at most 2 % off, as a rule), so a window's state stays small.
    """
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.where("ts is not null").groupBy("repo", F.window("ts", size, slide or size).alias("w")).agg(F.approx_count_distinct("path", 0.02).alias("files"), F.count("*").alias("event_count"))
    return grouped.select("repo", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "files", "event_count")


def stale_sections(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(repo, path, section) once for each path and section within the watermark."""
    rows = events.select("repo", "path", "ts").withWatermark("ts", late)
    return rows.withColumn("section", F.explode(knowledge.sections(F.col("path")))).dropDuplicatesWithinWatermark(["repo", "path", "section"]).select("repo", "path", "section")


def run(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Start a stream that hands each micro-batch to `handle` and ends when the source is read."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
