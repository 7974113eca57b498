"""Bursts of events as batches that end by a timer: also the last one, after which a repository falls silent.

Sessions of watch.sessions() end when a later event moves the watermark; here each repository has a state (the open
burst: its paths, count, first and last moment) and a timer in processing time. Events further apart than the gap belong
to two bursts even if they arrive together, so a burst is what watch.sessions() makes of the same events.

Cases: null paths count as events and are no path; an event that comes late but within the gap of the open burst joins
it; one that is older is a burst of its own; a null repository is one of its own; null moments are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUTPUT = "repo string, started timestamp, ended timestamp, paths array<string>, event_count long"
#: A burst's paths are rows of the state, one for each, so a burst of very many files is no large value.
_BURST, _PATH = "started long, last long, count long, timer long", "path string"


class Debounce(StatefulProcessor):
    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", _BURST)
        self.paths = handle.getMapState("paths", _PATH, "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        at = events["ms"].to_numpy()
        out, state = [], self.burst.get() if self.burst.exists() else None
        open_ = [*state] if state is not None else None
        for ms, path in sorted(zip(at.tolist(), events["path"].tolist(), strict=True), key=lambda x: x[0]):
            if open_ and ms < open_[0] - self.gap:
                out.append(self._row(key, ms, ms, [] if path is None else [path], 1))
                continue
            if open_ and ms > open_[1] + self.gap:
                out.append(self._close(key, open_))
                open_ = [None, None, 0, open_[3]]
            open_ = open_ or [None, None, 0, None]
            open_[0] = ms if open_[0] is None else min(open_[0], ms)
            open_[1] = ms if open_[1] is None else max(open_[1], ms)
            open_[2] += 1
            if path is not None:
                self.paths.updateValue((path,), (True,))
        if open_ and open_[2]:
            if open_[3] is not None:
                self.handle.deleteTimer(open_[3])
            open_[3] = timerValues.getCurrentProcessingTimeInMs() + self.gap
            self.handle.registerTimer(open_[3])
            self.burst.update(tuple(open_))
        if out:
            yield pd.DataFrame(out, columns=["repo", "started", "ended", "paths", "event_count"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.burst.exists():
            row = self._close(key, [*self.burst.get()])
            self.burst.clear()
            yield pd.DataFrame([row], columns=["repo", "started", "ended", "paths", "event_count"])

    def close(self) -> None:
        pass

    def _close(self, key, burst: list) -> tuple:
        paths = sorted(p[0] for p in self.paths.keys())
        self.paths.clear()
        return self._row(key, burst[0], burst[1], paths, burst[2])

    def _row(self, key, started: int, last: int, paths: list[str], count: int) -> tuple:
        return key[0], pd.Timestamp(started, unit="ms"), pd.Timestamp(last + self.gap, unit="ms"), paths, count


def debounced(events: DataFrame, gap_seconds: float = 5.0) -> DataFrame:
    """(repo, started, ended, paths, event_count) of a stream of events (repo, path, ts), each burst once it is over.

    The state needs the RocksDB provider (spark.sql.streaming.stateStore.providerClass) and a session in UTC.
    """
    rows = events.where("ts is not null").select("repo", "path", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("repo").transformWithStateInPandas(Debounce(int(gap_seconds * 1000)), OUTPUT, outputMode="append", timeMode="processingTime")
