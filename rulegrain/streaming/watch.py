"""Rescans as files change: events of a stream are grouped by a quiet gap, and each group is scanned once.

Any change can change any finding of its repository, so a repository is scanned anew, whole; the stream only
says which ones. One batch runs at a time, and what arrives meanwhile makes the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

GAP, GAP_MS = "400 milliseconds", 400
OWN = r"(^|/)(\.rulegrain/|rulegrain-fixes\.md$)"
#: The state store that timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def quiet_changes(events: DataFrame, gap: str = GAP, late: str = "10 seconds", own: str = OWN) -> DataFrame:
    """repo_id, first, last, n: changes (repo_id, path, ts) of a repository with less than gap between them, own outputs left out."""
    foreign = events.filter(~F.col("path").rlike(own)).withWatermark("ts", late)
    return foreign.groupBy("repo_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("repo_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def rescan(events: DataFrame, roots: DataFrame, scan: Callable[[DataFrame], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Call scan with the repositories (repo_id, root) of each micro-batch that had changes."""

    def batch(changed: DataFrame, _: int) -> None:
        todo = roots.join(changed.select("repo_id").distinct(), "repo_id", "left_semi")
        if not todo.isEmpty():
            scan(todo)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="400 milliseconds")).start()


class Quiet(StatefulProcessor):
    """Tells a repository once no change of it has come for a while: each change puts its one timer off."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "changes bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = sum(len(r) for r in rows)
        if self.pending.exists():
            n += self.pending.get()[0]
        self.pending.update((n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        yield pd.DataFrame({"repo_id": [], "changes": []}).astype({"repo_id": str, "changes": "int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n = self.pending.get()[0]
        self.pending.clear()
        yield pd.DataFrame({"repo_id": [key[0]], "changes": [n]})

    def close(self) -> None:
        pass


def settled_changes(events: DataFrame, gap_ms: int = GAP_MS, own: str = OWN) -> DataFrame:
    """repo_id, changes: a stream of repositories whose last change (repo_id, path) is gap_ms ago, once for each burst; own outputs left out.

    The state is a count and one timer for each repository that has just changed. Needs the state store PROVIDER.
    """
    foreign = events.filter(~F.col("path").rlike(own)).select("repo_id", "path")
    return foreign.groupBy("repo_id").transformWithStateInPandas(Quiet(gap_ms), "repo_id string, changes bigint", "Update", "ProcessingTime")


def watch(events: DataFrame, roots: DataFrame, scan: Callable[[DataFrame], None], checkpoint: str, gap_ms: int = GAP_MS) -> StreamingQuery:
    """Call scan with the repositories (repo_id, root) that have been left alone for gap_ms after a change.

    One scan runs at a time. Changes that come while it runs are one burst of the next; however many, they give one scan.
    """
    events.sparkSession.conf.set(*PROVIDER)
    return rescan(settled_changes(events, gap_ms), roots, scan, checkpoint)
