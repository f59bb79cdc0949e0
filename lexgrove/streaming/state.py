"""Keyed state in a stream: what a load changed of each unit, and how far a notification got.

Loads and marks stream in from folders; each key holds a few bytes of state in the checkpointed state store, so a stream
that is stopped, or loses an executor, goes on where its last batch ended and emits nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lexgrove.operators.monitor import STATUSES

LOADED = "load int, unit_id string, text_hash string, in_force boolean, present boolean"
EVENTS = "load int, kind string, unit_id string"
MARKS = "workspace_id long, event_id long, status string, at timestamp"
STATES = "workspace_id long, event_id long, status string, at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def load_rows(before: DataFrame | None, now: DataFrame, load: int) -> DataFrame:
    """The rows that a load sends: every unit of now(unit_id, text_hash, in_force), and a mark for each unit of before that is
    gone from it."""
    rows = now.select(F.lit(load).alias("load"), "unit_id", "text_hash", "in_force", F.lit(True).alias("present"))
    if before is None:
        return rows
    gone = before.select("unit_id", "text_hash").join(now.select("unit_id"), "unit_id", "left_anti")
    return rows.unionByName(gone.select(F.lit(load).alias("load"), "unit_id", "text_hash", F.lit(False).alias("in_force"), F.lit(False).alias("present")))


class UnitStates(StatefulProcessor):
    """A unit's last hash; a later load emits unit_added, unit_text_changed or unit_repealed, the first load nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "text_hash string, in_force boolean, present boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("load").itertuples():
            before = held if held is not None and held[2] else None
            kind = None
            if before is not None and before[1] and not (r.present and r.in_force):
                kind = "unit_repealed"
            elif before is None and r.in_force and r.load > 1:
                kind = "unit_added"
            elif before is not None and r.present and before[0] != r.text_hash:
                kind = "unit_text_changed"
            if kind:
                out.append((r.load, kind, key[0]))
            held = (r.text_hash, bool(r.in_force), bool(r.present))
        self.held.update(held)
        yield pd.DataFrame(out, columns=["load", "kind", "unit_id"]).astype({"load": "int32"})

    def close(self) -> None:
        pass


class NotificationStates(StatefulProcessor):
    """A notification's furthest status; an open one that nobody saw ``days`` after it came expires by a timer."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "rank int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        marks = pd.concat(list(rows)).sort_values("at")
        rank = self.status.get()[0] if self.status.exists() else -1
        out = []
        for m in marks.itertuples():
            if rank < 0:
                self.handle.registerTimer(int(m.at.timestamp() * 1000) + self.days * 86_400_000)
            if rank < len(STATUSES) and STATUSES.index(m.status) > rank:
                rank = STATUSES.index(m.status)
                out.append((*key, m.status, m.at))
        self.status.update((rank,))
        yield pd.DataFrame(out, columns=["workspace_id", "event_id", "status", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.status.get()[0] == STATUSES.index("open"):
            self.status.update((len(STATUSES),))
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame([(*key, "expired", at)], columns=["workspace_id", "event_id", "status", "at"])

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """State of this kind needs the store that keeps it beside the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _started(spark: SparkSession, out: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Written to target, until what is there is done; runs in the caller's session settings."""
    query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return query


def unit_events(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Events of the loads in a folder (``LOADED`` rows) that were not read yet, one load a batch, added to target."""
    loads = spark.readStream.schema(LOADED).option("maxFilesPerTrigger", 1_000).parquet(folder)
    with _rocks(spark):
        return _started(spark, loads.groupBy("unit_id").transformWithStateInPandas(UnitStates(), EVENTS, "Append", "None"), target, checkpoint)


def notification_states(spark: SparkSession, folder: str, target: str, checkpoint: str, days: int = 30, late: str = "1 day") -> StreamingQuery:
    """Every step of the notifications whose marks (``MARKS`` rows) stream in from a folder, expiry included."""
    marks = spark.readStream.schema(MARKS).parquet(folder).withWatermark("at", late)
    with _rocks(spark):
        return _started(spark, marks.groupBy("workspace_id", "event_id").transformWithStateInPandas(NotificationStates(days), STATES, "Append", "EventTime"), target, checkpoint)
