"""The lifecycle of sources as a stream: keyed state with event-time timers, kept in RocksDB, that a restart takes up again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Which status may follow which; those in which a source rests.
TRANSITIONS = {None: ["queued"], "queued": ["parsing", "failed"], "parsing": ["ocr", "chunking", "failed"], "ocr": ["chunking", "failed"], "chunking": ["embedding", "failed"], "embedding": ["ready", "failed"], "ready": ["queued"], "failed": ["queued"]}
RESTING = ("ready", "failed")
OUTPUT = "source_id string, event_id long, status string, before string, valid boolean, us long"


class Lifecycle(StatefulProcessor):
    """One row for each event, beside the status before it; with a timeout, a row `failed` for a source that stops midway.

    The state of a source is its last status and the time of it. The rows of a source in one trigger are put in order by
    time and number, so a trigger's size bounds what a task sorts; an event older than the last one seen of its source
    (one of an earlier trigger) follows it in the order of arrival.
    """

    def __init__(self, timeout_minutes: int | None) -> None:
        self.timeout = None if timeout_minutes is None else timeout_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        now = found["status"].tolist()
        before = [self.last.get()[0] if self.last.exists() else None, *now[:-1]]
        valid = [s in TRANSITIONS.get(b, []) for s, b in zip(now, before, strict=True)]
        self.last.update((now[-1],))
        if self.timeout is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if now[-1] not in RESTING:
                self.handle.registerTimer(int(found["us"].max()) // 1000 + self.timeout)
        yield pd.DataFrame({"source_id": key[0], "event_id": found["event_id"].to_numpy(), "status": now, "before": before, "valid": valid, "us": found["us"].to_numpy()})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.last.get()[0]
        self.last.update(("failed",))
        us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        yield pd.DataFrame({"source_id": [key[0]], "event_id": pd.array([None], "Int64"), "status": ["failed"], "before": [before], "valid": [True], "us": [us]})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, with changelogs instead of whole snapshots at each trigger; keyed state with timers needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def lifecycle(events: DataFrame, timeout_minutes: int | None = 30, watermark: str = "1 minute") -> DataFrame:
    """source_id, event_id, status, before, valid, at of a stream (source_id, event_id, status, at).

    With a timeout, a source whose last status isn't a resting one fails once the watermark has passed that status by so
    many minutes: a row without event_id. None never fails a source.
    """
    use_rocksdb(events.sparkSession)
    rows = events.select(F.col("source_id").cast("string").alias("source_id"), F.col("event_id").cast("long").alias("event_id"), "status", F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    out = rows.withWatermark("at", watermark).groupBy("source_id").transformWithStateInPandas(Lifecycle(timeout_minutes), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    return out.select("source_id", "event_id", "status", "before", "valid", F.timestamp_micros("us").alias("at"))
