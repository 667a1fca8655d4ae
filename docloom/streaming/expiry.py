"""The answer cache as a stream: entries with a time to live, questions that look them up, expiries as events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.streaming.lifecycle import use_rocksdb

OUTPUT = "key string, event_id long, kind string, entry_id long, us long"
KINDS = ("stored", "hit", "miss", "expired")


class Cache(StatefulProcessor):
    """One entry a key. A row `put` stores an entry in place of the one before; a row `ask` hits it while it lives.

    An entry lives from its time for `ttl` and is gone at that moment itself. It expires by an event-time timer once the
    watermark has passed, or as soon as a later row of its key shows that its time is over, whichever comes first; each
    entry that isn't replaced in its lifetime expires once.
    """

    def __init__(self, ttl_us: int) -> None:
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "entry_id long, us long")

    def _expired(self, key: tuple, entry: tuple) -> tuple:
        return key[0], None, "expired", entry[0], entry[1] + self.ttl

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entry = self.entry.get() if self.entry.exists() else None
        was, out = entry, []
        for r in pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable").itertuples():
            if entry is not None and r.us >= entry[1] + self.ttl:
                out.append(self._expired(key, entry))
                entry = None
            if r.put:
                entry = (int(r.event_id), int(r.us))
                out.append((key[0], r.event_id, "stored", r.event_id, r.us))
            else:
                out.append((key[0], r.event_id, "hit" if entry else "miss", entry[0] if entry else None, r.us))
        if entry != was:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if entry is None:
                self.entry.clear()
            else:
                self.entry.update(entry)
                self.handle.registerTimer(-(-(entry[1] + self.ttl) // 1000))
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entry = self.entry.get()
        self.entry.clear()
        yield _frame([self._expired(key, entry)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    key, event, kind, entry, us = zip(*rows, strict=True) if rows else [()] * 5
    return pd.DataFrame({"key": list(key), "event_id": pd.array(event, "Int64"), "kind": list(kind), "entry_id": pd.array(entry, "Int64"), "us": pd.array(us, "Int64")})


def cache_stream(rows: DataFrame, ttl_minutes: int, watermark: str = "1 minute") -> DataFrame:
    """key, event_id, kind, entry_id, us of a stream (key, event_id, put, at): KINDS of what happens, in microseconds.

    The rows of a key in one trigger are put in order by time and number. Null keys are a key of their own.
    """
    use_rocksdb(rows.sparkSession)
    us = F.unix_micros(F.col("at").cast("timestamp"))
    asked = rows.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), "put", us.alias("us"), F.col("at").cast("timestamp").alias("at"))
    return asked.withWatermark("at", watermark).groupBy("key").transformWithStateInPandas(Cache(ttl_minutes * 60_000_000), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def cache_batch(rows: DataFrame, ttl_minutes: int, end_us: int | None = None) -> DataFrame:
    """What cache_stream gives, of a table: the last entry before each row tells whether it hits.

    Entries whose time is over at end_us expire as well; without it those whose time a later row of their key has reached.
    """
    ttl = ttl_minutes * 60_000_000
    r = rows.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), "put", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    w = W.Window.partitionBy("key").orderBy("us", "event_id")
    entry = F.when(F.col("put"), F.struct("event_id", "us"))
    r = r.withColumn("held", F.last(entry, True).over(w.rowsBetween(W.Window.unboundedPreceding, -1)))
    alive = F.col("held").isNotNull() & (F.col("us") < F.col("held.us") + ttl)
    kind = F.when(F.col("put"), "stored").when(alive, "hit").otherwise("miss")
    heard = r.select("key", "event_id", kind.alias("kind"), F.when(F.col("put"), F.col("event_id")).when(alive, F.col("held.event_id")).alias("entry_id"), "us")
    puts = rows.filter("put").select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("entry_id"), (F.unix_micros(F.col("at").cast("timestamp")) + ttl).alias("ends"))
    later = W.Window.partitionBy("key").orderBy("ends", "entry_id")
    last = rows.groupBy(F.col("key").cast("string").alias("_k")).agg(F.max(F.unix_micros(F.col("at").cast("timestamp"))).alias("last"))
    puts = puts.withColumn("replaced", F.lead("ends").over(later) - ttl).join(last, F.col("key").eqNullSafe(F.col("_k")))
    reach = F.col("last") if end_us is None else F.greatest("last", F.lit(end_us))
    gone = puts.filter((F.col("replaced").isNull() & (F.col("ends") <= reach)) | (F.col("replaced") >= F.col("ends")))
    none = F.lit(None).cast("long")
    return heard.unionByName(gone.select("key", none.alias("event_id"), F.lit("expired").alias("kind"), "entry_id", F.col("ends").alias("us")))
