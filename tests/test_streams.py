"""Streams with keyed state, the exactly-once sink, tables as streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from docloom.plans import catalog, records  # noqa: F401 (registers its queries)
from docloom.sources.shared import fresh_path
from docloom.streaming import expiry, lifecycle, sinks, windows


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def folder(spark, rows, schema):
    """A dataset folder whose table t is in several files, written one after the other."""
    path = fresh_path(spark, "t")
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/t.parquet")
    return path


STATUS = "source_id string, event_id long, status string, at timestamp"


def test_a_table_folder_streams_all_its_files(spark):
    rows = [[(str(i), i, "queued", at(i))] for i in range(3)]
    path = folder(spark, rows, STATUS)
    stream = windows.table_stream(spark, path, "t", files_a_trigger=1)
    assert sinks.to_end(stream, fresh_path(spark, "t")).count() == 3
    events = "/root/testdata/sf0.001"
    spark.read.parquet(f"{events}/events.parquet").repartition(3).write.parquet(f"{path}/events.parquet")
    for name in ("daily_quota_stream", "failure_windows"):
        one, three = (sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) for d in (events, path))
        assert one == three and one


def test_lifecycle_goes_on_after_a_restart_and_fails_idle_sources(spark):
    rows = [[("a", 1, "queued", at(0)), ("a", 2, "parsing", at(1)), ("b", 3, "queued", at(2)), ("c", 4, "ready", at(3))]]
    path, out = folder(spark, rows, STATUS), fresh_path(spark, "t")
    run = lambda: sinks.to_end(lifecycle.lifecycle(windows.table_stream(spark, path, "t"), 30), out)
    first = {(r.source_id, r.event_id, r.status, r.before, r.valid) for r in run().collect()}
    assert first == {("a", 1, "queued", None, True), ("a", 2, "parsing", "queued", True), ("b", 3, "queued", None, True), ("c", 4, "ready", None, False)}
    more = [("a", 5, "chunking", at(20)), ("a", 6, "ready", at(21)), ("d", 7, "queued", at(500))]
    spark.createDataFrame(more, STATUS).coalesce(1).write.mode("append").parquet(f"{path}/t.parquet")
    later = {(r.source_id, r.event_id, r.status, r.before, r.valid): r.at for r in run().collect()}
    new = {k: v for k, v in later.items() if k not in first}
    # a came back in time and rests; b was idle for 30 minutes; the state of both was taken up from the checkpoint
    assert set(new) == {("a", 5, "chunking", "parsing", True), ("a", 6, "ready", "chunking", False), ("d", 7, "queued", None, True), ("b", None, "failed", "queued", True)}
    assert new["b", None, "failed", "queued", True] == at(32) and len(later) == len(first) + 4


def test_replayed_epochs_add_no_row(spark):
    sink = sinks.EpochSink(spark, fresh_path(spark, "t"), sinks.T.StructType.fromDDL("x long"))
    assert sink.table().count() == 0
    for epoch in (0, 1, 1, 0, 2):
        sink.write(spark.range(10 * epoch, 10 * epoch + 3).toDF("x"), epoch)
    spark.range(5).toDF("x").write.parquet(f"{sink.path}/data/epoch-000000000003-lost")  # a writer that died before its end
    assert sorted(r.x for r in sink.table().collect()) == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    assert [r.epoch for r in sink.epochs().orderBy("epoch").collect()] == [0, 1, 2]


def test_progress_events(spark):
    rows = [(1, None, False, 3, 7), (2, None, True, 2, 4), (3, "TEXT_EMPTY", False, 0, 0)]
    df = spark.createDataFrame(rows, "source_id long, error_code string, ocr boolean, page_count int, chunk_count int")
    heard = {}
    for r in sinks.progress_events(df).orderBy("source_id", "no").collect():
        heard.setdefault(r.source_id, []).append(json.loads(r.event))
    states = lambda k: [e.get("status", e["type"]) for e in heard[k]]
    assert states(1) == ["queued", "parsing", "chunking", "embedding", "source_ready"] and states(2)[2] == "ocr"
    assert states(3) == ["queued", "parsing", "source_failed"] and heard[3][-1]["error_code"] == "TEXT_EMPTY"
    assert heard[1][-1] == {"type": "source_ready", "source_id": 1, "page_count": 3, "chunk_count": 7}
    assert [e["progress"] for e in heard[2][:-1]] == [0, 20, 40, 60, 80] and heard[2][2]["stage_label_key"] == "ingest.ocr"


CACHE = "key string, event_id long, put boolean, at timestamp"


def test_cache_entries_expire_by_timer_and_by_lookup(spark):
    """Over several triggers the stream gives what the batch rule gives of the whole table."""
    first = [("a", 1, True, at(0)), ("a", 2, False, at(5)), ("b", 3, True, at(1)), ("c", 4, False, at(2)), ("e", 9, True, at(3))]
    second = [("a", 5, False, at(10)), ("b", 6, True, at(9)), ("c", 7, True, at(11)), ("e", 10, False, at(14))]
    third = [("d", 8, True, at(300)), ("c", 11, False, at(301))]
    path = folder(spark, [first, second, third], CACHE)
    got = sinks.to_end(expiry.cache_stream(windows.table_stream(spark, path, "t", files_a_trigger=1), 10), fresh_path(spark, "t"))
    rows = spark.read.parquet(f"{path}/t.parquet")
    mark = int((at(301) - dt.timedelta(minutes=1) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = expiry.cache_batch(rows, 10, mark)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
    kinds = {(r.key, r.event_id): r.kind for r in got.filter(F.col("event_id").isNotNull()).collect()}
    assert kinds["a", 2] == "hit" and kinds["a", 5] == "miss" and kinds["e", 10] == "miss" and kinds["c", 11] == "miss"
    assert sorted((r.key, r.entry_id) for r in got.filter("kind = 'expired'").collect()) == [("a", 1), ("b", 6), ("c", 7), ("e", 9)]
