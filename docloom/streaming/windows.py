"""Structured Streaming: quotas and lockouts in event time, ingestion by micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import normalized
from docloom.operators import quality, segments
from docloom.sources.shared import is_folder, shared_dir
from docloom.streaming.lifecycle import TRANSITIONS  # noqa: F401 (its former place)


def table_stream(spark: SparkSession, folder: str, table: str, files_a_trigger: int | None = None) -> DataFrame:
    """A table of a dataset folder as a stream of its files, whether it is one file or a folder of them."""
    path = f"{folder}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def quota_stream(calls: DataFrame, watermark: str = "1 day") -> DataFrame:
    """user_id, day, calls of a stream (user_id, ts); late calls count until the watermark."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("calls")).select("user_id", F.to_date("window.start").alias("day"), "calls")


def failure_stream(failures: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """user_id, window, failures in windows of five minutes that start every minute."""
    timed = failures.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy("user_id", F.window("ts", "5 minutes", "1 minute")).agg(F.count("*").alias("failures"))


def to_end(counts: DataFrame) -> DataFrame:
    """The result of an aggregated stream read to its end, from Parquet files: no row passes through the driver."""
    spark = counts.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    done = []

    def each(batch: DataFrame, epoch: int) -> None:  # complete mode: the last epoch has the whole result
        batch.write.mode("overwrite").parquet(f"{folder}/epoch-{epoch}")
        done.append(epoch)

    run = counts.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if not done:
        return spark.createDataFrame([], counts.schema)
    return spark.read.schema(counts.schema).parquet(f"{folder}/epoch-{max(done)}")


def ingest(texts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that normalizes, grades and chunks each micro-batch (doc_id, text) and hands the chunks to sink."""

    def each(batch: DataFrame, epoch: int) -> None:
        graded = quality.assess(batch).filter("route = 'index'").select("doc_id")
        sink(segments.chunks(normalized(batch.select("doc_id", "text")).join(graded, "doc_id", "left_semi")), epoch)

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
