"""An exactly-once sink by epoch, and progress events of sources that a stream takes in."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docloom.sources.shared import exists


class EpochSink:
    """Epochs of a stream as Parquet folders at a path, each counted once however often it is written.

    An epoch is written to a folder of its own; then a small file named by the epoch is put in place by one rename, which
    makes it part of the table. An epoch that has such a file is not written again, and a folder without one (of a task
    or a driver that died) is never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def _file(self, epoch: int) -> str:
        return f"{self.path}/finished/{epoch:012d}"

    def write(self, batch: DataFrame, epoch: int, counted: str = "true", keep_empty: bool = True) -> int:
        """For foreachBatch: the number of rows written for which `counted` holds. Without keep_empty an epoch of no rows is left out."""
        if exists(self.spark, self._file(epoch)):
            return 0
        name, watch = f"epoch-{epoch:012d}-{uuid4().hex}", Observation()
        batch.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(counted)).alias("counted")).write.parquet(f"{self.path}/data/{name}")
        if not watch.get["rows"] and not keep_empty:
            return 0
        jvm = self.spark._jvm
        new, final = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{self.path}/unfinished/{name}", self._file(epoch)))
        fs = final.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(new, False)
        out.write(bytearray(name.encode()))
        out.close()
        fs.mkdirs(final.getParent())
        if not fs.rename(new, final) and not exists(self.spark, self._file(epoch)):
            raise OSError(f"epoch {epoch} could not be finished at {self.path}")
        return watch.get["counted"]

    def epochs(self) -> DataFrame:
        """epoch, folder of the finished epochs."""
        if not exists(self.spark, f"{self.path}/finished"):
            return self.spark.createDataFrame([], "epoch long, folder string")
        files = self.spark.read.text(f"{self.path}/finished", wholetext=True)
        return files.select(F.regexp_extract(F.col("_metadata.file_name"), "\\d+", 0).cast("long").alias("epoch"), F.col("value").alias("folder"))

    def table(self) -> DataFrame:
        """The rows of all finished epochs; a name an epoch reaches the driver."""
        folders = [f"{self.path}/data/{r.folder}" for r in self.epochs().select("folder").collect()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def run(self, stream: DataFrame, mode: str = "append", make: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
        """Start a query that writes what `make` makes of each batch until the source has no more; a later one goes on."""
        each = lambda batch, epoch: self.write(make(batch) if make else batch, epoch)
        return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()


def to_end(stream: DataFrame, path: str, mode: str = "append", make: Callable[[DataFrame], DataFrame] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a stream read to its end through an EpochSink at a path."""
    sink = EpochSink(stream.sparkSession, path, schema or stream.schema)
    sink.run(stream, mode, make).awaitTermination()
    return sink.table()


# Progress of a source in percent and the label's key at each status, kinds of event.
STAGES = {"queued": (0, "ingest.queued"), "parsing": (20, "ingest.parsing"), "ocr": (40, "ingest.ocr"), "chunking": (60, "ingest.chunking"), "embedding": (80, "ingest.indexing"), "ready": (100, "ingest.ready")}


def _event(kind: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def progress_events(sources: DataFrame, key: str = "source_id") -> DataFrame:
    """key, no, event: what a listener hears of each source, in the order of no.

    sources: key, error_code (null if the source was taken in), ocr (whether its pages were recognized), page_count,
    chunk_count. A source passes through its statuses to `ready`, which gives its totals, or stops after `parsing` with
    an error. Events are JSON.
    """
    names = [s for s in STAGES if s != "ready"]
    good, of = F.col("error_code").isNull(), F.col(key)
    status = lambda s: _event("source_status", source_id=of, status=F.lit(s), progress=F.lit(STAGES[s][0]), stage_label_key=F.lit(STAGES[s][1]))
    heard = [F.when(F.lit(s in ("queued", "parsing")) | (good & (F.lit(s != "ocr") | F.col("ocr"))), status(s)) for s in names]
    ready = F.when(good, _event("source_ready", source_id=of, page_count=F.col("page_count"), chunk_count=F.col("chunk_count")))
    failed = F.when(~good, _event("source_failed", source_id=of, error_code=F.col("error_code"), error_message=F.concat(F.lit("error."), F.lower("error_code"))))
    return sources.select(key, F.posexplode(F.array_compact(F.array(*heard, ready, failed))).alias("no", "event"))
