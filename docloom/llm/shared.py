"""What the corpus operators share: the shared folder, written intermediate tables, hashing and ranks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: A word: a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Buckets that split a rank or a running sum: each is sorted in a task of its own.
BUCKET_BITS = 12
#: Rows of a table of keys that may be broadcast.
MOST_BROADCAST = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset, a session on one machine (as in tests)
    gets a folder of its own and any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts go to Python workers in Arrow batches of few rows, unless the session has asked for a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, rows)


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/docloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **measures: Column) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of any executor.

    Aggregates of its rows, their number first, are taken while it is written; seen() gives them.
    """
    spark = df.sparkSession
    path, watch = fresh_path(spark, tag), Observation()
    df.observe(watch, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in measures.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path, out._docloom_seen = path, watch.get
    return out


def seen(table: DataFrame, what: str = "rows") -> int:
    """What written() measured of a table."""
    return table._docloom_seen[what]


def sized(table: DataFrame) -> DataFrame:
    """A table of written() as one side of a join: broadcast if it has few rows, else sorted and merged."""
    return F.broadcast(table) if seen(table) <= MOST_BROADCAST else table.hint("merge")


def with_place(docs: DataFrame, stored: bool = False) -> tuple[DataFrame, str, str]:
    """docs with two columns that tell its rows apart in every reading, and their names: the file and the place in it.

    stored: docs is a Parquet table as it was read; anything else is written first, since a row that is computed
    again may come elsewhere.
    """
    docs = docs if stored else written(docs, "rows")
    at = docs.metadataColumn("_metadata")
    names = spare_name(docs, "file"), spare_name(docs, "at")
    return docs.withColumns({names[0]: F.xxhash64(at["file_path"]), names[1]: at["row_index"]}), *names


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_docloom_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_text(col: str) -> Column:
    """The column as a string, null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free_name(df: DataFrame, name: str) -> str:
    """The name itself where df has no such column, else a spare one."""
    return name if name.lower() not in {c.lower() for c in df.columns} else spare_name(df, name)


def bucket_of(h: Column) -> Column:
    """The leading bits of a 64-bit hash, in unsigned order."""
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def with_running(df: DataFrame, group: str, h: str, amount: Column, out: str, ties: list[str], groups: int | None = None) -> DataFrame:
    """Add the sum of amount over the rows of the same group that come before in the order of (unsigned h, ties).

    Sums by (group, leading bits of h) come first, and only they are summed up in order; rows are sorted within
    their bucket. No task sorts a whole group. Values in h should be spread evenly. groups: how many there are at most;
    the sums of few groups are broadcast.
    """
    keyed = df.withColumn("_bucket", bucket_of(F.col(h))).withColumn("_amount", amount.cast("long"))
    before = W.Window.partitionBy(group).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = (
        keyed.groupBy(group, "_bucket").agg(F.sum("_amount").alias("_sum"))
        .select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    if groups and groups << BUCKET_BITS <= MOST_BROADCAST:
        sums = F.broadcast(sums)
    inside = W.Window.partitionBy(group, "_bucket").orderBy(h, *ties).rowsBetween(W.Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_b")), "left")
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_bucket", "_amount", "_inside", "_group", "_b", "_base")
    )


def appended(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema of df with fields added."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def known_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of every id that has one label, 0 or 1, and isn't held out.

    Null ids and labels, and ids with both labels, are left out.
    """
    kept = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return kept.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def labelled_sample(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most per_class ids of each class, those with the least hashes; held-out ids never.

    At most 2 * per_class rows, so it may be broadcast. Null ids and labels, and ids with both labels, are left out.
    """
    kept = known_labels(labels, label, id_col)
    one = [kept.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return one[0].unionAll(one[1])
