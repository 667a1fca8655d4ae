"""Who may see what: owners' notebooks, shared links, deletion down the tree, totals; changed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.shared import delete, exists, stored


def visible(requests: DataFrame, notebooks: DataFrame) -> DataFrame:
    """The requests (notebook_id, user_id, ..) for a notebook of that user; a foreign one is as if it weren't there."""
    return requests.join(notebooks.select("notebook_id", "user_id"), ["notebook_id", "user_id"], "left_semi")


def opened(requests: DataFrame, links: DataFrame) -> DataFrame:
    """The requests (token, ..) whose link is not revoked, with its notebook_id."""
    return requests.join(links.filter("revoked_at is null").select("token", "notebook_id"), "token")


def cascade(parents: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose parent isn't among those gone."""
    return parents.join(gone.select(key), key, "left_anti")


def hydrated(citations: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """citations (chunk_id, ..) with their chunk and its source; citations of chunks that are gone drop out."""
    return citations.join(chunks, "chunk_id").join(sources, "source_id")


def changed_chunks(new: DataFrame, old: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chunks of new that old doesn't hold at the same place with the same content: what an edit makes anew."""
    same = [key, "char_start", "char_end", "digest"]
    digest = F.xxhash64("content").alias("digest")
    return new.withColumn("digest", digest).join(old.select(key, "char_start", "char_end", digest), same, "left_anti").drop("digest")


def store_chunks(chunks: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Write the chunks of the sources at hand in place of what a plain table has of them; other sources stay as they are.

    Buckets that hold one of the sources are read, put together with the new rows in the shared folder and written anew; doing
    it twice changes nothing. chunk_store.ChunkStore keeps versions and chunks only what has changed.
    """
    spark = chunks.sparkSession
    new, rows, new_at = stored(chunks.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "chunks-new")
    if rows and exists(spark, path):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        had = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched))
        new = new.unionByName(had.join(new.select(key).distinct(), key, "left_anti"))
    both, _, at = stored(new, "chunks-both")
    both.repartition("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    delete(spark, new_at, at)


def ratio(flag: Column) -> Column:
    """The share of rows for which a flag holds, to six places."""
    return F.round(F.avg(flag.cast("int")), 6)
