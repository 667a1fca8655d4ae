"""A versioned store of chunks: an edit makes only the chunks of changed sections anew, and loses nothing else.

Sections of a source are known by the hash of their text, and chunks are kept by source and section. Storing a source writes
the list of its sections under a new version and chunks only those sections that the store hasn't got; removing it writes a
tombstone. Nothing is overwritten: a version is part of the store once its file is renamed into place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import estimate_tokens
from docloom.operators import segments
from docloom.streaming.sinks import EpochSink

SECTION = "no int, at int, path string, hash binary"
CHUNK = "hash binary, k int, lo int, hi int, token_count int, content string"
#: Stored sources that a batch touches, up to which their hashes are broadcast, so that no text is shuffled.
MOST_BROADCAST = 100_000


def greedy(sections: DataFrame, key: str) -> DataFrame:
    """key and the columns of CHUNK for sections (key, hash, body)."""
    made = segments.chunks(sections, key, "body", respect_headings=False, keep=("hash",))
    return made.select(key, "hash", F.col("chunk_index").alias("k"), F.col("char_start").alias("lo"), F.col("char_end").alias("hi"), "token_count", "content")


def windows(sections: DataFrame, key: str) -> DataFrame:
    """As greedy, in windows of a fixed size."""
    made = segments.fixed_chunks(sections, key, "body", keep=("hash",))
    step = segments.FIXED_SIZE - segments.FIXED_OVERLAP
    return made.select(key, "hash", (F.col("char_start") / step).cast("int").alias("k"), F.col("char_start").alias("lo"), F.col("char_end").alias("hi"), estimate_tokens(F.col("content")).alias("token_count"), "content")


class ChunkStore:
    """Chunks at a path, by source. One writer at a time: a second one with the same version fails and can try again.

    cut gives the sections of a text (at, path, body); make gives the chunks of sections. Both hold for the whole store.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "long", cut: Callable[[Column], Column] = segments.section_array, make: Callable[[DataFrame, str], DataFrame] = greedy) -> None:
        self.spark, self.path, self.key, self.cut, self.make = spark, path, key, cut, make
        self.lists = EpochSink(spark, f"{path}/lists", T.StructType.fromDDL(f"version long, {key} {key_type}, {SECTION}"))
        self.bodies = EpochSink(spark, f"{path}/bodies", T.StructType.fromDDL(f"{key} {key_type}, {CHUNK}"))

    def version(self) -> int:
        """The newest version, 0 for an empty store."""
        return self.lists.epochs().agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]

    def put(self, docs: DataFrame, col: str = "norm") -> dict[str, int]:
        """Store the sources of a table (key, text) in place of what the store has of them; all others stay.

        Returns how many sources were new or changed and how many sections were chunked. A source that is stored as it is
        writes nothing. Null and empty texts are sources without chunks; a source may come once. Sections, hashes and chunks
        are made in the row of a source; texts are shuffled only where a batch touches more than MOST_BROADCAST sources
        that are stored already.
        """
        of = lambda s, i: F.struct(i.alias("no"), s["at"].alias("at"), s["path"].alias("path"), s["body"].alias("body"), F.unhex(F.sha2(s["body"].cast("binary"), 256)).alias("hash"))
        cut = docs.select(self.key, F.transform(self.cut(F.coalesce(F.col(col), F.lit(""))), of).alias("s"))
        version = self.version() + 1
        if version > 1:
            had = self._state().join(docs.select(self.key), self.key, "left_semi")
            had = F.broadcast(had) if had.count() <= MOST_BROADCAST else had
            cut = cut.join(had, self.key, "left").filter(F.col("digest").isNull() | (F.col("digest") != _digest(F.col("s"))))
            known = F.coalesce(F.array_distinct(F.concat("bodies", "listed")), F.array().cast("array<binary>"))
        else:
            known = F.array().cast("array<binary>")
        fresh = F.filter("s", lambda x, i: ~F.array_contains("_known", x["hash"]) & (F.array_position(F.transform("s", lambda y: y["hash"]), x["hash"]) == i + 1))
        new = cut.withColumn("_known", known).select(self.key, F.explode(fresh).alias("x")).select(self.key, "x.hash", "x.body")
        sections = self.bodies.write(self.make(new, self.key), version, "k = 0", keep_empty=False)
        rows = cut.select(self.key, F.explode_outer("s").alias("x")).select(F.lit(version).cast("long").alias("version"), self.key, "x.no", "x.at", "x.path", "x.hash")
        return {"sources": self.lists.write(rows, version, "coalesce(no, 0) = 0", keep_empty=False), "sections": sections}

    def _state(self) -> DataFrame:
        """key, digest of the newest list of sections, listed and bodies: the hashes in it and those that have chunks."""
        one = F.struct("no", "at", "path", "hash")
        lists = self.sections().groupBy(self.key).agg(F.array_sort(F.collect_list(F.when(F.col("no").isNotNull(), one))).alias("s"))
        lists = lists.select(self.key, _digest(F.col("s")).alias("digest"), F.transform("s", lambda x: x["hash"]).alias("listed"))
        bodies = self.bodies.table().groupBy(self.key).agg(F.collect_set("hash").alias("bodies"))
        return lists.join(bodies, self.key, "left").withColumn("bodies", F.coalesce("bodies", F.array().cast("array<binary>")))

    def remove(self, keys: DataFrame) -> None:
        """Put a tombstone on each source of a table (key): a version without sections."""
        version = self.version() + 1
        none = keys.select(F.lit(version).cast("long").alias("version"), self.key, *[F.lit(None).cast(t).alias(c) for c, t in (("no", "int"), ("at", "int"), ("path", "string"), ("hash", "binary"))])
        self.lists.write(none, version, keep_empty=False)

    def sections(self) -> DataFrame:
        """version, key, no, at, path, hash of each source's newest version; sources without text have one row without no."""
        rows = self.lists.table()
        newest = rows.groupBy(self.key).agg(F.max("version").alias("version"))
        return rows.join(newest, [self.key, "version"])

    def chunks(self) -> DataFrame:
        """The rows of segments.chunks for all stored sources: no text is numbered or put in order."""
        rows = self.sections().filter("no is not null")
        bodies = self.bodies.table()
        count = bodies.groupBy(self.key, "hash").agg(F.count("*").alias("n"))
        before = Window.partitionBy(self.key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.join(count, [self.key, "hash"]).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        both = placed.join(bodies, [self.key, "hash"])
        at = lambda c: (F.col("at") + F.col(c)).cast("int")
        return both.select(self.key, (F.col("base") + F.col("k")).cast("int").alias("chunk_index"), at("lo").alias("char_start"), at("hi").alias("char_end"), "token_count", F.col("path").alias("heading_path"), "content")


def _digest(sections: Column) -> Column:
    """A hash of a list of sections: their places, paths and hashes in order."""
    line = lambda s: F.concat_ws(":", s["no"].cast("string"), s["at"].cast("string"), F.hex(s["hash"]), F.coalesce(F.concat(F.lit("p"), s["path"]), F.lit("-")))
    return F.sha2(F.array_join(F.transform(sections, line), "\n").cast("binary"), 256)
