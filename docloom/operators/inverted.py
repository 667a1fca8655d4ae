"""A stored inverted index: lexemes in buckets on disk, positions in delta-coded blocks, document counts beside them.

A search reads the buckets of the lexemes that it asks for, and of these only the blocks of those lexemes. A block holds a
lexeme's postings in one segment, documents that a task reads one after the other; so the lists of a segment's documents meet in one
task, where phrases are found by intersection, and no posting becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import lexemes as lexemes_of
from docloom.sources.shared import exists

#: Buckets of lexemes; documents of a segment at most; terms of questions that are looked up at once.
BUCKETS, SEGMENT, AT_ONCE = 64, 2048, 100_000
ROW = "lexeme string, segment long, doc_steps array<long>, pos_steps array<int>, docs int"


def bucket_of(lexeme: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the index for batches of (key, lexemes): a segment is known by its task and batch."""
    from pyspark import TaskContext

    segment = TaskContext.get().partitionId() << 32
    for b in (whole.slice(i, SEGMENT) for whole in batches for i in range(0, whole.num_rows, SEGMENT)):
        words = b.column(1)
        sizes = words.value_lengths().to_numpy()
        coded = words.flatten().dictionary_encode()
        doc = np.repeat(b.column(0).to_numpy(), sizes)
        pos = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        code = coded.indices.to_numpy()
        order = np.lexsort((pos, doc, code))
        code, doc, pos = code[order], doc[order], pos[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))  # where each lexeme begins
        other = np.ones(len(doc), bool)  # where a document begins
        other[1:] = (np.diff(code) != 0) | (np.diff(doc) != 0)
        doc_steps = np.diff(doc, prepend=0)
        doc_steps[first] = doc[first]
        pos_steps = np.where(other, pos, np.diff(pos, prepend=0)).astype(np.int32)
        offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
        docs = np.add.reduceat(other, first) if len(first) else np.zeros(0)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (doc_steps, pos_steps)]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), segment)), *lists, pa.array(docs.astype(np.int32))], ["lexeme", "segment", "doc_steps", "pos_steps", "docs"])
        segment += 1


def build(docs: DataFrame, path: str, key: str = "doc_id", norm: str = "norm", buckets: int = BUCKETS) -> None:
    """Write the index of texts (key long, norm) to a path.

    A row holds a lexeme's postings in a segment: steps from one document to the next, and from one position to the next,
    the first of a document counted from 0. Only these lists are shuffled, to the files of their bucket. Null keys are left
    out; a document may come once only.
    """
    each = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), lexemes_of(F.col(norm)).alias("w"))
    rows = each.mapInArrow(_segments, ROW).withColumn("bucket", bucket_of(F.col("lexeme"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/shape")


class Stored:
    """The index at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        if not exists(spark, f"{path}/shape"):
            raise ValueError(f"no index at {path}")
        self.spark, self.path = spark, path
        self.buckets = spark.read.parquet(f"{path}/shape").first()[0]

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{ROW}, bucket int").parquet(f"{self.path}/postings")

    def counts(self, lexemes: DataFrame | None = None) -> DataFrame:
        """lexeme, docs, occurrences of all lexemes, or of those asked for; no posting is decoded."""
        rows = self.blocks() if lexemes is None else self._asked(lexemes)
        return rows.groupBy("lexeme").agg(F.sum("docs").alias("docs"), F.sum(F.size("pos_steps")).alias("occurrences"))

    def _asked(self, lexemes: DataFrame) -> DataFrame:
        """The blocks of asked lexemes, from their buckets only; at most `buckets` numbers reach the driver."""
        asked = lexemes.select("lexeme").distinct().withColumn("bucket", bucket_of(F.col("lexeme"), self.buckets))
        some = [r.bucket for r in asked.select("bucket").distinct().collect()]
        return self.blocks().filter(F.col("bucket").isin(some)).join(asked, ["bucket", "lexeme"], "left_semi")

    def postings(self, lexemes: DataFrame, key: str = "doc_id") -> DataFrame:
        """key, pos, lexeme of the lexemes of a table, as retrieval.postings gives them for all."""
        rows = self._asked(lexemes).select("lexeme", "doc_steps", "pos_steps")
        schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("lexeme", T.StringType())])
        return rows.mapInArrow(_decoder(key), schema)

    def occurrences(self, terms: DataFrame, key: str = "doc_id") -> DataFrame:
        """query_id, part, length, key, at: retrieval.occurrences in the documents that hold every part of a query.

        terms: query_id, part, ordinal, lexeme, length. They are sent to the tasks, in blocks of about AT_ONCE rows by a hash of
        their query. A task takes the lists of one segment and intersects them.
        """
        asked = terms.select("query_id", "part", "ordinal", "lexeme", "length")
        blocks = max(1, -(-asked.count() // AT_ONCE))
        kind = asked.schema["query_id"].dataType
        schema = T.StructType([T.StructField("query_id", kind), T.StructField("part", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("at", T.IntegerType())])

        def search(some: DataFrame) -> DataFrame:
            return self._asked(some).drop("bucket", "docs").groupBy("segment").applyInArrow(_finder(_questions(some.collect()), key, pa_type(kind)), schema)

        each = [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)]
        return reduce(DataFrame.unionByName, [search(x) for x in each])


def pa_type(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind.simpleString(), pa.int64())


def decoded(doc_steps: np.ndarray, pos_steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and positions of one row of the index."""
    docs = np.cumsum(doc_steps, dtype=np.int64)
    first = np.concatenate([[True], docs[1:] != docs[:-1]])
    run = np.cumsum(pos_steps, dtype=np.int64)
    base = (run - pos_steps)[first]  # what the sum had reached before each document
    return docs, run - base[np.cumsum(first) - 1]


def _lists(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy()


def _decoder(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row is a block of postings
                docs, pos = decoded(_lists(b.column(1), i), _lists(b.column(2), i))
                word = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(docs), np.int32)), b.column(0)[i : i + 1]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(pos.astype(np.int32)), word], [key, "pos", "lexeme"])

    return run


def _questions(rows: list) -> dict:
    """part -> (length, [(ordinal, lexeme)]) of each query."""
    out: dict = {}
    for query, part, ordinal, lexeme, length in rows:
        out.setdefault(query, {}).setdefault(part, (length, []))[1].append((ordinal, lexeme))
    return out


def _finder(questions: dict, key: str, kind: pa.DataType):
    wanted = {q: {lexeme for _, words in parts.values() for _, lexeme in words} for q, parts in questions.items()}

    def run(segment: pa.Table) -> pa.Table:
        lexemes = segment.column("lexeme").to_pylist()
        at = {x: i for i, x in enumerate(lexemes)}
        columns = [segment.column(c).combine_chunks() for c in ("doc_steps", "pos_steps")]
        known: dict[str, np.ndarray] = {}
        docs = np.zeros(0, np.int64)

        def places(lexeme: str) -> np.ndarray:
            """The postings of a lexeme as numbers in order: document, then position."""
            if lexeme not in known:
                d, pos = decoded(*[_lists(c, at[lexeme]) for c in columns])
                known[lexeme] = (np.searchsorted(docs, d) << 32) + pos
            return known[lexeme]

        out = []
        names = [q for q, words in wanted.items() if words <= at.keys()]
        if names:
            docs = np.unique(np.concatenate([np.cumsum(_lists(columns[0], at[x])) for x in set().union(*[wanted[q] for q in names])]))
        for q in names:
            found = []
            for part, (length, words) in questions[q].items():
                # a phrase begins where each of its words stands so many places later
                hit = reduce(lambda a, b: a[np.isin(a, b, assume_unique=True)], sorted((places(x)[places(x) & 0xFFFFFFFF >= k] - k for k, x in words), key=len))
                if not len(hit):
                    break
                found.append((part, length, hit))
            else:
                shared = reduce(np.intersect1d, [hit >> 32 for *_, hit in found])
                for part, length, hit in found:
                    hit = hit[np.isin(hit >> 32, shared)]
                    if len(hit):
                        out.append((q, part, length, docs[hit >> 32], (hit & 0xFFFFFFFF).astype(np.int32)))
        sizes = [len(x[3]) for x in out]
        repeated = lambda k, kind: pa.array([x[k] for x in out], kind).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
        joined = lambda k, kind: np.concatenate([x[k] for x in out]) if out else np.zeros(0, kind)
        return pa.table([repeated(0, kind), repeated(1, pa.int32()), repeated(2, pa.int32()), pa.array(joined(3, np.int64)), pa.array(joined(4, np.int32))], ["query_id", "part", "length", key, "at"])

    return run
