"""Readers by kind of source, in one registry: files and pasted texts to documents, with an error code where that fails."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import normalized
from docloom.sources.plain import TEXT_KINDS, decode_bytes

#: What a parser delivers as JSON: its blocks in reading order.
BLOCKS = "array<struct<page:int,text:string,bbox:struct<page:int,x0:double,y0:double,x1:double,y1:double>>>"
COLUMNS = ["path", "kind", "text", "method", "blocks", "error_code"]
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def reader(*kinds: str):
    """Register a reader of these kinds: files (path, kind, content) to COLUMNS, one row a file whatever is in it."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        READERS.update(dict.fromkeys(kinds, f))
        return f

    return put


@reader(*TEXT_KINDS)
def text_files(files: DataFrame) -> DataFrame:
    """Plain text in UTF-8, or in the legacy encoding that the quality gate likes best; TEXT_EMPTY where nothing is in it."""
    known = files.filter("content is not null")
    read = decode_bytes(known).select("path", "kind", "text", F.concat(F.lit("plain:"), "encoding").alias("method"), F.lit(None).cast(BLOCKS).alias("blocks"), "error_code")
    return read.unionByName(_failed(files.filter("content is null"), "FILE_MISSING"))


@reader("json")
def block_files(files: DataFrame) -> DataFrame:
    """Blocks that a parser has found; BLOCKS_INVALID where the file isn't a list of them, TEXT_EMPTY where they have no text."""
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))  # a filter may be asked after what it guards
    blocks = F.from_json(text, BLOCKS, {"mode": "PERMISSIVE"})
    text = F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    code = F.when(F.col("blocks").isNull(), "BLOCKS_INVALID").when(F.trim(F.regexp_replace(text, "\\s+", " ")) == "", "TEXT_EMPTY")
    return files.withColumn("blocks", blocks).select("path", "kind", F.coalesce(text, F.lit("")).alias("text"), F.lit("blocks").alias("method"), "blocks", code.alias("error_code"))


def _failed(files: DataFrame, code: str) -> DataFrame:
    none = F.lit(None)
    return files.select("path", "kind", F.lit("").alias("text"), none.cast("string").alias("method"), none.cast(BLOCKS).alias("blocks"), F.lit(code).alias("error_code"))


def documents(files: DataFrame) -> DataFrame:
    """COLUMNS and norm, the text in normal form, of files (path, kind, content): each by the reader of its kind.

    A kind without a reader gives KIND_UNSUPPORTED, and no file stops the others. kind is taken in lower case.
    """
    files = files.select("path", F.lower("kind").alias("kind"), "content")
    groups: dict[Callable, list[str]] = {}
    for kind, f in READERS.items():
        groups.setdefault(f, []).append(kind)
    read = [f(files.filter(F.col("kind").isin(*kinds))).select(*COLUMNS) for f, kinds in groups.items()]
    unknown = F.coalesce(~F.col("kind").isin(*READERS), F.lit(True))
    return normalized(reduce(DataFrame.unionByName, [*read, _failed(files.filter(unknown), "KIND_UNSUPPORTED")]))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, in any store that Spark reads; their kind is their extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_extract("path", "\\.([^./]+)$", 1).alias("kind"), "content")


def pasted(texts: DataFrame, key: str = "source_id", col: str = "text") -> DataFrame:
    """Texts from a clipboard (key, text) as files of the kind paste."""
    return texts.select(F.concat(F.lit("paste:"), F.col(key).cast("string")).alias("path"), F.lit("paste").alias("kind"), F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8").alias("content"))
