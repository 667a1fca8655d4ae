"""Plain text and Markdown files: bytes to decoded, normalized documents with paragraph blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import normalized
from docloom.operators import quality, segments

# Kinds that are read as text, and the encodings tried, in order, on bytes that aren't UTF-8.
TEXT_KINDS = ("txt", "md", "paste")
LEGACY = ("cp1258", "cp1252", "latin-1")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decoded(content: pd.Series) -> pd.Series:
    """The text under each of LEGACY, null where the bytes aren't of that encoding."""

    def one(b: bytes, codec: str) -> str | None:
        try:
            return b.decode(codec)
        except UnicodeDecodeError:
            return None

    return content.map(lambda b: [one(b, codec) for codec in LEGACY], na_action="ignore")


def decode_bytes(files: DataFrame, key: str = "path", col: str = "content") -> DataFrame:
    """files with text, encoding and error_code. UTF-8 stays in the JVM; other bytes take the legacy encoding whose
    text the quality gate scores best, the first of equals."""
    utf8 = F.expr(f"is_valid_utf8({col})")
    plain = files.filter(utf8).withColumns({"text": F.regexp_replace(F.when(utf8, F.decode(col, "UTF-8")), "^﻿", ""), "encoding": F.lit("utf-8-sig")})
    tries = files.filter(~utf8).select("*", F.posexplode(_decoded(F.col(col))).alias("_rank", "text")).filter("text is not null")
    graded = quality.assess(tries.withColumn("_text", F.col("text")), key, "text", keep=("_rank", "_text", *[c for c in files.columns if c != key]))
    best = graded.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "_rank"))).filter("_n = 1")
    best = best.withColumns({"text": F.col("_text"), "encoding": F.get(F.array(*map(F.lit, LEGACY)), F.col("_rank"))})
    both = plain.unionByName(best.select(*plain.columns))
    return both.withColumn("error_code", F.when(F.trim(F.regexp_replace("text", "\\s+", " ")) == "", "TEXT_EMPTY"))


def read_plain(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks) of a folder: path, kind, norm, method, error_code; path, block_no, char_start, char_end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    files = files.select("path", "content", kind.alias("kind"))
    known = files.filter(F.col("kind").isin(*TEXT_KINDS))
    docs = normalized(decode_bytes(known)).select("path", "kind", "norm", F.concat(F.lit("plain:"), "encoding").alias("method"), "error_code")
    missing = files.filter(~F.col("kind").isin(*TEXT_KINDS)).select("path", "kind", F.lit("").alias("norm"), F.lit(None).cast("string").alias("method"), F.lit("KIND_UNSUPPORTED").alias("error_code"))
    return docs.unionByName(missing), segments.paragraphs(docs.filter("error_code is null"), "path")
