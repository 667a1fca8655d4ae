"""Uploads and their manifest: what is accepted, which pages go to OCR, lists of downloads as CSV, question sets as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of files that are taken, and limits.
EXTENSIONS, IMAGES = ("pdf", "docx", "txt", "md", "png", "jpg", "jpeg", "webp"), ("png", "jpg", "jpeg", "webp")
MAX_BYTES, MAX_IMAGE_BYTES, MAX_SOURCES = 50 << 20, 10 << 20, 50
PAGE_CHARS, NEAR_EMPTY, MIN_SCORE = 100, 10, 0.60


def allowed_extensions(text: str) -> list[str]:
    """The distinct extensions of a list such as ".pdf, docx"."""
    return list(dict.fromkeys(x for part in text.split(",") if (x := part.strip().lower().lstrip("."))))


def validated(uploads: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, most: int = MAX_SOURCES, max_bytes: int = MAX_BYTES, max_image: int = MAX_IMAGE_BYTES) -> DataFrame:
    """uploads (upload_id, notebook_id, name, bytes) with error_code, null for those taken.

    Of a notebook's good files the first `most` by upload_id, which are unique, are taken: these are found by a limit for
    each notebook, which Spark keeps before it shuffles, and the others told by a join.
    """
    ext = F.lower(F.regexp_extract("name", "\\.([^./]+)$", 1))
    limit = F.when(ext.isin(*IMAGES), max_image).otherwise(max_bytes)
    first = F.when(~ext.isin(*extensions), "EXTENSION").when(F.col("bytes") > limit, "TOO_LARGE").when(F.col("bytes") == 0, "EMPTY")
    graded = uploads.withColumn("error_code", first)
    place = F.row_number().over(Window.partitionBy("notebook_id").orderBy("upload_id"))
    taken = graded.filter("error_code is null").select("notebook_id", "upload_id").withColumn("_n", place).filter(F.col("_n") <= most).select("upload_id", F.lit(True).alias("_taken"))
    return graded.join(taken, "upload_id", "left").withColumn("error_code", F.coalesce("error_code", F.when(F.col("_taken").isNull(), "TOO_MANY"))).select(*uploads.columns, "error_code")


def page_method(chars: Column, fast_score: Column) -> Column:
    """How a page's text is got: its text layer if that has enough, else fast OCR, else the model if that reads poorly."""
    return F.when(chars >= PAGE_CHARS, "text").when(fast_score >= MIN_SCORE, "fast").otherwise("model")


def page_warning(text: Column) -> Column:
    """NEAR_EMPTY for pages of which almost nothing was read, PAGE_FAILED where nothing came; other pages are untouched."""
    return F.when(text.isNull(), "PAGE_FAILED").when(F.char_length(F.trim(text)) < NEAR_EMPTY, "NEAR_EMPTY")


def download_status(content: Column, magic: str, least: int) -> Column:
    """ok, or why a download is no document: missing, bad_magic, too_small."""
    return F.when(content.isNull(), "missing").when(~F.startswith(content, F.lit(magic)), "bad_magic").when(F.octet_length(content) < least, "too_small").otherwise("ok")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_questions(rows: DataFrame, path: str) -> None:
    """A question set as JSON lines; nulls stay nulls."""
    rows.write.option("ignoreNullFields", False).json(path)


def read_questions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def run_metadata(results: DataFrame, config: dict[str, str], seed: int, models: dict[str, str]) -> DataFrame:
    """One row that says how results came about: configuration, seed, models, number of rows."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])
    return results.agg(F.count("*").alias("rows")).select("rows", F.lit(seed).alias("seed"), pairs(config).alias("config"), pairs(models).alias("models"))
