"""A corpus pipeline: STAGES in order, each over what the one before it kept.

Quality classifier, near-duplicates, benchmark decontamination, mixing to target weights, sharding. The first four
return the columns of documents; the mixing stage returns a row as often as the mix takes it; the last adds shard
and slot. Each stage's decisions hold for all later ones. docs of a stage is a Parquet table as it was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import latent, line_crf, mixing, sharding, simhash
from docloom.llm.shared import read, small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, learnt from the labelled ones, scores under 0.7 go."""
    small_batches(spark)
    return line_crf.keep_good(docs, line_crf.fit(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles are similar by 0.8 or more, in chains, that with the least id stays."""
    small_batches(spark)
    return simhash.one_of_similar(docs, stored=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go."""
    small_batches(spark)
    return latent.without_leaks(docs, latent.build(docs, read(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it; documents without words are never taken."""
    return mixing.mixed(docs, stored=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows dealt to shards of equal counts, equal texts together."""
    return sharding.with_shards(docs, stored=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Models and searches of these stages have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
