"""Evaluation of answers: errors by characters and words, passes over all metrics, kinds of failure, rates by scope."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.tenancy import ratio
from docloom.sources.shared import delete, stored

#: Least values of a sample's metrics; a sample passes if it reaches all.
MINIMA = {"faithfulness": 0.80, "relevancy": 0.80, "recall": 0.75, "precision": 0.70}
#: Characters of a piece whose edit distance is taken at once; rows of a group that are put in order in one task.
PIECE, SORTED = 200, 100_000


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, bit-parallel over one of them."""
    if not a:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for x in b:
        same = places.get(x, 0)
        across = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | ~(across | plus) & full, plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(across | up) & full, up & across
    return score


def word_errors(reference: Column, read: Column) -> Column:
    """The edit distance of two texts in words."""

    @F.pandas_udf("long")
    def errors(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([edit_distance((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], dtype="int64")

    return errors(reference, read)


def char_errors(df: DataFrame, reference: str, read: str, *keys: str) -> DataFrame:
    """keys, errors, chars of whole texts whose characters are aligned: distances of pieces, summed."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(reference)), F.lit(PIECE)))
    pieces = df.select(*keys, reference, read, at.alias("_at"))
    cut = lambda c: F.substring(F.col(c), F.col("_at"), F.lit(PIECE))
    return pieces.groupBy(*keys).agg(F.sum(F.levenshtein(cut(reference), cut(read))).alias("errors"), F.sum(F.char_length(cut(reference))).alias("chars"))


def pass_rates(samples: DataFrame, minima: dict[str, float] = MINIMA) -> DataFrame:
    """n, the mean of each metric and the share of samples that reach all minima."""
    every = [F.col(k) >= x for k, x in minima.items()]
    means = [F.round(F.avg(k), 6).alias(k) for k in minima]
    passed = every[0]
    for e in every[1:]:
        passed = passed & e
    return samples.agg(F.count("*").alias("n"), *means, ratio(passed).alias("pass_rate"))


def failure_class(retrieved: Column, grounded: Column, cited: Column, answered: Column) -> Column:
    """What went wrong first with a sample: retrieval, grounding, citation or answer; ok if nothing did."""
    return F.when(~retrieved, "retrieval").when(~grounded, "grounding").when(~cited, "citation").when(~answered, "answer").otherwise("ok")


def shares(df: DataFrame, column: str) -> DataFrame:
    """column, n, share: how many rows have each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def exact_percentile(df: DataFrame, group: str, value: str, p: float, cells: int = 4096) -> DataFrame:
    """group, n, mean, percentile (between neighbours in proportion): exact, without a whole group in one task.

    Values are counted by cells between a group's least and largest, and only the cells that hold the two ranks are looked at
    again, cut into cells of their own, until they hold at most SORTED rows or one value; so far outliers, which push all
    others into one cell, cost another round. Null values don't count.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    ends = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    ends = ends.withColumn("rank", F.lit(p) * (F.col("n") - 1)).withColumns({"r0": F.floor("rank"), "r1": F.ceil("rank"), "base": F.lit(0).cast("long"), "left": F.col("n")}).withColumnRenamed("g", "eg")
    state, _, path = stored(ends, "percentile")
    names = ["eg", "n", "mean", "rank", "r0", "r1"]
    while True:
        wide = state.filter((F.col("left") > SORTED) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        mine = F.col("g").eqNullSafe(F.col("eg")) & F.col("v").between(F.col("low"), F.col("high"))
        cell = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * cells).alias("cell")
        counts = rows.join(wide, mine).groupBy(*names, "base", cell).agg(F.count("*").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = Window.partitionBy("eg").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("base", F.col("base") + F.coalesce(F.sum("k").over(before), F.lit(0)))
        hit = counts.filter((F.col("base") <= F.col("r1")) & (F.col("base") + F.col("k") > F.col("r0")))
        narrowed = hit.groupBy(*names).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("base").alias("base"), F.sum("k").alias("left"))
        rest = state.filter((F.col("left") <= SORTED) | (F.col("low") >= F.col("high")))
        state, _, new = stored(narrowed.unionByName(rest), "percentile")
        delete(spark, path)
        path = new
    inside = rows.join(state.filter("low < high"), F.col("g").eqNullSafe(F.col("eg")) & F.col("v").between(F.col("low"), F.col("high")))
    ranked = inside.withColumn("at", F.col("base") + F.row_number().over(Window.partitionBy("eg").orderBy("v")) - 1)
    at = lambda r: F.max(F.when(F.col("at") == F.col(r), F.col("v")))
    both = ranked.groupBy(*names).agg(at("r0").alias("v0"), at("r1").alias("v1")).unionByName(state.filter("low >= high").select(*names, F.col("low").alias("v0"), F.col("low").alias("v1")))
    return both.select(F.col("eg").alias(group), "n", "mean", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("rank") - F.col("r0"))).alias("percentile"))


def whole_char_errors(df: DataFrame, reference: str, read: str, *keys: str) -> DataFrame:
    """keys, errors, chars: edit distances of whole texts, whatever was put in, left out or replaced; null counts as empty.

    What both texts begin and end with is left out first; the rest is compared by whole machine words of one text at a time,
    so a text costs the square of its length over 64.
    """

    @F.pandas_udf("long")
    def errors(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([edit_distance(*differing(x or "", y or "")) for x, y in zip(a, b, strict=True)], dtype="int64")

    each = df.select(*keys, errors(F.col(reference), F.col(read)).alias("_e"), F.char_length(F.coalesce(F.col(reference), F.lit(""))).cast("long").alias("_n"))
    return each.groupBy(*keys).agg(F.sum("_e").alias("errors"), F.sum("_n").alias("chars"))


def differing(a: str, b: str) -> tuple[str, str]:
    """Two texts without what both begin with and what both end with."""
    k = len(commonprefix((a, b)))
    a, b = a[k:], b[k:]
    k = len(commonprefix((a[::-1], b[::-1])))
    return (a[:-k], b[:-k]) if k else (a, b)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of a threshold sweep with the highest f1; of equal ones the lowest threshold; null counts as 0."""
    return sweep.select(F.max(F.struct(F.coalesce("f1", F.lit(0.0)).alias("b"), (-F.col("cents")).alias("c"), *sweep.columns)).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in sweep.columns])
