"""Joins of intervals: which blocks a chunk overlaps, on which page it begins. No row holds a whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a bin.
BIN = 4096


def _bins(start: str, end: str, size: int) -> Column:
    """The bins that [start, end) touches; none for an empty interval."""
    last = F.floor((F.col(end) - 1) / size)
    return F.when(F.col(end) > F.col(start), F.sequence(F.floor(F.col(start) / size), last)).otherwise(F.array().cast("array<bigint>"))


def overlaps(left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str], right_ends: tuple[str, str], size: int = BIN) -> DataFrame:
    """Each pair of rows of one key whose half-open intervals overlap, once; the columns of both sides.

    Intervals are dealt to bins of `size`, and rows of one bin are compared, so a long document is as many tasks' work as it
    has bins. A pair that shares several bins is taken in the one where the later of the two begins. Columns other than
    the key must have different names. Empty intervals overlap nothing.
    """
    a = left.withColumn("_bin", F.explode(_bins(*left_ends, size)))
    b = right.withColumn("_bin", F.explode(_bins(*right_ends, size)))
    both = a.join(b, [key, "_bin"]).filter((F.col(right_ends[0]) < F.col(left_ends[1])) & (F.col(right_ends[1]) > F.col(left_ends[0])))
    return both.filter(F.col("_bin") == F.floor(F.greatest(left_ends[0], right_ends[0]) / size)).drop("_bin")


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str, size: int = 64 * BIN) -> DataFrame:
    """rows with `value` of the last mark of their key at or before `at`; null where there is none.

    Rows and marks are put in one table and a running maximum goes over each key's bins; what the bins before hand on is
    found from one row a bin, so no task puts a whole document in order. Of marks at one place the largest value holds.
    """
    kind = F.lit(0).alias("_kind")
    one = marks.select(F.col(key).alias("_k"), F.col(mark_at).cast("long").alias("_at"), kind, F.struct(F.col(mark_at).cast("long").alias("at"), F.col(value).alias("v")).alias("_m"), F.lit(None).cast(rows.schema).alias("_row"))
    two = rows.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(one.schema["_m"].dataType).alias("_m"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    both = one.unionByName(two).withColumn("_bin", F.floor(F.col("_at") / size))
    ends = both.filter("_kind = 0").groupBy("_k", "_bin").agg(F.max("_m").alias("_last"))
    # the last mark of a bin holds in later bins until another one has marks
    spans = ends.withColumn("_next", F.lead("_bin").over(Window.partitionBy("_k").orderBy("_bin")))
    inside = Window.partitionBy("_k", "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumn("_here", F.max("_m").over(inside)).filter("_kind = 1")
    found = run.filter("_here is not null").select("_row", F.col("_here.v").alias("_v"))
    rest = run.filter("_here is null").select("_k", "_bin", "_row")
    earlier = spans.select(F.col("_k").alias("_sk"), F.col("_bin").alias("_from"), "_next", F.col("_last.v").alias("_v"))
    held = (F.col("_k") == F.col("_sk")) & (F.col("_from") < F.col("_bin")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("_bin")))
    out = found.unionByName(rest.join(earlier, held, "left").select("_row", "_v"))
    return out.select("_row.*", F.col("_v").alias(value))
