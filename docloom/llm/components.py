"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import discard, seen, written


def _pointed(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(v, m) for each edge (u, v) and the least m of u. Both sides are tables, so that Spark may split a hub."""
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """A table of edges from each node's larger neighbours to its least one."""
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    out = written(_pointed(both.filter("v > u"), least).filter("u <> v").distinct(), "edges")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """A table of edges from each node's smaller neighbours, and itself, to the least of them; edges go down."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = written(_pointed(edges, least).filter("u <> v").union(least.toDF("u", "v")).distinct(), "edges")
    discard(least)
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one parent at most, and no parent has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge to another one; root is the least node that it reaches.

    edges has the long columns u and v, in any order, with repeats and loops allowed. Each round costs a few
    shuffles of the edges; the number of rounds grows with the logarithm of the longest chain. Each step's
    edges are written to the shared folder, so a lost executor costs one step at most. Only counts reach the
    driver. An empty table gives an empty result.
    """
    ends = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").select(*ends).distinct(), "edges")
    while seen(now) and not _are_stars(now):
        large = _large_star(now)
        after = _small_star(large)
        discard(now, large)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
