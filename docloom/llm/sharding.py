"""Balanced label propagation: linked documents move towards their neighbours' shards, within capacity quotas.

Only documents with links take part in the rounds; each holds one label, and a shard never takes in more of them than
it has room for. The other documents then fill every shard up to its exact number of rows, so the counts of any two
shards differ by one at most. Rounds are joins and aggregations; a few numbers for each shard reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import as_text, discard, read, seen, sized, spare_name, with_place, with_running, written

SHARDS, ROUNDS = 40, 4


def equal_text_links(rows: DataFrame, most: int) -> DataFrame:
    """Links (u, v) between rows (row, g1, g2) of equal texts: each to one row of its group.

    A group of more than `most` rows, one that no shard could hold, is cut by a hash into parts, each with its own
    centre. Sizes are a table, so Spark may split the rows of a hot group when it joins them.
    """
    sizes = written(rows.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.min("row").alias("v")).filter("n > 1"), "text-groups", most=F.coalesce(F.max("n"), F.lit(0)))
    dealt = rows.select("row", "g1", "g2").join(sized(sizes), ["g1", "g2"])
    links = dealt.filter(F.col("n") <= most).select(F.col("row").alias("u"), "v")
    if seen(sizes, "most") > most:
        parts = F.ceil(F.col("n") / F.lit(max(1.0, 0.95 * most))).cast("long")
        large = dealt.filter(F.col("n") > most).select("row", "g1", "g2", F.pmod(F.xxhash64("row"), parts).alias("part"))
        centres = F.broadcast(large.groupBy("g1", "g2", "part").agg(F.min("row").alias("v")))  # about as many as shards
        links = links.union(large.join(centres, ["g1", "g2", "part"]).select(F.col("row").alias("u"), "v"))
    return links.filter("u <> v")


def _by_shard(counts: list[int], of: Column) -> Column:
    """A number for each shard, looked up by the column `of`."""
    return F.get(F.array(*[F.lit(n).cast("long") for n in counts]), of)


def _loads(labels: DataFrame, shards: int) -> list[int]:
    counts = {r.shard: r.n for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [counts.get(s, 0) for s in range(shards)]


def seeded(nodes: DataFrame, room: list[int]) -> DataFrame:
    """(node, shard) for a written table (node, lead): the nodes of one lead start together as far as that goes.

    Leads of more than a 64th of a shard, of which there are few, are placed by size, the largest first, where most
    room is. All others are put in a line, which is cut so that shards fill up evenly.
    """
    spark, shards = nodes.sparkSession, len(room)
    least = max(1, min(room) // 64)
    large = nodes.groupBy("lead").count().filter(F.col("count") > least).collect()  # at most 64 for each shard
    free, placed = list(room), []
    for r in sorted(large, key=lambda r: (-r["count"], r.lead)):
        s = max(range(shards), key=lambda s: (free[s], -s))
        fits = r["count"] <= free[s]
        placed.append((r.lead, s if fits else None, -(-r["count"] // least)))
        free[s] -= r["count"] if fits else 0
    left = seen(nodes) - (sum(room) - sum(free))
    ends = [sum(free[: s + 1]) * left // max(1, sum(free)) for s in range(shards)]
    table = F.broadcast(spark.createDataFrame(placed, "lead long, large_in int, parts long"))
    nodes = nodes.join(table, "lead", "left")
    line = nodes.filter("large_in is null").select("node", F.lit(0).alias("all"), F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))).alias("h"))
    line = with_running(line, "all", "h", F.lit(1), "rank", ["node"], 1)
    shard = F.least(F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank"))), F.lit(shards - 1))
    return nodes.filter("large_in is not null").select("node", F.col("large_in").alias("shard")).union(line.select("node", shard.alias("shard")))


def requests(links: DataFrame, labels: DataFrame, k: int, cut: Observation | None = None) -> DataFrame:
    """(node, to, lead): the shard that most of a node's neighbours are in, if more of them are there than in its own.

    links (u, v) has both directions of each. In even rounds a node looks at neighbours with smaller numbers, in odd
    rounds at larger ones, so that two neighbours never swap. cut observes how many links are cut.
    """
    each = links.filter("v < u" if k % 2 == 0 else "v > u").join(labels.toDF("v", "shard"), "v").join(labels.toDF("u", "own"), "u")
    if cut:
        each = each.observe(cut, F.count_if(F.col("own") != F.col("shard")).alias("links"))
    votes = each.groupBy("u", "own", "shard").agg(F.count("*").alias("n"), F.min("v").alias("lead"))
    best = F.max(F.struct("n", (-F.col("shard")).alias("s"), "lead")).alias("best")
    asked = votes.groupBy("u").agg(best, F.sum(F.when(F.col("shard") == F.col("own"), F.col("n")).otherwise(0)).alias("have")).filter("best.n > have")
    return asked.select(F.col("u").alias("node"), (-F.col("best.s")).alias("to"), "best.lead")


def propagate(links: DataFrame, shards: int, room: int | list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) for the nodes of links (u, v): seeded labels at first, then moves that leave fewer links cut.

    A node's lead is the smallest of itself and its neighbours. In each round nodes ask for the shard that most of
    their neighbours are in; a shard grants requests while it stays within its room, neighbours of one node in a few
    lots. Rounds end early when no link is cut, or when two in a row move nothing.
    """
    room = [room] * shards if isinstance(room, int) else room
    spark = links.sparkSession
    pairs = links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct()
    sym = written(pairs.union(pairs.select("v", "u")).toDF("u", "v").distinct(), "links")
    if not seen(sym):
        return spark.createDataFrame([], "node long, shard int")
    nodes = written(sym.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("lead")), "nodes")
    labels, idle = written(seeded(nodes, room), "labels"), 0
    discard(nodes)
    for k in range(rounds):
        cut = Observation()
        asked = written(requests(sym, labels, k, cut), "asked")
        idle = 0 if seen(asked) else idle + 1
        if not cut.get["links"] or idle == 2:
            discard(asked)
            break
        if not idle:
            free = [max(0, r - n) for r, n in zip(room, _loads(labels, shards), strict=True)]
            lots = F.xxhash64("lead", F.lit(k), F.pmod(F.xxhash64("node"), F.lit(8)))
            granted = with_running(asked.select("node", "to", lots.alias("h")), "to", "h", F.lit(1), "before", ["node"], shards)
            granted = granted.filter(F.col("before") < _by_shard(free, F.col("to")))
            after = written(labels.join(granted.select("node", "to"), "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "labels")
            discard(labels)
            labels = after
        discard(asked)
    discard(sym)
    return labels


def assign(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The columns of rows, a written table with the column row, and shard and slot; slots run from 0 in each shard.

    links may be any pairs (u, v) of rows. Shards hold n // shards rows, the first n % shards of them one more. Linked
    rows lie where their labels are; the others, in a hashed order, fill up what is left of each shard.
    """
    total = seen(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    labels = propagate(links, shards, room, rounds)
    loads = _loads(labels, shards)
    free = [r - n for r, n in zip(room, loads, strict=True)]
    every = rows.join(labels.select(F.col("node").alias("row"), F.col("shard").alias("held")), "row", "left")
    every = every.withColumns({"group": F.coalesce("held", F.lit(shards)), "h": F.xxhash64("row", F.lit(5))})
    every = with_running(every, "group", "h", F.lit(1), "rank", ["row"], shards + 1)
    ends = [sum(free[: s + 1]) for s in range(shards)]
    fill = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    shift = [n - e + f for n, e, f in zip(loads, ends, free, strict=True)]
    every = every.withColumn("shard", F.coalesce("held", fill))
    slot = F.when(F.col("held").isNotNull(), F.col("rank")).otherwise(F.col("rank") + _by_shard(shift, F.col("shard")))
    return every.withColumn("slot", slot).select(*rows.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs, linking equal texts.

    The law is `rows`: counts of shards are at most one apart, whatever the sizes. Null texts count as empty and are
    equal to each other and to empty texts; rows without an id and repeated rows are rows like any other; groups too
    large for a shard are cut; texts are read whole; other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), as_text(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    base = base.select("row", "doc_id", (F.octet_length("text").cast("long") + 16).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(7), "text").alias("g2"))
    base = written(base, "shard-rows")  # from here on a row keeps its number
    out = assign(base, equal_text_links(base, seen(base) // shards), shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text_col: str = "text", stored: bool = False) -> DataFrame:
    """docs with the columns shard and slot (under spare names where docs has these). stored: as in with_place."""
    placed, file, at = with_place(docs, stored)
    text = as_text(text_col)
    base = placed.select(F.col(file).alias("f"), F.col(at).alias("at"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(7), text).alias("g2"))
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    out = assign(base, equal_text_links(base, seen(base) // shards), shards, rounds)
    names = [n if n not in {c.lower() for c in docs.columns} else spare_name(docs, n) for n in ("shard", "slot")]
    return placed.join(out.select("f", "at", "shard", "slot").toDF(file, at, *names), [file, at]).drop(file, at)


def op9_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op9_label_shards": op9_label_shards}
ORACLE_SQL: dict[str, str] = {}
