"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by their membership pattern (the set of sources they are in). Words flow from patterns to
the sources' quotas; the first use of a word costs less than its repetition, so the cheapest flow repeats no more
than the quotas need. The flow runs over patterns and sources only. It says how many words each pattern gives; its
documents are then taken in a seeded order, whole, up to that number, and one more that closes the gap best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.shared import BUCKET_BITS, WORD, as_text, discard, read, with_place, written

#: Weights of the sources by rank, repeated; the mix's size over the corpus's; uses of a document at most.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Most membership patterns: their table is collected and broadcast, and a larger one is refused.
MOST_PATTERNS = 20_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> list[float]:
    """Each source's words: shares of the mix by weight, none above `most` times its size, the excess shared anew."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        full = {i for i in open_ if unit * weights[i % len(weights)] > most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else unit * weights[i % len(weights)]
            left -= out[i]
        open_ -= full or open_
    return out


def min_cost_flow(supplies: list[int], members: list[list[int]], quotas: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources.

    A pattern's k-th use of its words costs 2k - 1 a word, up to `repeats` uses. Only first steps cost anything, so
    paths of the least cost are those of the fewest uses: for k = 1, 2, .. the k-th use of all patterns is opened and
    the flow raised as far as it goes, by blocking flows along shortest paths (with detours over other patterns).
    That fills the quotas as far as memberships allow, at the least cost of all flows that do.
    """
    n, m = len(supplies), len(quotas)
    give: list[dict[int, int]] = [dict.fromkeys(s, 0) for s in members]
    takers: list[set[int]] = [set() for _ in range(m)]  # patterns that give a source something
    need, have = list(quotas), [0] * n
    for _ in range(repeats):
        have = [h + s for h, s in zip(have, supplies, strict=True)]
        while True:
            near, layer, at = [-1] * m, [s for s in range(m) if need[s] > 0], 0  # steps from a source to one in need
            far = [-1] * n
            for s in layer:
                near[s] = 0
            by_source: list[list[int]] = [[] for _ in range(m)]
            for p in range(n):
                for s in members[p]:
                    by_source[s].append(p)
            while layer:
                at += 1
                found = []
                for s in layer:
                    for p in by_source[s]:
                        if far[p] < 0:
                            far[p] = at
                            found += [r for r, x in give[p].items() if x and near[r] < 0]
                layer = []
                for r in found:
                    if near[r] < 0:
                        near[r] = at
                        layer.append(r)
            moved = 0
            for p in range(n):
                while have[p] and far[p] > 0:
                    amount = _push(p, have[p], far, near, members, give, takers, need)
                    if not amount:
                        break
                    have[p] -= amount
                    moved += amount
            if not moved:
                break
    return [{s: x for s, x in g.items() if x} for g in give]


def _push(p: int, most: int, far: list[int], near: list[int], members: list[list[int]], give: list[dict[int, int]], takers: list[set[int]], need: list[int]) -> int:
    """Send up to `most` words of a pattern one step nearer to a source in need; a pattern that can't leaves the race."""
    for s in members[p]:
        if near[s] != far[p] - 1:
            continue
        if not near[s]:
            amount = min(most, need[s])
            need[s] -= amount
        else:  # another pattern that gives this source something gives it elsewhere instead
            amount = 0
            for q in sorted(takers[s]):
                if far[q] == near[s] and q != p and (amount := _push(q, min(most, give[q][s]), far, near, members, give, takers, need)):
                    give[q][s] -= amount
                    if not give[q][s]:
                        takers[s].discard(q)
                    break
        if amount:
            give[p][s] += amount
            takers[s].add(p)
            return amount
    far[p] = -1
    return 0


def _membership(members: Column) -> Column:
    """The distinct sources in order, null last; none, or a null array, is the null source alone."""
    return F.when(F.size(members) > 0, F.array_sort(F.array_distinct(members))).otherwise(F.array(F.lit(None).cast("string")))


def _key(docs: DataFrame, id_col: str, text_col: str, seed: int, file: Column, at: Column) -> Column:
    """What the seeded order of documents goes by: an even hash, then the id and the place."""
    h = F.xxhash64(F.lit(seed), F.col(id_col), as_text(text_col))
    return F.struct(h.bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("h"), F.col(id_col).alias("id"), file.alias("f"), at.alias("at"))


def planned(base: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row for each pattern of the written table base (members, pattern, size, key): pattern, own (its first
    source), source_size, target, whole (times that it is taken as a whole), cut (the last key taken once more) and
    last (the key of one document more, which closes the gap best); null where there is none.

    Only sums by pattern and leading bits of the hash, and then the one group of bits where a pattern's words run
    out, are put in order.
    """
    spark = base.sparkSession
    found = base.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    found.sort(key=lambda r: r.pattern)
    # by code point, null last; UTF-16 never decides as Python compares code points
    sources = sorted({s for r in found for s in r.members}, key=lambda s: (s is None, s or ""))
    rank = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for r in found:
        for s in r.members:
            sizes[rank[s]] += r.size
    goals = targets(sizes, weights, share, repeats)
    flow = min_cost_flow([r.size for r in found], [sorted({rank[s] for s in r.members}) for r in found], [round(g) for g in goals], repeats)
    plan = []
    for r, f in zip(found, flow, strict=True):
        words, first = sum(f.values()), rank[r.members[0]]
        whole = words // r.size if r.size else 0
        plan.append((r.pattern, r.members[0], sizes[first], goals[first], whole, words - whole * r.size))
    table = spark.createDataFrame(plan, "pattern string, own string, source_size long, target double, whole long, rest long").coalesce(1)
    bits = F.shiftright(F.col("key.h"), 64 - BUCKET_BITS).cast("int")  # signed: the order of the keys
    before = Window.partitionBy("pattern").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)
    sums = base.filter("size > 0").groupBy("pattern", bits.alias("bits")).agg(F.sum("size").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    open_ = sums.join(F.broadcast(table), "pattern").filter((F.col("base") <= F.col("rest")) & (F.col("rest") < F.col("base") + F.col("sum")))
    open_ = open_.select("pattern", "bits", (F.col("rest") - F.col("base")).alias("left"))
    inside = base.filter("size > 0").withColumn("bits", bits).join(F.broadcast(open_), ["pattern", "bits"])  # one row a pattern
    upto = Window.partitionBy("pattern").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.when(F.col("upto") <= F.col("left"), F.struct("key", "upto"))
    cuts = inside.withColumn("upto", F.sum("size").over(upto)).groupBy("pattern", "bits").agg(F.max(taken).alias("cut"), F.first("left").alias("left"))
    # a key below the bits where nothing of these is taken
    floor = F.struct(F.shiftleft(F.col("bits").cast("long"), 64 - BUCKET_BITS).alias("h"), F.lit(None).cast(base.schema["key"].dataType["id"].dataType).alias("id"), F.lit(None).cast("long").alias("f"), F.lit(None).cast("long").alias("at"))
    cuts = written(cuts.select("pattern", F.coalesce("cut.key", floor).alias("cut"), (F.col("left") - F.coalesce("cut.upto", F.lit(0))).alias("gap")), "mix-cuts")
    # what the documents in order leave open, one more document of the pattern covers best
    off = F.abs(F.col("size") - F.col("gap"))
    spare = base.filter("size > 0").join(F.broadcast(cuts.filter("gap > 0")), "pattern").filter((F.col("key") > F.col("cut")) & (off < F.col("gap")))
    last = spare.groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "key")).alias("last")).select("pattern", F.col("last.key").alias("last"))
    return written(table.join(F.broadcast(cuts), "pattern", "left").join(F.broadcast(last), "pattern", "left").drop("rest", "gap"), "mix-plan")


def _uses(size_is_positive: Column) -> Column:
    """How often the mix takes a document, from the columns of the plan and its key."""
    once = F.coalesce(F.col("key") <= F.col("cut"), F.lit(False)) | F.coalesce(F.col("key") == F.col("last"), F.lit(False))
    return F.when(size_is_positive, F.col("whole") + once.cast("long")).otherwise(F.lit(0).cast("long"))


def _base(docs: DataFrame, id_col: str, text_col: str, members: Column | None, seed: int, file: Column, at: Column) -> DataFrame:
    own = _membership(F.array(F.col("source").cast("string")) if members is None else members)
    size = F.regexp_count(as_text(text_col), F.lit(WORD)).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), own.alias("members"), size.alias("size"), _key(docs, id_col, text_col, seed, file, at).alias("key"))
    return written(base.withColumn("pattern", F.to_json(F.struct("members"), {"ignoreNullFields": "false"})), "mix-rows")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: Column | None = None, seed: int = 0, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; members: an array of its sources (source alone).

    Sizes count words; null texts have none and are never taken. A null source is a source like any other, the last
    by rank; an empty or null array of members is that source; the order and repeats in an array don't matter.
    Documents are taken whole, so a source misses its target by less than one document. Rows with equal ids and
    texts are told apart by place, which changes no figure. Other columns are ignored; an empty table gives an empty
    result. The same rows always give the same mix, in whatever order or files they come.
    """
    base = _base(docs, id_col, text_col, members, seed, F.lit(0).cast("long"), F.monotonically_increasing_id())
    out = base.join(F.broadcast(planned(base, **options)), "pattern")  # at most MOST_PATTERNS rows
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _uses(F.col("size") > 0)).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: Column | None = None, seed: int = 0, stored: bool = False, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, columns as they were. stored: as in with_place.

    A row is taken by comparing its key with its pattern's, where it lies: no row of docs is shuffled.
    """
    placed, file, at = with_place(docs, stored)
    base = _base(placed, id_col, text_col, members, seed, F.col(file), F.col(at))
    plan = planned(base, **options)
    discard(base)
    own = _membership(F.array(F.col("source").cast("string")) if members is None else members)
    pattern = F.to_json(F.struct(own.alias("members")), {"ignoreNullFields": "false"})
    whole = placed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), pattern.alias("pattern"), _key(placed, id_col, text_col, seed, F.col(file), F.col(at)).alias("key"), as_text(text_col).rlike(WORD).alias("has"))
    taken = whole.join(F.broadcast(plan), "pattern").withColumn("uses", _uses(F.col("has"))).filter("uses > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses")))).select("row.*")


def op5_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


QUERIES = {"op5_flow_mix": op5_flow_mix}
ORACLE_SQL: dict[str, str] = {}
