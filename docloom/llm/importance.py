"""Target-distribution importance resampling: documents that look like a target text are drawn without replacement.

Words are hashed to buckets; the gain of a bucket is the logarithm of how much commoner it is in the target than in the
corpus. A document's weight is the mean gain of its features, looked up in an array; Gumbel noise from its id turns the
highest scores into a weighted sample. The score from which documents are drawn is found exactly by medians of medians:
each block of keys gives its median, the median of these, weighted by the rows left in each block, splits all keys, and
the side that can't hold the cutoff is discarded. Only the winners are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docloom.llm.shared import as_text, discard, free_name, read, seen, small_batches, with_place, written

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hash buckets of features, and the longest run of words that is one feature.
BUCKETS, LONGEST = 10_000, 1
#: Share of the documents with enough words that is drawn, in percent; words that are enough; seed of the noise.
PERCENT, ENOUGH, SEED = 10, 20, 2024
#: Keys of which one median is taken: a task's memory is bounded by a block, whatever its partition holds.
BLOCK = 1 << 20
#: A round's keys are written anew once they are this part of the table that is read; so few keys are put in order at once.
SHRINK, FEW = 8, 4096


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def buckets_of(text: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The bucket of each feature of a text: runs of 1 to longest words, joined by a space, repeats included."""
    words = F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))
    bucket = lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")
    if longest == 1:
        return F.transform(words, bucket)
    runs = lambda ws, k: F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.array_join(F.slice(ws, i, k), " "))).otherwise(F.array().cast("array<string>"))
    # the one-element array binds the words to a name, so that they are cut once
    return F.flatten(F.transform(F.array(words), lambda ws: F.transform(F.concat(ws, *[runs(ws, k) for k in range(2, longest + 1)]), bucket)))


def _counts(features: DataFrame) -> DataFrame:
    return features.select(F.explode("features").alias("bucket")).groupBy("bucket").count()


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths, from tables with the column features; a row a bucket reaches the driver."""
    s, t = _counts(corpus).withColumnRenamed("count", "s"), _counts(target).withColumnRenamed("count", "t")
    spark = corpus.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    rows = written(both, "importance-counts", s=F.sum("s"), t=F.sum("t"))
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * float(seen(rows, "s") + buckets) / (d(F.col("s") + 1) * float(seen(rows, "t") + buckets))
    found = dict(rows.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")).collect())
    discard(rows)
    return [found[b] for b in range(buckets)]


def weight(features: Column, gain: list[int]) -> Column:
    """The mean gain of an array of buckets, rounded down; 0 for an empty one. Gains stand in one constant array."""
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(features, F.lit(0).cast("long"), lambda a, b: a + F.get(array, b))
    n = F.size(features).cast("long")
    return F.get(F.transform(F.array(total), lambda s: F.coalesce(F.try_divide(s - F.pmod(s, n), n).cast("long"), F.lit(0).cast("long"))), F.lit(0))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


@dataclass(frozen=True)
class Key:
    """A place in the order of drawing: higher scores first, then lesser ids, null ids last, then file and place."""

    less: int
    none: int
    id: int
    f: int
    at: int

    def tuple(self) -> tuple[int, ...]:
        return self.less, self.none, self.id, self.f, self.at


_KEY = ["less", "none", "id", "f", "at"]


def _before(key: Key, same: bool = False) -> Column:
    """Rows with the columns of a key that come before it, or (same) are it."""
    out = F.lit(same)
    for c, x in zip(reversed(_KEY), reversed(key.tuple()), strict=True):
        v = F.lit(x).cast("long")
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def _medians(pivot: Key | None):
    """A row for each block and side of the pivot (0: before it or no pivot, 1: after it): its rows and its median."""

    def rows(block: np.ndarray) -> Iterator[tuple]:
        block = block[np.lexsort(block.T[::-1])]
        cut = len(block)
        if pivot is not None:
            after = np.zeros(len(block), bool)
            for c, x in zip(range(len(_KEY) - 1, -1, -1), reversed(pivot.tuple()), strict=True):
                after = (block[:, c] > x) | ((block[:, c] == x) & after)
            cut = int(len(block) - after.sum())
        for side, part in ((0, block[:cut]), (1, block[cut:])):
            if side == 0 and len(part) and pivot is not None and tuple(part[-1].tolist()) == pivot.tuple():
                part = part[:-1]  # the pivot itself is on neither side
            if len(part):
                yield side, len(part), *part[(len(part) - 1) // 2].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            found = list(rows(np.concatenate(parts)))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in range(2 + len(_KEY))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["side", "rows", *_KEY])

        held, n = [], 0
        for b in batches:
            held.append(np.stack([b.column(i).to_numpy() for i in range(len(_KEY))], axis=1))
            n += len(held[-1])
            if n >= BLOCK:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def weighted_median(found: list[tuple[int, Key]]) -> Key:
    """The key at which half of the rows are reached, over medians in order."""
    found = sorted(found, key=lambda x: x[1].tuple())
    half, total = sum(n for n, _ in found) / 2, 0
    for n, key in found:
        total += n
        if total >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> Key | None:
    """The k-th key of a table with the long columns of Key, all different; None where there are fewer, or k is 0.

    At each round a pivot is the weighted median of the blocks' medians, so at least a quarter of the keys left lie on
    either side of it. One job a round counts both sides and takes their blocks' medians; a row a block reaches the
    driver. The table is written anew as it shrinks, so all rounds together read a few times the keys.
    """
    if k < 1:
        return None
    schema = ", ".join(f"{c} long" for c in ("side", "rows", *_KEY))
    medians = lambda df, pivot: [(r[0], r[1], Key(*r[2:])) for r in df.select(*_KEY).mapInArrow(_medians(pivot), schema).collect()]
    table, size, made = keys, None, None
    sides = medians(table, None)
    low = high = None
    while sides:
        left = sum(n for _, n, _ in sides)
        if k > left:
            return None
        size = size or left
        pivot = weighted_median([(n, key) for _, n, key in sides])
        now = table
        if low is not None:
            now = now.filter(~_before(low, same=True))
        if high is not None:
            now = now.filter(_before(high))
        if left <= FEW:
            rest = sorted(tuple(r) for r in now.select(*_KEY).collect())
            discard(*([made] if made is not None else []))
            return Key(*rest[k - 1])
        if left * SHRINK <= size:
            now = written(now, "importance-keys")
            discard(*([made] if made is not None else []))
            table = made = now
            size, low, high = left, None, None
        both = medians(now, pivot)
        before = sum(n for side, n, _ in both if side == 0)
        if before + 1 == k:
            discard(*([made] if made is not None else []))
            return pivot
        if before >= k:
            high, sides = pivot, [x for x in both if x[0] == 0]
        else:
            low, sides, k = pivot, [x for x in both if x[0] == 1], k - before - 1
    return None


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, enough: int = ENOUGH, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank is null where a document isn't drawn.

    Of the documents with `enough` words or more, percent of 100 are drawn, rounded down: those of highest score, ties to
    the lesser id, null ids last (their noise is that of an empty id), then the earlier row. Ids are whole numbers. Null
    and empty texts have weight 0 and no features; texts of any length count whole; repeated rows are rows of their own;
    other columns are ignored. An empty target makes all gains alike; an empty table gives an empty result.
    """
    scored = _scored(docs, target, id_col, text_col, target_col, enough, seed, buckets, longest)
    drawn = percent * seen(scored, "many") // 100
    rows, file, at = with_place(scored, stored=True)
    rows = rows.select("*", (-F.col("score")).alias("less"), F.isnull("doc_id").cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col(file).alias("f"), F.col(at).alias("at"))
    last = cutoff(rows.filter("fit").select(*_KEY), drawn)
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*out, none)
    wins = F.col("fit") & _before(last, same=True)
    # the number of a row in its sorted partition, and of rows in the partitions before it
    ranked = written(rows.filter(wins).orderBy(*_KEY).select(*out).withColumn("order", F.monotonically_increasing_id()), "importance-drawn")
    ranked = ranked.withColumn("part", F.shiftright("order", 33))
    sums = ranked.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("base") + F.col("order").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.filter(~wins).select(*out, none).union(ranked.join(F.broadcast(sums), "part").select(*out, rank.alias("rank")))


def _scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, enough: int, seed: int, buckets: int, longest: int) -> DataFrame:
    """doc_id, n_features, weight, score, fit of each row, as a written table; texts are read and cut once."""
    features = docs.select(F.col(id_col).cast("long").alias("doc_id"), buckets_of(as_text(text_col), buckets, longest).alias("features"))
    features = written(features, "importance-features")
    gain = gains(features, target.select(buckets_of(as_text(target_col), buckets, longest).alias("features")), buckets)
    words = F.col("n_features")  # features of n words: n + (n - 1) + ..., which grows with n
    least = sum(max(enough - k, 0) for k in range(longest))
    scored = features.select("doc_id", F.size("features").cast("long").alias("n_features"), weight(F.col("features"), gain).alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", words >= least)
    scored = written(scored, "importance-scored", many=F.coalesce(F.sum(F.col("fit").cast("long")), F.lit(0)))
    discard(features)
    return scored


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose ids are drawn, with all their columns and `rank`; ids must be unique and not null."""
    rank = free_name(docs, "rank")
    ids = resample(docs, target, id_col, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn"), F.col("rank").alias("_rank"))
    return docs.join(ids, F.col(id_col) == F.col("_drawn")).select(*docs.columns, F.col("_rank").alias(rank))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op11_importance": op11_importance}
ORACLE_SQL = {
    "op11_importance": r"""
        WITH RECURSIVE step(k, r) AS (  -- the table of the checksum, bit by bit
            SELECT 0, list_transform(range(256), lambda x: x::BIGINT) UNION ALL
            SELECT k + 1, list_transform(r, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM step WHERE k < 8),
        d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        o AS (SELECT id, unnest(ws) AS w FROM d),
        u AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM o UNION SELECT w FROM b)),
        v AS (SELECT w, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM u),
        h AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, y: xor(c >> 8, r[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
              FROM v, (SELECT r FROM step WHERE k = 8)),
        s AS (SELECT bucket, count(*) AS s FROM o JOIN h USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY bucket),
        n AS (SELECT (SELECT sum(s) FROM s)::DOUBLE AS big_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS big_t),
        g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
        f AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM o JOIN h USING (w) JOIN g USING (bucket) GROUP BY id),
        a AS (SELECT d.id, doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
                     ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (id)),
        c AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS fit FROM a),
        r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, id) AS place, count(*) FILTER (fit) OVER () * 10 // 100 AS k FROM c)
        SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN fit AND place <= k THEN place END AS rank FROM r"""
}
