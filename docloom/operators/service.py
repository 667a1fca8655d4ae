"""Analytics of the service around retrieval: cache, quotas, lockouts, latencies, lifecycle, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.retrieval import dot, length

CACHE_COSINE, CALLS_PER_DAY, FAILURES, FAILURE_SECONDS, LOCK_MINUTES, TURNS = 0.93, 50, 5, 300, 15, 4


def cache_lookup(asked: DataFrame, cache: DataFrame, least: float = CACHE_COSINE, salts: int = 8) -> DataFrame:
    """(query_id, cache_id, score): the closest unexpired entry of the same user, if close enough.

    asked: query_id, user_id, qvec, now; cache: cache_id, user_id, embedding, expires_at. The entries of a user are
    dealt over `salts` tasks, to which each question goes.
    """
    asked = asked.withColumns({"_qlength": length(F.col("qvec")), "_salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    cache = cache.withColumns({"_length": length(F.col("embedding")), "_salt": F.pmod(F.xxhash64("cache_id"), F.lit(salts)).cast("int")})
    score = F.try_divide(dot(F.col("embedding"), F.col("qvec")), F.col("_length") * F.col("_qlength"))
    near = asked.join(cache, ["user_id", "_salt"]).filter(F.col("expires_at") > F.col("now")).select("query_id", "cache_id", F.round(score, 6).alias("score"))
    best = near.filter(F.col("score") >= least).groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "cache_id")).alias("b"))
    return best.select("query_id", F.col("b.cache_id").alias("cache_id"), (-F.col("b.s")).alias("score"))


def counted_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """cache with hit_count raised by the rows of hits (cache_id)."""
    more = hits.groupBy("cache_id").agg(F.count("*").alias("_more"))
    return cache.join(more, "cache_id", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_more", F.lit(0))).drop("_more")


def live(cache: DataFrame, now: str) -> DataFrame:
    """The entries that haven't expired."""
    return cache.filter(F.col("expires_at") > F.lit(now).cast("timestamp"))


def transitions(events: DataFrame, allowed: dict[str | None, list[str]], key: str = "source_id") -> DataFrame:
    """events (key, status, at, event_id) with before, the status of the one before, and valid: whether it may follow."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy("at", "event_id"))
    pairs = [F.concat_ws(">", F.lit(a or ""), F.lit(b)) for a, bs in allowed.items() for b in bs]
    step = F.concat_ws(">", F.coalesce("before", F.lit("")), "status")
    return events.withColumn("before", before).withColumn("valid", step.isin(*pairs))


def daily_quota(calls: DataFrame, most: int = CALLS_PER_DAY) -> DataFrame:
    """user_id, day, calls, over_quota of rows (user_id, ts)."""
    return calls.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls")).withColumn("over_quota", F.col("calls") > most)


def lockouts(failures: DataFrame, limit: int = FAILURES, seconds: int = FAILURE_SECONDS, minutes: int = LOCK_MINUTES) -> DataFrame:
    """user_id, ts, failures, locked_until at each failure that makes `limit` within `seconds`."""
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-seconds, 0)
    counted = failures.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("failures", F.count("*").over(w))
    return counted.filter(F.col("failures") >= limit).select("user_id", "ts", "failures", (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("locked_until"))


def stuck(events: DataFrame, now: str, minutes: int) -> DataFrame:
    """user_id, status, last_at of those whose last event is an unfinished one older than `minutes` before now."""
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    old = F.col("e.ts") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    return last.filter(old & ~F.col("e.event_type").isin("purchase", "error")).select("user_id", F.col("e.event_type").alias("status"), F.col("e.ts").alias("last_at"))


def recent_turns(turns: DataFrame, n: int = TURNS) -> DataFrame:
    """conv_id, turn, context: the texts of the n turns before each turn, oldest first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), "\n").alias("context"))


def citations(answers: DataFrame) -> DataFrame:
    """key columns and marker: the distinct [n] markers of each answer."""
    markers = F.array_distinct(F.regexp_extract_all("answer", F.lit("\\[(\\d+)\\]"), F.lit(1)))
    return answers.select("conv_id", "turn", F.explode(markers).alias("m")).select("conv_id", "turn", F.col("m").cast("int").alias("marker"))
