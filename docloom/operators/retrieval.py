"""Hybrid retrieval over batches of questions: exact vector search, phrase search, rank fusion, gate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import lexemes

#: Defaults of the retrieval chain.
TOP_N, RRF_K, RERANK_K, TAU = 50, 60, 8, 0.35
#: Questions that a scan compares at once; larger sets go in blocks.
QUERY_BLOCK = 4096


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double."""
    return F.try_divide(dot(a, b), length(a) * length(b))


def top(df: DataFrame, key: str, item: str, n: int = TOP_N, score: str = "score") -> DataFrame:
    """The n best rows of each key with their rank from 1; ties go to the smaller item."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item))
    return df.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= n)


def in_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame], key: str = "query_id") -> DataFrame:
    """The union of search(block) over blocks of about QUERY_BLOCK queries, cut by a hash of their key."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if blocks == 1:
        return search(queries)
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionByName, [search(queries.filter(block == k)) for k in range(blocks)])


def vector_search(queries: DataFrame, vectors: DataFrame, n: int = TOP_N, scope: Column | None = None) -> DataFrame:
    """(query_id, vec_id, score, rnk): exact search of any number of queries against all vectors.

    queries: query_id, qvec [, q_scope]; vectors: vec_id, embedding [, scope]. A scope restricts the rows before
    anything is ranked. The query side is broadcast in blocks of about QUERY_BLOCK, one scan of the vectors each.
    """

    def search(asked: DataFrame) -> DataFrame:
        known = vectors.withColumn("_length", length(F.col("embedding")))  # once a vector, not once a pair
        asked = asked.withColumn("_qlength", length(F.col("qvec")))
        pairs = known.join(F.broadcast(asked), F.lit(True) if scope is None else scope)
        score = F.try_divide(dot(F.col("embedding"), F.col("qvec")), F.col("_length") * F.col("_qlength"))
        scored = pairs.select("query_id", "vec_id", F.round(score, 6).alias("score"))
        return top(scored, "query_id", "vec_id", n)

    return in_blocks(queries, search)


def postings(df: DataFrame, key: str = "doc_id", norm: str = "norm") -> DataFrame:
    """The positional index: key, pos, lexeme."""
    return df.select(key, F.posexplode(lexemes(F.col(norm))).alias("pos", "lexeme"))


def phrase_terms(parts: DataFrame) -> DataFrame:
    """query_id, part, ordinal, lexeme, length from rows (query_id, part, text): the words of each part in order."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    each = parts.withColumn("words", words).select("query_id", "part", F.size("words").alias("length"), F.posexplode("words").alias("ordinal", "lexeme"))
    return each


def occurrences(terms: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, part, length, key, at) where a document holds a part's words next to each other."""
    at = (F.col("pos") - F.col("ordinal")).alias("at")  # a place holds one lexeme, so each ordinal counts once
    return index.join(terms, "lexeme").groupBy("query_id", "part", "length", key, at).agg(F.count("*").alias("n")).filter("n = length").drop("n")


def phrase_search(terms: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score): documents that hold every part of a query, each part's words next to each other.

    score: how often the parts occur, each occurrence over the part's number of words.
    """
    by_part = occurrences(terms, index, key).groupBy("query_id", "part", key).agg(F.sum(F.lit(1.0) / F.col("length")).alias("s"))
    need = terms.groupBy("query_id").agg(F.countDistinct("part").alias("parts"))
    full = by_part.groupBy("query_id", key).agg(F.count("*").alias("have"), F.sum("s").alias("score")).join(need, "query_id").filter("have = parts")
    return full.select("query_id", key, F.round("score", 6).alias("score"))


def cover_density(terms: DataFrame, index: DataFrame | None, key: str = "doc_id", places: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score) of the documents that hold all parts 0, 1, .. of a query: the sum over its covers.

    A cover is a shortest stretch with every part; it counts 0.1, over one more than the words in it that belong to
    no part. Stretches are found by one fold over the occurrences of a query's parts in a document. places: those
    occurrences, where they are known already.
    """
    need = terms.select("query_id", "part", "length").distinct().groupBy("query_id").agg(F.count("*").alias("parts"), F.sum("length").cast("int").alias("own"))
    places = occurrences(terms, index, key) if places is None else places
    found = places.groupBy("query_id", key).agg(F.array_sort(F.collect_list(F.struct("at", "part", "length"))).alias("ev"))
    found = found.join(need, "query_id").filter(F.size(F.array_distinct(F.transform("ev", lambda e: e["part"]))) == F.col("parts"))
    no = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(F.struct(no.alias("b"), no.alias("e")), F.col("parts").cast("int")).alias("last"), F.array().cast("array<struct<b:int,e:int>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        here = F.struct(e["at"].cast("int").alias("b"), (e["at"] + e["length"] - 1).cast("int").alias("e"))
        last = F.transform(acc["last"], lambda x, i: F.when(i == e["part"], here).otherwise(x))
        cover = F.struct(F.array_min(F.transform(last, lambda x: x["b"])).alias("b"), F.array_max(F.transform(last, lambda x: x["e"])).alias("e"))
        new = F.forall(last, lambda x: x["b"].isNotNull()) & (F.coalesce(F.try_element_at(acc["out"], F.lit(-1))["b"], F.lit(-1)) != cover["b"])
        return F.struct(last.alias("last"), F.when(new, F.concat(acc["out"], F.array(cover))).otherwise(acc["out"]).alias("out"))

    covers = F.aggregate("ev", start, step, lambda acc: acc["out"])
    one = lambda c: F.lit(0.1) / (1 + F.greatest(F.lit(0), c["e"] - c["b"] + 1 - F.col("own")))
    return found.select("query_id", key, F.round(F.aggregate(covers, F.lit(0.0), lambda s, c: s + one(c)), 6).alias("score"))


def rerank(candidates: DataFrame, scorer: Column, item: str, n: int = RERANK_K) -> DataFrame:
    """The n best candidates of each query by a scorer's logits, as probabilities; without it, their first n."""
    return top(candidates.withColumn("score", F.round(sigmoid(scorer), 6)).drop("rnk"), "query_id", item, n)


def lexical_logit(asked: Column, held: Column) -> Column:
    """A scorer that needs no model: -4 to 4 by the share of the question's lexemes that a document holds."""
    return 8 * F.coalesce(F.try_divide(F.size(F.array_intersect(asked, held)).cast("double"), F.size(F.array_distinct(asked))), F.lit(0.0)) - 4


def fuse(branches: list[DataFrame], item: str, k: int = RRF_K, n: int = TOP_N) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, item, rnk); an item counts once in a branch."""
    each = [b.groupBy("query_id", item).agg(F.min("rnk").alias("rnk")) for b in branches]
    rows = each[0]
    for b in each[1:]:
        rows = rows.unionByName(b)
    summed = rows.groupBy("query_id", item).agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rnk"))), 9).alias("score"))
    return top(summed, "query_id", item, n)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def gate(scores: DataFrame, tau: float = TAU, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, top_score, answer_kind): grounded if the best score reaches tau.

    Queries of asked without any score, as when no source is ready, have no answer either, and no model is called.
    """
    best = scores.groupBy("query_id").agg(F.max("score").alias("top_score"))
    best = best if asked is None else asked.select("query_id").join(best, "query_id", "left")
    return best.withColumn("answer_kind", F.when(F.col("top_score") >= tau, "grounded").otherwise("no_answer"))


def threshold_sweep(scores: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """tau, precision, recall, f1 of rows (score, positive) at thresholds low..high hundredths."""
    taus = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))).alias("cents")
    hit = F.col("score") * 100 >= F.col("cents")
    counts = scores.select("score", "positive", taus).groupBy("cents").agg(
        F.count_if(hit & F.col("positive")).alias("tp"), F.count_if(hit & ~F.col("positive")).alias("fp"), F.count_if(~hit & F.col("positive")).alias("fn")
    )
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select("cents", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))
