"""Compound words: pairs of words that a corpus writes together far more often than chance, joined by _ in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SPACE

#: Occurrences of a pair, and its score, from which it is a compound.
MIN_COUNT, MIN_SCORE = 5, 10_000


def word_array(norm: Column) -> Column:
    """Words between white space, without marks at their ends, in lower case; marks alone drop out."""
    words = F.transform(F.split(F.lower(norm), f"[{SPACE}]+"), lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    return F.filter(words, lambda w: w != "")


def lexicon(docs: DataFrame, norm: str = "norm", min_count: int = MIN_COUNT, min_score: int = MIN_SCORE) -> DataFrame:
    """first, second, score of the pairs of neighbouring words that occur min_count times or more.

    score: 1000 * c(pair) * n / (c(first) * c(second)), rounded down, where n counts all words. Counts cover all texts and
    are summed before they are shuffled.
    """
    words = docs.select(word_array(F.col(norm)).alias("w"))
    pairs = words.select(F.inline(F.arrays_zip(F.col("w").alias("first"), F.slice("w", 2, 2**31 - 1).alias("second"))))
    both = pairs.groupBy("first", "second").agg(F.count("*").cast("decimal(19,0)").alias("c"))
    single = both.groupBy("first").agg(F.sum("c").cast("decimal(19,0)").alias("n_first"))  # pairs with null hold a text's last word
    total = single.agg(F.sum("n_first").cast("decimal(19,0)").alias("n"))
    often = both.filter(F.col("second").isNotNull() & (F.col("c") >= min_count))
    scored = often.join(single, "first").join(single.select(F.col("first").alias("second"), F.col("n_first").alias("n_second")), "second")
    scored = scored.withColumn("n", total.scalar()).withColumn("score", F.expr("(1000 * c * n) div (n_first * n_second)"))
    return scored.filter(F.col("score") >= min_score).select("first", "second", "score")


def segmented(questions: DataFrame, pairs: DataFrame, key: str = "query_id", norm: str = "norm") -> DataFrame:
    """key, words: each question's words in order, compounds joined by _, on the path with the highest sum of scores.

    A word belongs to one compound at most; of equal paths the one whose last words stay single. Pairs are looked up by a join
    on those that questions hold; the path is one fold over a question's words.
    """
    w = questions.select(key, word_array(F.coalesce(F.col(norm), F.lit(""))).alias("w"))
    asked = w.select(key, F.posexplode(F.arrays_zip(F.col("w").alias("first"), F.slice("w", 2, 2**31 - 1).alias("second"))).alias("i", "p")).select(key, "i", "p.first", "p.second").filter("second is not null")
    found = asked.join(pairs, ["first", "second"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") + 1).alias("i"), "score"))).alias("s"))
    both = w.join(found, key, "left")
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<string>")
    # one and two: the best score and words up to the word before, and up to the one before that
    start = F.struct(zero.alias("i"), zero.alias("one"), empty.alias("path"), zero.alias("two"), empty.alias("before"), F.lit("").alias("last"))

    def step(a: Column, x: Column) -> Column:
        pair = F.coalesce(F.try_element_at(F.col("s"), a["i"].cast("int")), zero)
        join = (pair > 0) & (a["two"] + pair > a["one"])
        path = F.when(join, F.concat(a["before"], F.array(F.concat(a["last"], F.lit("_"), x)))).otherwise(F.concat(a["path"], F.array(x)))
        return F.struct((a["i"] + 1).alias("i"), F.when(join, a["two"] + pair).otherwise(a["one"]).alias("one"), path.alias("path"), a["one"].alias("two"), a["path"].alias("before"), x.alias("last"))

    return both.select(key, F.aggregate("w", start, step, lambda a: a["path"]).alias("words"))
