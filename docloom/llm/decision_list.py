"""Quality rules: an ordered list of threshold conjunctions, learnt by sequential covering, as Spark conditions.

Statistics of whole texts are plain column expressions. The learner sees the statistics of a bounded sample of
labelled rows; it grows one conjunction at a time by information gain, prunes it on rows set aside, and takes the
rows it covers away. The list becomes one CASE expression; nothing but DataFrame functions runs over the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import WORD, as_text, labelled_sample, read

#: Bound of the labelled sample, for each of the two classes.
PER_CLASS = 4000
#: Statistics that the rules may test.
FEATURES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share"]


@dataclass(frozen=True)
class Rule:
    """Rows that meet all of (statistic, is "at least" rather than "at most", threshold) are rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def condition(self) -> Column:
        out = F.lit(True)
        for name, at_least, x in self.tests:
            out = out & (F.col(name) >= F.lit(x) if at_least else F.col(name) <= F.lit(x))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<='} {x:.4g}" for n, up, x in self.tests)


def _repeat_words(words: str) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash. Texts without a repeated window, most of them, stop at a distinct
    count; the others sort (hash, place) and look at neighbours, so the cost stays n log n for any text.
    """
    at = lambda k: F.get(F.col(words), k)
    hashes = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.array(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))

        def starts(s: Column) -> Column:
            same = lambda p, k: F.coalesce(F.get(s, k)["x"] == p["x"], F.lit(False))
            return F.transform(F.filter(s, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"])

        places = F.flatten(F.transform(pairs, starts))
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    # the one-element array binds the hashes to a name, so that they are computed once
    return F.get(F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))), F.lit(0)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the counts of its whole text, and the FEATURES made from them."""
    t = docs.select(F.col(id_col).alias("doc_id"), as_text(text_col).alias("text"))
    t = t.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    t = t.withColumns({"lines": lines, "n_words": F.size("words").cast("long")})
    t = t.select(
        "doc_id",
        "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("words").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return t.withColumns({
        "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars"), "mark_share": share("n_marks", "n_words"), "distinct_share": share("n_distinct", "n_words"),
    })


def learn_rules(rows: list[dict], features: list[str] = FEATURES, cuts: int = 24, most_rules: int = 16, most_tests: int = 4, precision: float = 0.9) -> list[Rule]:
    """A decision list that rejects label 0, from bounded rows with the features and label; every third row prunes.

    Thresholds lie halfway between neighbouring values, at quantiles of all rows and of those of label 0, which are
    few. Sets of rows are bit sets. A rule is kept while at least `precision` of what it covers has label 0, on the rows
    set aside too where it covers any. No rows of label 0 give an empty list.
    """
    full = (1 << len(rows)) - 1
    bits = lambda f: sum(1 << i for i, r in enumerate(rows) if f(i, r))
    bad, prune = bits(lambda i, r: r["label"] == 0), bits(lambda i, r: i % 3 == 2)
    tests: dict[tuple[str, bool, float], int] = {}
    for name in features:
        values = sorted({r[name] for r in rows})
        below = dict(zip(values[1:], values, strict=False))
        ends = [sorted(r[name] for r in rows if r["label"] in kinds) for kinds in ((0,), (0, 1))]
        for x in sorted({(v[i] + below[v[i]]) / 2 for v in ends for k in range(cuts) if v[i := len(v) * k // cuts] in below} if ends[0] else ()):
            for up in (True, False):
                tests[name, up, x] = bits((lambda i, r: r[name] >= x) if up else (lambda i, r: r[name] <= x))  # noqa: B023

    def counts(cover: int) -> tuple[int, int]:
        return (cover & bad).bit_count(), (cover & ~bad & full).bit_count()

    def gain(cover: int, more: int) -> float:
        (p0, n0), (p1, n1) = counts(cover), counts(cover & more)
        return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0

    rules, left = [], full
    while len(rules) < most_rules and (left & bad & ~prune):
        cover, chosen = left & ~prune, []
        while counts(cover)[1] and len(chosen) < most_tests:
            best = max(tests, key=lambda t: (gain(cover, tests[t]), t), default=None)  # noqa: B023
            if best is None or gain(cover, tests[best]) <= 0:
                break
            chosen.append(best)
            cover &= tests[best]
        value = {}
        for k in range(1, len(chosen) + 1):
            on = left & prune
            for t in chosen[:k]:
                on &= tests[t]
            p, n = counts(on)
            value[k] = ((p - n) / (p + n) if p + n else -1.0, -k)
        if not value:
            break
        chosen = chosen[: max(value, key=value.__getitem__)]
        cover = left
        for t in chosen:
            cover &= tests[t]
        (p, n), (q, m) = counts(cover & ~prune), counts(cover & prune)
        if p < precision * (p + n) or q < precision * (q + m) or not p:
            break
        rules.append(Rule(tuple(chosen)))
        left &= ~cover
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **options) -> list[Rule]:
    """Rules from the labelled rows (quality) of docs that are not held out, at most per_class of each class.

    Rows that fail the base are left out: rules have to tell apart only what the base lets pass. Repeated rows of an id
    count once; ids with both labels not at all.
    """
    sample = labelled_sample(labels, "quality", per_class)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = statistics(picked.dropDuplicates(["doc_id"])).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "n_words", "n_repeat_words", *FEATURES).collect()
    passed = [r.asDict() for r in rows if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    return learn_rules(sorted(passed, key=lambda r: r["doc_id"]), **options)


def _fails_base() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1; 0 if it meets none and is kept."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].condition(), k).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept for each row.

    Null texts count as empty; texts under 50 words fail the base and are not kept. Repeated rows and null ids stay
    as they are; other columns of docs are ignored; an empty table gives an empty result.
    """
    out = statistics(docs).withColumns({"base_failed": _fails_base(), "rule": verdict(rules)})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op2_decision_list": op2_decision_list}
ORACLE_SQL: dict[str, str] = {}
