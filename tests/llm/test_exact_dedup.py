import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from docloom.llm import exact_dedup
from docloom.llm.shared import written


def stripped(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and the sizes of groups."""
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[stripped(text)].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for i, text, *_ in rows:
        group = groups[stripped(text)]
        out.append((i, min(group)[3], len(group), hashlib.sha256(stripped(text).encode()).hexdigest()))
    return sorted(out, key=str), groups


def test_matches_brute_force(spark, corpus, empty):
    docs, rows = corpus
    want, groups = plain(rows)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.distinct_texts(empty).columns == docs.columns


def test_rows_that_stay_keep_all_columns(spark, corpus):
    docs, rows = corpus
    out = exact_dedup.distinct_texts(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    want, groups = plain(rows)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((min(g)[3] for g in groups.values()), key=str)
    assert {r.score for r in out.collect()} == {"clash"}


def test_white_space_and_ties(spark):
    rows = [(3, "a b"), (2, "a  b"), (1, "ab"), (4, "a b"), (5, "A b"), (None, "x"), (9, "x"), (8, "x"), (7, "\x0b\x0c"), (6, None), (10, "a\x85b"), (None, "y z"), (None, "yz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {(3, 2, 3, False), (2, 2, 3, True), (1, 2, 3, False), (4, 4, 1, True), (5, 5, 1, True), (None, 8, 3, False), (9, 8, 3, False), (8, 8, 3, True), (7, 7, 2, True), (6, 7, 2, False), (10, 10, 1, True), (None, None, 2, True), (None, None, 2, False)}


def test_filter_never_misses_and_lets_few_pass(spark):
    """Every repeated hash passes; of unique ones about one in a hundred does."""
    hashes = written(spark.range(40_000).select(F.when(F.col("id") < 13_000, F.lit(7)).otherwise(F.col("id") - F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("k")).select(F.xxhash64("k").alias("h")), "t")
    words = exact_dedup.words_for(40_000)
    plane = exact_dedup.repeated_bits(hashes, words)
    alone, repeated = exact_dedup._probed(hashes, plane, words)
    count = hashes.groupBy("h").count()
    assert alone.join(count.filter("count > 1"), "h").count() == 0
    assert alone.count() + repeated.count() == 40_000
    assert repeated.join(count.filter("count = 1"), "h").count() < 0.02 * 27_000


def test_only_repeated_rows_are_shuffled(spark, corpus):
    """The plan has no Python and groups or joins nothing but what the filter lets pass."""
    plan = exact_dedup.exact_groups(corpus[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    alone = plan.split("Union")[1].split("BroadcastHashJoin")[1]
    assert "hashpartitioning" not in plan.split("Union")[0] and "LeftOuter" in alone
