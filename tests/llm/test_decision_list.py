import os
import re
from collections import Counter

import pytest

from docloom.llm import decision_list as dl


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if counts[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_statistics_match_brute_force(spark, corpus, empty):
    docs, rows = corpus
    extra = [(200, "a b c a b c a b c"), (201, "x " * 40), (202, "a b\na b\n\na b \n"), (203, "p q r s p q r t " * 9)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = [tuple(r)[:7] for r in dl.judge(more, []).collect()]
    want = [(i, *plain(t)) for i, t in [*((r[0], r[1]) for r in rows), *extra]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert dl.judge(empty, []).count() == 0


def test_learns_an_ordered_list_and_applies_it(spark):
    rows = [{"label": int(i % 4 > 0), **dict.fromkeys(dl.FEATURES, 0.0), "symbol_share": 0.3 + i / 1e4 if i % 8 == 0 else 0.01, "upper_share": 0.9 if i % 8 == 4 else 0.05} for i in range(400)]
    rules = dl.learn_rules(rows)
    assert rules and {t[0] for r in rules for t in r.tests} == {"symbol_share", "upper_share"}
    hit = lambda r: any(all((r[n] >= x) if up else (r[n] <= x) for n, up, x in rule.tests) for rule in rules)
    assert all(hit(r) == (r["label"] == 0) for r in rows)
    df = spark.createDataFrame([[float(r[f]) for f in dl.FEATURES] + [r["label"]] for r in rows], [*dl.FEATURES, "label"])
    assert df.filter((dl.verdict(rules) > 0) != (df.label == 0)).count() == 0


def test_no_labels_keep_all_that_pass_the_base(spark, corpus):
    docs, _ = corpus
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert dl.fit_rules(docs, labels) == []


def test_no_python_in_the_plan(spark, corpus):
    plan = dl.judge(corpus[0], [])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_rows_of_the_given_labels(spark):
    """Of documents that pass the base, good ones are kept and bad ones go."""
    from pyspark.sql import functions as F

    from docloom.llm.shared import is_held_out

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = dl.judge(docs, dl.fit_rules(docs, labels)).select("doc_id", "base_failed", "kept").collect()
    truth = {r.doc_id: r.quality for r in labels.filter(is_held_out(F.col("doc_id"))).collect()}
    held = [(truth[r.doc_id], r.kept) for r in judged if r.doc_id in truth and not r.base_failed]
    good, bad = [k for q, k in held if q == 1], [k for q, k in held if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad) and len(bad) >= 5
