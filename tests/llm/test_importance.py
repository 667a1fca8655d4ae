import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import importance
from docloom.llm.shared import written


def features(text, buckets=10_000, longest=1):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)], len(ws)


def plain(rows, items, longest=1, percent=10, enough=20):
    """(doc_id, n_features, weight, score, words) of each row, and the drawn scores in order."""
    count = lambda texts: [b for t in texts for b in features(t, longest=longest)[0]]
    s, t = count(r[1] for r in rows), count(items)
    in_s, in_t = {}, {}
    for b in s:
        in_s[b] = in_s.get(b, 0) + 1
    for b in t:
        in_t[b] = in_t.get(b, 0) + 1
    gain = lambda b: math.floor(1000 * math.log((in_t.get(b, 0) + 1) * (len(s) + 10_000) / ((in_s.get(b, 0) + 1) * (len(t) + 10_000))))
    out = []
    for i, text, *_ in rows:
        f, n = features(text, longest=longest)
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    fit = sorted(((-r[3], r[0] is None, r[0] or 0) for r in out if r[4] >= enough))
    return out, fit[: percent * len(fit) // 100]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (1, 100), (3, 37)])
def test_matches_brute_force(spark, corpus, longest, percent):
    docs, rows = corpus
    items = [rows[3][1], rows[8][1], None, ""]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    want, first = plain(rows, items, longest, percent)
    got = importance.resample(docs, target, longest=longest, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == sorted((r[:4] for r in want), key=str)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(first) + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in drawn] == first


def test_empty_tables(spark, corpus, empty):
    docs, rows = corpus
    target = docs.select("text").limit(3)
    assert importance.resample(empty, target).count() == 0
    out = importance.resample(docs, target.limit(0)).collect()
    assert len(out) == len(rows) and sum(r["rank"] is not None for r in out) > 0
    assert {r["rank"] for r in importance.resample(docs, target, percent=0).collect()} == {None}


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 31}" for k in range(30)), "clash") for i in range(50)], "doc_id long, text string, rank string")
    out = importance.drawn(docs, docs.limit(2), percent=20)
    assert out.columns == ["doc_id", "text", "rank", "_rank"] and sorted(r._rank for r in out.collect()) == list(range(1, 11))


@pytest.mark.parametrize("n", [1, 2, 5000, 60_000])
def test_cutoff_is_the_exact_key(spark, n, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 8)  # rounds go on to the end
    monkeypatch.setattr(importance, "BLOCK", 700)
    rnd = random.Random(n)
    keys = [(rnd.randrange(40), rnd.randrange(2), rnd.randrange(1000), 5, at) for at in range(n)]
    table = written(spark.createDataFrame(keys, "less long, none long, id long, f long, at long").repartition(7), "t")
    for k in {1, n // 10 or 1, n // 2 or 1, n}:
        assert importance.cutoff(table, k).tuple() == sorted(keys)[k - 1]
    assert importance.cutoff(table, n + 1) is None and importance.cutoff(table, 0) is None


def test_median_of_medians_discards_a_quarter_at_least():
    rnd = random.Random(1)
    blocks = [sorted((rnd.gauss(b, 3), b, 0, 0, i) for i in range(rnd.choice([1, 5, 900]))) for b in range(40)]
    found = [(len(b), importance.Key(*b[(len(b) - 1) // 2])) for b in blocks]
    pivot, every = importance.weighted_median(found).tuple(), sorted(x for b in blocks for x in b)
    place = every.index(pivot)
    assert 0.24 * len(every) <= place <= 0.76 * len(every)


def test_gains_of_an_absent_bucket_use_both_totals(spark):
    docs = spark.createDataFrame([("a b a",)], "text string").select(importance.buckets_of(F.col("text")).alias("features"))
    gain = importance.gains(docs, docs.limit(0))
    assert len(gain) == 10_000 and gain[zlib.crc32(b"a") % 10_000] == math.floor(1000 * math.log(10_003 / (3 * 10_000)))
