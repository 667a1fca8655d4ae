import random
from itertools import product

from docloom.llm import mixing


def test_targets_share_the_excess_by_weight():
    got = mixing.targets([100, 10, 100, 40])
    assert abs(sum(got) - 1.5 * 250) < 1e-9 and all(t <= 2 * s + 1e-9 for t, s in zip(got, [100, 10, 100, 40], strict=True))
    assert got[1] == 20  # its share is 375 / 9, above twice its size
    rest = [g / w for g, w in zip(got, (3, 1, 2, 3), strict=True) if g < 2 * 100 and g not in (20, 80)]
    assert max(rest) - min(rest) < 1e-9
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_flow_is_cheapest_of_the_largest():
    rnd = random.Random(1)
    for _ in range(40):
        supplies = [rnd.randint(0, 3) for _ in range(3)]
        members = [sorted(rnd.sample(range(2), rnd.randint(1, 2))) for _ in range(3)]
        quotas = [rnd.randint(0, 6) for _ in range(2)]
        flow = mixing.min_cost_flow(supplies, members, quotas)
        cost = lambda s, x: sum(2 * (k // s) + 1 for k in range(x)) if s else 0
        options = [[(a, b) for a in range(2 * s + 1) for b in range(2 * s + 1 - a) if (a == 0 or 0 in m) and (b == 0 or 1 in m)] for s, m in zip(supplies, members, strict=True)]
        best = min((-sum(map(sum, c)), sum(cost(s, sum(x)) for s, x in zip(supplies, c, strict=True))) for c in product(*options) if all(sum(x[i] for x in c) <= quotas[i] for i in (0, 1)))
        assert all(sum(f.get(i, 0) for f in flow) <= quotas[i] for i in (0, 1))
        assert (-sum(sum(f.values()) for f in flow), sum(cost(s, sum(f.values())) for s, f in zip(supplies, flow, strict=True))) == best


def test_mix_meets_targets_and_repeats_itself(spark, corpus, empty):
    docs, rows = corpus
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    words = lambda t: len((t or "").split(" ") and [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[n] for n in names]), strict=True))
    assert sorted((r[0], r[1]) for r in got if r[0] is not None) == sorted((i, words(t)) for i, t, _, _ in rows if i is not None)
    taken = dict.fromkeys(goal.values(), 0)
    for _, size, source_size, target, used in got:
        assert source_size in sizes.values() and used in (0, size, 2 * size)
        taken[target] += used
    for target, used in taken.items():
        assert abs(used - target) <= 1 + max(r[1] for r in got if r[3] == target and r[1] < 30_000) or target < 60_000
    assert sorted(got, key=str) == sorted((tuple(r) for r in mixing.mix(docs.repartition(3)).collect()), key=str)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_rows_follow_the_plan(spark, corpus):
    docs, _ = corpus
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = {}
    for r in mixing.mix(docs).collect():
        if r.size:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken // r.size
    have = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert have == {k: v for k, v in want.items() if v}


def test_overlapping_members(spark):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(["w"] * (10 + i % 5)), "a" if i % 2 else "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    both = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))
    got = mixing.mix(docs, members=both).collect()
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - sum(mixing.targets([sum(r.size for r in got if r.doc_id % 2 or r.doc_id % 4 == 0), sum(r.size for r in got if r.doc_id % 2 == 0)]))) < 0.02 * total


def test_flow_ends_at_its_bound():
    """As many patterns as are allowed, over thirty sources."""
    import time

    rnd = random.Random(9)
    n = mixing.MOST_PATTERNS
    members = [sorted(rnd.sample(range(30), rnd.randint(1, 6))) for _ in range(n)]
    supplies = [rnd.randint(0, 10_000) for _ in range(n)]
    began = time.time()
    flow = mixing.min_cost_flow(supplies, members, [round(1.2 * sum(supplies) / 30 * (1 + s % 3)) for s in range(30)])
    assert time.time() - began < 60
    assert all(sum(f.values()) <= 2 * s and set(f) <= set(m) for f, s, m in zip(flow, supplies, members, strict=True))


def test_null_and_empty_members(spark):
    """No members, or null ones, are the source null; order and repeats within an array make no new pattern."""
    rows = [(1, "a b c", ["x", "y"]), (2, "a b c", ["y", "x", "y"]), (3, "d e", []), (4, "f", None), (5, None, ["x"]), (6, "g h", [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in mixing.mix(docs, members=F.col("m")).collect()}
    assert len(got) == 6 and got[3].source_size == got[4].source_size == got[6].source_size == 5 and got[5].taken == 0
    assert got[1].source_size == got[2].source_size == 6
    assert mixing.mixed(docs, members=F.col("m")).columns == docs.columns
