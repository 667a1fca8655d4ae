import random
import zlib
from collections import Counter, defaultdict

from docloom.llm import sharding


def check(got, shards):
    counts = Counter(r.shard for r in got)
    each = [counts.get(s, 0) for s in range(shards)]
    assert max(each) - min(each) <= 1 and set(counts) <= set(range(shards))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_counts_slots_and_groups(spark, corpus, empty):
    docs, rows = corpus
    got = sharding.shard_documents(docs, shards=4).collect()
    check(got, 4)
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows if i is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
    of = Counter(r.text_crc32 for r in got)
    assert all(len(groups[k]) == 1 for k, n in of.items() if 1 < n <= 5)
    assert sharding.shard_documents(empty).count() == 0
    check(sharding.shard_documents(docs.limit(3)).collect(), 40)


def test_a_group_above_a_shard_is_cut(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    check(got, 10)
    held = Counter(r.shard for r in got if r.doc_id < 1000)
    assert sum(held.values()) == 300 and max(held.values()) <= 60


def test_rows_keep_their_columns(spark, corpus):
    docs, rows = corpus
    out = sharding.with_shards(docs, shards=5)
    assert out.columns == [*docs.columns, "_shard", "_slot"] and out.count() == len(rows)


def test_links_pull_neighbours_together(spark):
    links = [(20 * c, 20 * c + i) for c in range(30) for i in range(1, 20)]
    labels = {r.node: r.shard for r in sharding.propagate(spark.createDataFrame(links, "u long, v long"), 6, 140).collect()}
    cut = sum(labels[a] != labels[b] for a, b in links)
    assert cut <= 0.2 * len(links) and max(Counter(labels.values()).values()) <= 140


def test_requests_against_a_plain_version(spark):
    """On small graphs, in even and odd rounds: the shard of most smaller (larger) neighbours, if it beats the own one."""
    rnd = random.Random(3)
    for k in range(4):
        pairs = {(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(60)) if a != b}
        sym = sorted(pairs | {(b, a) for a, b in pairs})
        of = {n: rnd.randrange(4) for n in range(30)}
        want = {}
        for u in {a for a, _ in sym}:
            seen = [v for a, v in sym if a == u and ((v < u) if k % 2 == 0 else (v > u))]
            votes = Counter(of[v] for v in seen)
            if votes:
                best = max(votes, key=lambda s: (votes[s], -s))
                if votes[best] > votes.get(of[u], 0):
                    want[u] = (best, min(v for v in seen if of[v] == best))
        links, labels = spark.createDataFrame(sym, "u long, v long"), spark.createDataFrame(list(of.items()), "node long, shard int")
        assert {r.node: (r.to, r.lead) for r in sharding.requests(links, labels, k).collect()} == want


def test_large_groups_stay_whole(spark):
    """Groups of nearly a shard's size each lie in one shard, whatever else has to be dealt."""
    rows = [(100 * g + i, f"group {g}") for g in range(3) for i in range(55)] + [(1000 + i, f"text {i}") for i in range(435)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    check(got, 10)
    assert all(len({r.shard for r in got if r.doc_id // 100 == g}) == 1 for g in range(3))
