import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from docloom.llm import simhash
from docloom.llm.components import connected_components


def plain_fingerprint(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_wide(text):
    """The wide fingerprint, bit by bit, as a number whose leading bit is the first."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if not words:
        return 0
    grams = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))}

    def bits(h):
        out = ""
        for k in range(1, 17):
            z = (h + k * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
            out += "".join(f"{b:08b}" for b in (z ^ (z >> 31)).to_bytes(8, "little"))
        return int(out, 2)

    each = [bits(h) for h in sorted(grams)]
    counts = np.sum([np.frombuffer(b"".join(b"%d" % (e >> i & 1) for i in range(1024)), np.uint8) - 48 for e in each], axis=0, dtype=int)
    ties = each[0]
    return sum(1 << i for i in range(1024) if 2 * counts[i] > len(each) or (2 * counts[i] == len(each) and ties >> i & 1))


def plain_similar(a, b, limit=166):
    """Whether two wide fingerprints share a key of three bytes and differ in no more than limit bits."""
    d = (a ^ b).to_bytes(128, "big")
    return (a ^ b).bit_count() <= limit and any(not (d[i] | d[(i + 1) % 128] | d[(i + 3) % 128]) for i in range(128))


def plain_roots(nodes, close):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and close(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_match_brute_force(spark, corpus):
    docs, rows = corpus
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    fps = [plain_fingerprint(t) for _, t, _, _ in rows]
    roots = plain_roots(set(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[roots[f]].append(i)
    want = [(i, f"{f:016x}", min(least[roots[f]], default=None)) for (i, *_), f in zip(rows, fps, strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_shingle_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    text = "ab cd éf"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text, 42)


def test_chunked_keys_lose_no_link(spark):
    """Keys of many near fingerprints, cut into small cells, join the same groups as all pairs."""
    rng = np.random.default_rng(1)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    values = {c for c in centre}
    for c in centre:
        for _ in range(60):
            values.add(c ^ sum(1 << int(b) for b in rng.choice(63, 2, replace=False)))
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.link_fingerprints(df, cell=16)).collect()}
    want = plain_roots(values, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {v: got.get(v, v) for v in values} == want


def test_one_row_of_each_group_stays(spark, corpus, empty):
    docs, _ = corpus
    classes = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted(set(classes.values()), key=str)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_row_of_each_similar_group_stays(spark, corpus, empty):
    """The rows of the least id of each group of plain fingerprints; nulls, empty, long and repeated texts included."""
    docs, rows = corpus
    short = [r for r in rows if len(r[1] or "") < 50_000]
    fps = {r[1]: plain_wide(r[1]) for r in short}
    roots = plain_roots(set(fps.values()), plain_similar)
    least = defaultdict(list)
    for i, text, *_ in short:
        least[roots[fps[text]]].append((i is None, i or 0))
    kept = simhash.one_of_similar(docs)
    assert kept.columns == docs.columns
    want = [None if n else i for n, i in map(min, least.values())] + [r[0] for r in rows if len(r[1] or "") >= 50_000]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert simhash.one_of_similar(empty).count() == 0


def test_wide_fingerprint_of_a_long_text():
    rnd = random.Random(3)
    text = " ".join(str(rnd.randrange(500)) for _ in range(1500))
    assert int.from_bytes(simhash.wide_fingerprint(text), "big") == plain_wide(text)


def test_wide_links_in_small_cells(spark):
    """Keys cut into small cells join the same groups as all pairs that share a key."""
    rnd = random.Random(2)
    values = []
    for _ in range(3):
        centre = rnd.getrandbits(1024)
        values += [centre ^ sum(1 << b for b in rnd.sample(range(1024), rnd.randint(1, 120))) for _ in range(40)]
    df = spark.createDataFrame([(i, bytearray(v.to_bytes(128, "big"))) for i, v in enumerate(values)], "node long, fp binary")
    got = {r.node: r.root for r in connected_components(simhash.link_wide(df, 166, cell=8)).collect()}
    want = plain_roots(range(len(values)), lambda a, b: plain_similar(values[a], values[b]))
    assert {i: got.get(i, i) for i in range(len(values))} == want


def test_similar_texts_are_linked_and_others_left():
    """Words replaced at random: of pairs with 5-word similarity 0.8 or more 19 in 20 are linked, of those under 0.7 none."""
    rnd = random.Random(4)
    seen = {True: [], False: []}
    for _ in range(400):
        one = [str(rnd.randrange(5000)) for _ in range(rnd.randint(60, 400))]
        rate = rnd.choice([0.005, 0.01, 0.02, 0.03, 0.06, 0.08])
        other = [str(rnd.randrange(5000)) if rnd.random() < rate else w for w in one]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, other))
        like = len(a & b) / len(a | b)
        linked = plain_similar(*(int.from_bytes(simhash.wide_fingerprint(" ".join(w)), "big") for w in (one, other)), simhash.wide_distance(0.8))
        if like >= 0.8 or like < 0.7:
            seen[like >= 0.8].append(linked)
    assert sum(seen[True]) >= 0.95 * len(seen[True]) and not any(seen[False]) and min(map(len, seen.values())) > 50
