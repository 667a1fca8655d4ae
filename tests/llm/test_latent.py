import random

import numpy as np
import pyarrow as pa

from docloom.llm import latent


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_lcs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 70)), rng.integers(0, 6, rng.integers(0, 90))
        assert latent.common(len(a), latent.places(a), b) == lcs(a.tolist(), b.tolist())


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(1)
    dense = rng.standard_normal((60, 25)) * np.linspace(3, 0.1, 25)
    rows = spark.createDataFrame([(list(range(25)), [float(x) for x in r]) for r in dense], "ids array<int>, values array<double>").repartition(3)
    values, vectors = latent.svd(rows, 25, 12, rounds=12)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values[:6], s[:6], rtol=1e-2)
    assert np.allclose(np.abs((vectors[:, :4] * vt[:4].T).sum(axis=0)), 1, atol=5e-2)


def build_case(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(4, 9))) for _ in range(6000)]
    common = ["the", "of", "and", "in", "to"]
    prose = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(vocabulary) for _ in range(n)]
    items = {i: prose(rnd.randint(15, 60)) for i in range(30)}
    docs, planted = [], set()
    for d in range(200):
        words = prose(rnd.randint(5, 300))
        if d % 5 == 0:
            i = rnd.randrange(30)
            item = items[i][:]
            if d % 10 == 0:  # a paraphrase: every eighth word another one, case and marks changed
                item = [rnd.choice(vocabulary) if k % 8 == 3 else w.upper() + "," for k, w in enumerate(item)]
            at = rnd.randint(0, len(words))
            words = words[:at] + item + words[at:]
            planted.add((d, i))
        docs.append((d, " ".join(words), "clash"))
    docs += [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (None, " ".join(items[3]), "x"), (903, "the of and " * 2000, "x")]
    planted.add((None, 3))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, "")], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), benchmark, planted


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    docs, benchmark, planted = build_case(spark)
    index = latent.build(docs, benchmark)
    found = {(r.doc_id, r.item_id) for r in latent.find_leaks(docs, index).collect()}
    assert found <= planted and len(found) >= 0.95 * len(planted)
    kept = latent.without_leaks(docs, index)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in docs.collect() if r.doc_id not in {d for d, _ in found}), key=str)


def test_candidates_match_brute_force_cosines(spark):
    """Every window of every text against every passage, one by one, gives the same candidates, folded or not."""
    docs, benchmark, _ = build_case(spark)
    index = latent.build(docs, benchmark)
    texts = [r.text for r in docs.collect()]
    ids, begins = latent.Terms(index.vocabulary).of(pa.array(texts))
    want, rim = set(), set()
    for d, ws in enumerate(latent.words(pa.array(texts)).to_pylist()):
        ws = [w for w in ws if w]
        assert ws == [w for t in (texts[d] or "").lower().split() if (w := t.strip(latent.EDGE))]
        mine = [index.vocabulary.get(w, -1) for w in ws]
        assert [t if t < len(index.vocabulary) else -1 for t in ids[begins[d] : begins[d + 1]].tolist()] == mine
        for a in latent.starts(len(ws)) if ws else ():
            t, k = np.unique(ids[begins[d] + a : begins[d + 1]][: latent.WINDOW], return_counts=True)
            latent_sum = sum((n * index.basis[x] for x, n in zip(t, k, strict=True) if x < len(index.vocabulary)), np.zeros(index.basis.shape[1]))
            cos = latent_sum @ index.queries / max(1e-9, np.linalg.norm(k * index.idf[t]))
            want |= {(int(begins[d] + a), int(index.owner[q])) for q in np.flatnonzero(cos >= index.cosine + 1e-5)}
            rim |= {(int(begins[d] + a), int(index.owner[q])) for q in np.flatnonzero(cos >= index.cosine - 1e-5)}
    got = {(int(a), int(i)) for a, i, _ in zip(*index.candidates(ids, begins), strict=True)}
    assert len(want) > 20 and want <= got <= rim
    index.ready.table, index.ready.folded = np.vstack([index.basis, np.zeros_like(index.basis[:1])]), False
    unfolded = {(int(a), int(i)) for a, i, _ in zip(*index.candidates(ids, begins), strict=True)}
    assert want <= unfolded <= rim
    latent._READY.clear()


def test_repeated_words_are_counted_in_the_norm_too(spark):
    item = "alpha beta gamma delta alpha alpha alpha alpha epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, item), (2, "other words here")], "doc_id long, text string")
    index = latent.build(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    _, _, cos = index.candidates(*latent.Terms(index.vocabulary).of(pa.array([item])))
    assert np.allclose(cos, 1, atol=1e-3)


def test_repeated_rows_and_ids(spark):
    """Repeated documents give repeated rows; items with the same or no id are items of their own."""
    rnd = random.Random(11)
    one, two = (" ".join("".join(rnd.choice("abcdefghil") for _ in range(7)) for _ in range(20)) for _ in range(2))
    docs = spark.createDataFrame([(1, one), (1, one), (2, f"{one} and {two}"), (3, "clean words only")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, one), (5, two), (None, two), (None, two)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id or 0) for r in latent.find_leaks(docs, latent.build(docs, benchmark)).collect())
    assert found == [(1, 5), (1, 5), (2, 0), (2, 0), (2, 5), (2, 5)]


def test_empty_tables(spark):
    docs, benchmark, _ = build_case(spark)
    assert latent.find_leaks(docs.limit(0), latent.build(docs.limit(0), benchmark)).count() == 0
    assert latent.find_leaks(docs, latent.build(docs, benchmark.limit(0))).count() == 0


def test_a_passage_of_a_third_of_all_documents_is_found(spark):
    """However often a passage stands in the corpus and however rare the words around it, its copies are found."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(9))
    known = [word() for _ in range(200)]
    items = {i: [rnd.choice(known) for _ in range(n)] for i, n in enumerate([12, 20, 48, 4])}
    docs, planted = [], set()
    for d in range(240):
        words = [word() for _ in range(rnd.randint(20, 120))]
        if d % 3 == 0:
            for i, item in items.items():
                at = rnd.randint(0, len(words))
                words[at:at] = [word(), *item[:2], "--", *item[2:], word()] if len(item) > 40 else [word(), *item, word()]
        docs.append((d, " ".join(words)))
    for d, t in docs:
        planted |= {(d, i) for i, item in items.items() if " ".join(item) in t.replace(" -- ", " ")}
    assert len(planted) >= 240
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    index = latent.build(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in latent.find_leaks(docs, index).collect()}
    assert planted - found == set() and all(d % 3 == 0 for d, _ in found)


def test_passages_find_themselves_at_any_rank(spark, monkeypatch):
    """A rank far below the number of passages keeps little of them, yet each one's copy has its whole cosine."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(8)) for _ in range(3000)]
    items = [(i, " ".join(rnd.choices(words, k=32))) for i in range(600)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(latent, "RANK", 100, raising=False)
    monkeypatch.setattr(latent, "CELLS", 0, raising=False)
    monkeypatch.setattr(latent, "MOST_RANK", 100, raising=False)
    index = latent.build(benchmark, benchmark)
    terms, low = latent.Terms(index.vocabulary), []
    for i, text in items:
        _, item, cos = index.candidates(*terms.of(pa.array([text])))
        low += [i] if not (cos[item == i] > 0.9).any() else []
    assert index.basis.shape[1] <= 100 and low == []


def test_words_of_an_item_in_any_order_are_no_leak(spark):
    """Shuffles of an item, however many, and a long page half of whose words are the item's; a copy among them is found."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(4, 9))) for _ in range(3000)]
    item = rnd.sample(vocabulary, 30)
    shuffles = lambda k: " ".join(w for _ in range(k) for w in rnd.sample(item, 30))
    page = lambda: " ".join(rnd.choice(item if rnd.random() < 0.5 else vocabulary) for _ in range(3000))
    docs = [(k, shuffles(k)) for k in (1, 2, 5, 10, 40)] + [(100 + k, page()) for k in range(5)]
    docs += [(200, f"{page()} {' '.join(item)} {page()}"), (201, f"{shuffles(10)} {' '.join(item)} {shuffles(10)}")]
    docs += [(300 + k, " ".join(rnd.choice(vocabulary) for _ in range(100))) for k in range(50)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    index = latent.build(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in latent.find_leaks(docs, index).collect()} == {200, 201}


def test_cosines_are_those_of_whole_vectors(spark, monkeypatch):
    """Up to the rank's bound nothing of a passage is lost, whatever the corpus holds: candidates are those of plain TF-IDF."""
    docs, benchmark, _ = build_case(spark)
    svd, rows = latent.svd, []
    monkeypatch.setattr(latent, "svd", lambda matrix, *shape: rows.append(matrix.count()) or svd(matrix, *shape))
    index = latent.build(docs, benchmark)
    ids, begins = latent.Terms(index.vocabulary).of(pa.array([r.text for r in docs.collect()]))
    passages = [(i, x[a : a + latent.WINDOW]) for i, x in enumerate(index.items) for a in latent.passage_starts(len(x))]
    assert rows == [len(passages)]  # no sample of the corpus turns the space
    weights = np.zeros((len(passages), len(index.idf)))
    for row, (_, x) in zip(weights, passages, strict=True):
        t, k = np.unique(x, return_counts=True)
        row[t] = k * index.idf[t] / np.linalg.norm(k * index.idf[t])
    want, rim = set(), set()
    for d in range(len(begins) - 1):
        for a in latent.starts(begins[d + 1] - begins[d]) if begins[d + 1] > begins[d] else ():
            t, k = np.unique(ids[begins[d] + a : begins[d + 1]][: latent.WINDOW], return_counts=True)
            cos = weights[:, t] @ (k * index.idf[t]) / np.linalg.norm(k * index.idf[t])
            want |= {(int(begins[d] + a), passages[q][0]) for q in np.flatnonzero(cos >= index.cosine + 1e-3)}
            rim |= {(int(begins[d] + a), passages[q][0]) for q in np.flatnonzero(cos >= index.cosine - 1e-3)}
    got = {(int(a), int(i)) for a, i, _ in zip(*index.candidates(ids, begins), strict=True)}
    assert len(want) > 20 and want <= got <= rim
