import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import line_crf as crf


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        x = rng.standard_normal((n, crf.N_FEATURES))
        m = crf.LineModel(np.zeros(crf.N_FEATURES), np.ones(crf.N_FEATURES), rng.standard_normal(crf.N_FEATURES) * 0.3, rng.standard_normal((2, 2)), (0.0, 1.0))
        s = x @ m.weights
        total, good = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            p = np.exp(sum(s[i] for i in range(n) if y[i]) + sum(m.moves[a][b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            good += p * np.array(y)
        assert np.allclose(m.marginals(x), good / total)
        marginals, _ = crf._expect(s[None], np.ones((1, n), bool), m.moves)
        assert np.allclose(marginals[0], good / total)


def case(spark):
    rnd = random.Random(4)
    prose = lambda: " ".join(rnd.choice(["alder", "birch", "cedar", "elm", "fir", "oak"]) + rnd.choice("abcdefgh") for _ in range(rnd.randint(8, 20))) + "."
    rows, labels = [], []
    for d in range(300):
        lines = [prose() for _ in range(rnd.randint(2, 8))]
        label = int(d % 3 > 0)
        if not label:
            for k in range(1, len(lines)):
                lines[k] = rnd.choice([lines[k].upper().replace(" ", "!! "), "###" + lines[k].replace(" ", "$$$ "), " ".join(["same"] * 30)])
        rows.append((d, "\n".join(lines), "x"))
        labels.append((d, label, 0))
    rows += [(800, None, "x"), (801, "", "x"), (802, " \n", "x"), (None, prose(), "x"), (803, prose() * 5000, "x"), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = case(spark)
    model = crf.fit(docs, labels)
    out = crf.with_quality(docs.select("doc_id", "text"), model).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([(r.score >= 0.7) == (truth[r.doc_id] == 1) for r in held]) >= 0.97
    assert len(out) == 306 and all(0 <= r.score <= 1 for r in out)
    kept = crf.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.7 for r in out)
    assert crf.keep_good(docs.limit(0), model).count() == 0
    assert {r.score for r in crf.with_quality(docs.select("doc_id", "text").limit(4), crf.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_log_normaliser_matches_enumeration():
    rng = np.random.default_rng(3)
    for n in range(1, 7):
        s, moves = rng.standard_normal(n) * 3, rng.standard_normal((2, 2))
        want = np.log(sum(np.exp(sum(s[i] for i in range(n) if y[i]) + sum(moves[a][b] for a, b in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=n)))
        on = np.arange(n + 3) < n
        assert np.isclose(crf._chain(np.where(on, np.append(s, [0] * 3), 0)[None], on[None], moves)[2], want)


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    """Junk of a kind that only bad texts beyond the 1,200 with the least hashes hold is known; few or many labels, one model."""
    rnd = random.Random(9)
    ids = [r.id for r in spark.range(6000).orderBy(F.xxhash64("id"), "id").collect()]
    learnt = [i for i in ids if zlib.crc32(str(i).encode()) % 4 != 2]
    bad, late = set(learnt[:3000:2]), set(learnt[2400:3000:2])
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(8)) + "."
    junk = lambda i: "12345 67890 11223 44556 77889 90123 32123 55555." if i in late else "## $$ || << %% ## $$ ||"
    texts = {i: "\n".join([prose(), junk(i) if i in bad else prose(), prose()]) for i in ids}
    docs = spark.createDataFrame([*texts.items(), (9001, junk(min(late))), (9002, prose())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in learnt], "doc_id long, quality int")
    model = crf.fit(docs, labels)
    assert model.score(junk(min(late))) < 0.5 and model.score(prose()) > 0.7
    x = np.concatenate([crf.line_features(texts[i])[0] for i in learnt]).astype(float)
    assert np.allclose(model.mean[:-1], x.mean(axis=0)[:-1]) and np.allclose(model.scale[:-1], x.std(axis=0)[:-1] + 1e-3, atol=1e-6)
    monkeypatch.setattr(crf, "MOST_BROADCAST", 0)
    monkeypatch.setattr(crf, "BLOCK", 300)
    again = crf.fit(docs, labels)
    assert np.allclose(again.mean, model.mean) and np.allclose(again.weights, model.weights, atol=0.02) and np.allclose(again.curve, model.curve, atol=0.1)
