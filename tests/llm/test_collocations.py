import random
import re
from collections import Counter

from docloom.llm import collocations


def plain(rows, least=100, longest=5, top=2000, covered=100):
    """(lang, rank, phrase, a, l, r, n, score); rows: (id, text, lang)."""
    count, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    count[lang or "und", tuple(ws[i : i + k])] += 1
    out = []
    for lang in total:
        mine = {p: a for (g, p), a in count.items() if g == lang and a >= least and len(p) > 1}
        most = Counter()
        for p, a in mine.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        found = []
        for p, a in mine.items():
            if p in most and 100 * most[p] >= covered * a:
                continue
            score, cut = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[lang, p[:cut]], count[lang, p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(seed=3, n=500):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", " x", "a-b", "ZZ"]
    fixed = ["New york city hall", "in the long run", "the long run", "x y z u v w", "tick tick tick tick tick"]
    rows = []
    for i in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        rows.append((i, "".join(p + rnd.choice([" ", "  ", "\t", ". ", ",", "\n"]) if rnd.random() < 0.4 else p + " " for p in parts), rnd.choice(["en", "de", None])))
    return rows + [(n, None, "en"), (n + 1, "", None), (n + 2, " .. ,", "de"), rows[0], rows[0]]


def test_matches_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "doc_id long, text string, lang string, words string, n string, w1 string").repartition(4)
    for options in ({"least": 20}, {"least": 3, "covered": 80}, {"least": 5, "longest": 3, "top": 7}, {"least": 10_000}):
        names = {"least": "min_count", "longest": "longest", "top": "top", "covered": "covered"}
        got = sorted(tuple(r) for r in collocations.collocations(docs, **{names[k]: v for k, v in options.items()}).collect())
        assert got == plain(rows, **options)
        assert got or options["least"] == 10_000


def test_bits_change_nothing_but_what_moves(spark):
    rows = made(4, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = plain(rows, 10)
    for bits in (64, 1 << 20):
        assert sorted(tuple(r) for r in collocations.collocations(docs, min_count=10, bits=bits).collect()) == want


def test_cells_of_the_order(spark, monkeypatch):
    """Many phrases of a language are put in order in cells, then what these leave."""
    monkeypatch.setattr(collocations, "CELL", 30)
    rows = made(5, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in collocations.collocations(docs, min_count=2, top=15).collect()) == plain(rows, 2, top=15)


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", 1, ["a"], "a", 4 * 10**12), ("en", 1, ["b"], "b", 3 * 10**12), ("en", 2, ["a", "b"], "a b", 10**12)], "lang string, k int, words array<string>, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    row = collocations._scored(phrases, totals).first()
    assert row.score == 1000 * 10**12 * 9 * 10**15 // (12 * 10**24) and (row.l, row.r) == (4 * 10**12, 3 * 10**12)


def test_empty_table(spark, empty):
    assert collocations.collocations(empty).count() == 0
