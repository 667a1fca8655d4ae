"""Old Vietnamese codes, compound words, table functions, NFC, percentiles and errors of whole texts."""

import json
import random
import shutil
import subprocess
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import compounds, legacy, tables
from docloom.functions.text import CHANGEABLE, UNSTABLE, VIETNAMESE, normalized
from docloom.operators import answers, evaluation, quality, retrieval, segments
from docloom.plans import stores  # noqa: F401 (registers its queries)
from docloom.plans.catalog import QUERIES
from docloom.sources import uploads

VI = "Trường đại học là nơi người học được những điều rất quý giá, và mỗi người đều có quyền được học tập. Nghiên cứu khoa học ở Việt Nam đã phát triển mạnh trong những năm gần đây. " * 3


def test_old_codes_come_back(spark):
    assert len(VIETNAMESE) == 134 == len(set(legacy.TO_TCVN3.values())) == len(set(legacy.TO_VNI.values()))
    u = spark.createDataFrame([(1, VI + VIETNAMESE), (2, VI.upper()), (3, "plain text, café"), (4, ""), (5, None)], "doc_id long, text string")
    for code, back in ((legacy.to_tcvn3, legacy.from_tcvn3), (legacy.to_vni, legacy.from_vni)):
        rows = u.filter("doc_id < 3").select("text", back(code(F.col("text"))).alias("b")).collect()
        assert all(unicodedata.normalize("NFC", r.b) == r.text for r in rows)
    encoded = u.filter("doc_id < 2").select(F.lit(11).alias("doc_id"), legacy.to_tcvn3(F.col("text")).alias("text")).union(u.filter("doc_id < 3").select(F.col("doc_id") + 20, legacy.to_vni(F.col("text")))).union(u)
    got = {r.doc_id: r for r in legacy.transcoded(encoded).collect()}
    assert got[11].legacy_encoding == "tcvn3" and got[21].legacy_encoding == got[22].legacy_encoding == "vni"
    assert got[11].norm == got[21].norm == VI + VIETNAMESE and got[22].norm == VI.upper()
    assert got[1].legacy_encoding is None and got[3].norm == "plain text, café" and got[4].norm == got[5].norm == ""
    scores = lambda df: {r.doc_id: r.score for r in quality.assess(df).collect()}
    after = scores(legacy.transcoded(encoded).select("doc_id", F.col("norm").alias("text")))
    assert scores(encoded)[11] < 0.1 and min(after[11], after[21]) > 0.85


@pytest.mark.skipif(not shutil.which("iconv"), reason="needs iconv")
def test_tcvn3_codes_are_those_of_the_standard():
    out = subprocess.run(["iconv", "-f", "UTF-8", "-t", "TCVN5712-1"], input=VIETNAMESE.encode(), capture_output=True)
    if out.returncode == 0:
        assert out.stdout.decode("latin-1") == "".join(legacy.TO_TCVN3[c] for c in VIETNAMESE)


def plain_lexicon(texts, least, score):
    words = [[w for t in x.lower().split() if (w := t.strip(".,"))] for x in texts]
    single, pair = {}, {}
    for ws in words:
        for w in ws:
            single[w] = single.get(w, 0) + 1
        for p in zip(ws, ws[1:], strict=False):
            pair[p] = pair.get(p, 0) + 1
    n = sum(single.values())
    scored = {p: 1000 * c * n // (single[p[0]] * single[p[1]]) for p, c in pair.items() if c >= least}
    return {p: s for p, s in scored.items() if s >= score}


def plain_path(ws, lex):
    """The best of all ways to join neighbours; of equal ones that whose last words stay single."""
    best = [(0, []), *([None] * len(ws))]
    for i in range(1, len(ws) + 1):
        best[i] = (best[i - 1][0], best[i - 1][1] + [ws[i - 1]])
        s = lex.get((ws[i - 2], ws[i - 1]), 0) if i > 1 else 0
        if s and best[i - 2][0] + s > best[i][0]:
            best[i] = (best[i - 2][0] + s, best[i - 2][1] + [f"{ws[i - 2]}_{ws[i - 1]}"])
    return best[-1][1]


def test_compounds(spark):
    rnd = random.Random(4)
    fixed = ["học sinh", "sinh học", "đại học", "cơ sở dữ liệu"]
    texts = [" ".join(rnd.choice(fixed) if rnd.random() < 0.3 else f"w{rnd.randrange(40)}" for _ in range(60)) + "." for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, ""), (98, None)], "doc_id long, norm string")
    want = plain_lexicon(texts, 5, 4000)
    lex = compounds.lexicon(docs, min_count=5, min_score=4000)
    assert {(r["first"], r.second): r.score for r in lex.collect()} == want and ("đại", "học") in want
    asked = ["Học sinh học sinh học?", "w1 cơ sở dữ liệu", "đại học sinh", "không có", "", texts[0]]
    got = {r.query_id: r.words for r in compounds.segmented(spark.createDataFrame(list(enumerate(asked)), "query_id long, norm string"), lex).collect()}
    for i, t in enumerate(asked):
        assert got[i] == plain_path([w for x in t.lower().split() if (w := x.strip(".,?"))], want), t


def test_table_functions(spark):
    tables.register(spark)
    rows = [(1, "Xin chào. Tôi là A. Hai câu!\n“Ba” 5. 6 bốn. Năm"), (2, "x" * 2000), (3, ""), (4, None), (5, "tp\n. 5A. It's \"so\"")]
    docs = spark.createDataFrame(rows, "doc_id long, norm string")
    docs.createOrReplaceTempView("function_docs")
    got = spark.sql("SELECT d.doc_id, s.* FROM function_docs d, LATERAL sentences_of(d.norm) s")
    want = docs.select("doc_id", F.posexplode(segments.sentence_array(F.col("norm"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for size, overlap in ((800, 120), (50, 30), (7, 0)):
        got = spark.sql(f"SELECT d.doc_id, c.char_start, c.char_end, c.content FROM function_docs d, LATERAL chunk_text(d.norm, {size}, {overlap}) c")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, segments.fixed_chunks(docs, size=size, overlap=overlap).collect()))
    assert [r.sentence for r in spark.sql("SELECT * FROM sentences_of('Một. Hai')").collect()] == ["Một. ", "Hai"]


def test_sentences_in_sql_shuffle_no_text(spark):
    """The query joins nothing: only numbers of sentences and their lengths are shuffled."""
    plan = QUERIES["sentences_sql"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert [r.a for r in spark.sql("SELECT sentence_list(t) AS a FROM VALUES ('Một. Hai'), (''), (null) AS v(t)").collect()] == [["Một. ", "Hai"], [], None]


def test_decoded_texts_are_worked_out_once(spark):
    """Grading and decoding a text aren't part of the plan that normalizes it."""
    plan = QUERIES["legacy_transcoded"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "¡-¿" not in plan and "vni" not in plan and "replace(" not in plan.replace("regexp_replace(", "")


def test_tokens_of_old_codes_are_counted(spark):
    """A token counts once, however many signs it holds; line ends part tokens."""
    rows = [("¡a¿ ¿ b x¡", 3, 0), ("ña\nöö¡ñ ø", 1, 3), ("", 0, 0), ("abc", 0, 0), ("¿", 1, 0)]
    t = spark.createDataFrame([r[:1] for r in rows], "t string")
    got = t.select(quality._tokens_with(F.col("t"), "¡-¿").alias("a"), quality._tokens_with(F.col("t"), "ñöøÑÖØ").alias("b")).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_characters_that_nfc_changes_are_known(spark):
    """No character outside the class changes by NFC, alone or after another one; letters of other scripts are outside."""
    second = set()
    for c in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(c))
        if d and not d.startswith("<") and " " in d:
            second.add(int(d.split()[1], 16))
    unstable = {c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)) or c in second or 0x1161 <= c <= 0x1175 or 0x11A8 <= c <= 0x11C2)}
    df = spark.createDataFrame([(c, chr(c)) for c in sorted(unstable)], "c int, text string")
    assert df.filter(~(F.col("text").rlike(UNSTABLE) & F.col("text").rlike(CHANGEABLE))).count() == 0
    calm = spark.createDataFrame([("Привет, мир",), ("中文文字",), ("Ελληνικά",), ("مرحبا",)], "text string")
    assert calm.filter(F.col("text").rlike(CHANGEABLE)).count() == 0
    odd = spark.createDataFrame([(1, "é"), (2, "한"), (3, "Å"), (4, "ạ̈")], "doc_id long, text string")
    assert all(r.norm == unicodedata.normalize("NFC", r.text) for r in normalized(odd).collect())


def test_percentiles_with_far_outliers(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SORTED", 50)
    rnd = random.Random(6)
    groups = {"tail": [rnd.random() * 100 for _ in range(3000)] + [1e9], "one": [5.0] * 400, "wide": [10.0 ** rnd.randint(-9, 9) for _ in range(900)], "few": [1.0, 2.0], None: [float(i) for i in range(301)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("few", None)], "g string, v double")
    for p in (0.5, 0.95):
        for r in evaluation.exact_percentile(df, "g", "v", p).collect():
            vs = sorted(groups[r.g])
            at = p * (len(vs) - 1)
            low, high = vs[int(at)], vs[min(len(vs) - 1, int(at) + (at > int(at)))]
            assert r.n == len(vs) and r.percentile == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_errors_of_whole_texts(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rnd = random.Random(8)
    pairs = [("", ""), ("abc", ""), ("", "abc"), (None, "x"), ("same", "same"), ("aab", "ab"), ("x" * 300 + "b" * 300, "a" + "x" * 300 + "b" * 299)]
    pairs += [("".join(rnd.choice("abc ạ") for _ in range(rnd.randint(0, 90))), "".join(rnd.choice("abc ạ") for _ in range(rnd.randint(0, 90)))) for _ in range(60)]
    got = evaluation.whole_char_errors(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k long, a string, b string"), "a", "b", "k").collect()
    assert all(r.errors == distance(pairs[r.k][0] or "", pairs[r.k][1] or "") and r.chars == len(pairs[r.k][0] or "") for r in got)


def test_uploads_of_a_full_notebook(spark):
    rows = [(i, "n", f"a{i}.txt", 0 if i % 7 == 0 else 9) for i in range(120)] + [(500, "m", "x.exe", 9), (501, "m", "x.pdf", 9)]
    got = {r.upload_id: r.error_code for r in uploads.validated(spark.createDataFrame(rows, "upload_id long, notebook_id string, name string, bytes long"), most=30).collect()}
    good = [i for i in range(120) if i % 7]
    assert got == {i: "EMPTY" if i % 7 == 0 else None if i in good[:30] else "TOO_MANY" for i in range(120)} | {500: "EXTENSION", 501: None}


def test_best_threshold_and_reply_events(spark):
    sweep = retrieval.threshold_sweep(spark.createDataFrame([(0.9, True), (0.5, True), (0.4, False)], "score double, positive boolean"), 10, 90, 10)
    assert evaluation.best_threshold(sweep).first().cents == 50
    rows = [(1, "m1", "privacy", "q", "grounded", 0.9, 0.35, 5, [(1, 7), (2, 8)]), (2, "m2", "privacy", "q", "no_answer", 0.2, 0.35, 6, []), (3, "m3", "open", "q", "external", 0.2, 0.35, 7, [(1, 7)])]
    df = spark.createDataFrame(rows, "k long, message_id string, mode string, model string, answer_kind string, top_score double, threshold double, latency_ms int, citations array<struct<marker:int,chunk_id:int>>")
    heard = {}
    for r in answers.reply_events(df, "k").orderBy("k", "no").collect():
        heard.setdefault(r.k, []).append(json.loads(r.event))
    kinds = lambda k: [e["type"] for e in heard[k]]
    assert kinds(1) == ["meta", *["status"] * 4, "citation", "citation", "done"] and heard[1][5] == {"type": "citation", "marker": 1, "chunk_id": 7}
    assert kinds(2) == ["meta", *["status"] * 3, "no_answer", "done"] and heard[2][4] == {"type": "no_answer", "top_score": 0.2, "threshold": 0.35}
    assert kinds(3) == ["meta", *["status"] * 4, "done"] and heard[3][-1] == {"type": "done", "message_id": "m3", "answer_kind": "external", "latency_ms": 7, "model_used": "q"}


def test_readers_by_kind(spark, tmp_path):
    from docloom.sources import registry

    good = json.dumps([{"page": 1, "text": "một"}, {"page": 2, "text": None, "bbox": {"page": 2, "x0": 1.5}}, {"page": 2, "text": "hai"}])
    for name, raw in {"a.TXT": "xin chào".encode(), "b.md": b" \n", "c.json": good.encode(), "d.json": b"{not json", "e.json": b"[]", "f.bin": b"\x00\xff", "noext": b"x"}.items():
        (tmp_path / name).write_bytes(raw)
    pasted = registry.pasted(spark.createDataFrame([(1, "dán"), (2, None)], "source_id long, text string"))
    got = {r.path.rpartition("/")[2]: r for r in registry.documents(registry.folder(spark, str(tmp_path)).unionByName(pasted)).collect()}
    assert len(got) == 9 and got["a.TXT"].norm == "xin chào" and got["a.TXT"].error_code is None and got["a.TXT"].kind == "txt"
    assert got["c.json"].norm == "một\n\nhai" and got["c.json"].blocks[1].bbox.x0 == 1.5 and got["paste:1"].norm == "dán"
    codes = {k: got[k].error_code for k in ("b.md", "d.json", "e.json", "f.bin", "noext", "paste:2")}
    assert codes == {"b.md": "TEXT_EMPTY", "d.json": "BLOCKS_INVALID", "e.json": "TEXT_EMPTY", "f.bin": "KIND_UNSUPPORTED", "noext": "KIND_UNSUPPORTED", "paste:2": "TEXT_EMPTY"}
    registry.reader("bin")(lambda files: registry._failed(files, "OWN"))
    assert registry.documents(registry.folder(spark, str(tmp_path)).filter("kind = 'bin'")).first().error_code == "OWN"
    del registry.READERS["bin"]
