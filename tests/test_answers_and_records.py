"""Operators around answers, evaluation, uploads and owners, on small rows and against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, evaluation, retrieval, segments, service, tenancy
from docloom.sources import extract, uploads
from docloom.streaming import windows


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_errors(spark):
    rnd = random.Random(3)
    texts = lambda: " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30)))
    rows = [(texts(), texts()) for _ in range(200)] + [(None, "a b"), ("", ""), ("a " * 3000, "b a " * 2000)]
    got = spark.createDataFrame(rows, "a string, b string").select(evaluation.word_errors(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got][:201] == [plain_distance((a or "").split(), (b or "").split()) for a, b in rows[:201]]
    assert got[-1][0] == plain_distance("x" * 3000, "yx" * 2000)


def test_char_errors_cover_whole_texts(spark):
    df = spark.createDataFrame([(1, "e" * 450, "e" * 400 + "o" * 50), (1, "", "")], "k int, a string, b string")
    assert [tuple(r) for r in evaluation.char_errors(df, "a", "b", "k").collect()] == [(1, 50, 450)]


def test_exact_percentile(spark):
    rnd = random.Random(4)
    rows = [("a", rnd.random()) for _ in range(501)] + [("b", 7.0)] * 40 + [(None, float(k)) for k in range(10)] + [("c", None)]
    got = {r[0]: (r[1], r[3]) for r in evaluation.exact_percentile(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.95).collect()}
    values = sorted(v for g, v in rows if g == "a")
    assert got["a"] == (501, values[475]) and got["b"] == (40, 7.0) and got[None][0] == 10 and abs(got[None][1] - 8.55) < 1e-9 and "c" not in got
    assert evaluation.exact_percentile(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0


def test_cover_density(spark):
    """Covers of three parts against a plain search over all stretches."""
    rnd = random.Random(5)
    docs = [(d, " ".join(rnd.choice("abcxyz") for _ in range(rnd.randint(3, 40)))) for d in range(60)]
    parts = [(1, 0, "a b"), (1, 1, "c"), (1, 2, "x")]
    found = retrieval.cover_density(retrieval.phrase_terms(spark.createDataFrame(parts, "query_id long, part int, text string")), retrieval.postings(spark.createDataFrame(docs, "doc_id long, norm string")))
    want = {}
    for d, t in docs:
        w = t.split()
        at = [[i for i in range(len(w)) if w[i : i + len(p)] == p] for p in (["a", "b"], ["c"], ["x"])]
        if not all(at):
            continue
        covers = {(min(i, j, k), max(i + 1, j, k)) for i in at[0] for j in at[1] for k in at[2]}
        least = {(b, e) for b, e in covers if not any((x, y) != (b, e) and x >= b and y <= e for x, y in covers)}
        want[d] = round(sum(0.1 / (1 + max(0, e - b + 1 - 4)) for b, e in least), 6)
    got = {r.doc_id: r.score for r in found.collect()}
    assert got == want


def test_rerank_and_gate(spark):
    c = spark.createDataFrame([(1, 10, ["a", "b"], ["a", "b", "c"]), (1, 11, ["a", "b"], ["a"]), (2, 12, ["z"], ["a"]), (2, 13, ["z"], None)], "query_id long, doc_id long, asked array<string>, held array<string>")
    ranked = retrieval.rerank(c, retrieval.lexical_logit(F.col("asked"), F.col("held")), "doc_id", 1)
    assert [(r.query_id, r.doc_id, r.score) for r in ranked.orderBy("query_id").collect()] == [(1, 10, 0.982014), (2, 12, 0.017986)]
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    assert {r.query_id: r.answer_kind for r in retrieval.gate(ranked, asked=asked).collect()} == {1: "grounded", 2: "no_answer", 3: "no_answer"}


def test_document_chunks_carry_pages_and_boxes(spark):
    """A chunk's page is that of its first character, its boxes those of the blocks it overlaps."""
    rnd = random.Random(6)
    blocks = []
    for d in range(4):
        for b in range(30):
            text = "# Part" if b % 10 == 0 else " ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(12)) + "."
            blocks.append((d, b // 7 + 1, b, text, (b // 7 + 1, 1.0, float(b), 2.0, float(b + 1))))
    kind = "doc_id long, page int, block_no int, text string, bbox struct<page:int,x0:double,y0:double,x1:double,y1:double>"
    docs = extract.assemble(spark.createDataFrame(blocks, kind))
    whole = {r.doc_id: r for r in docs.collect()}
    made = segments.chunk_document(docs, max_tokens=60, overlap=0.3).collect()
    assert len(made) > 40
    for c in made:
        d = whole[c.doc_id]
        assert d.full_text[c.char_start : c.char_end] == c.content and c.heading_path == "Part"
        assert c.page_no == next(p.page for p in d.pages if p.start <= c.char_start < p.end)
        assert c.bbox == [b.bbox for b in d.blocks if b.char_start < c.char_end and b.char_end > c.char_start]


def test_token_counter_is_injected(spark):
    df = spark.createDataFrame([(1, "One two. Three four. Five six. Seven.")], "doc_id long, norm string")
    words = lambda t: F.regexp_count(t, F.lit("[^ ]+"))
    made = segments.chunks(df, max_tokens=4, overlap=0.0, tokens=words).collect()
    assert [(c.content, c.token_count) for c in made] == [("One two. Three four.", 4), ("Five six. Seven.", 3)]


def test_prompt_side(spark):
    rows = spark.createDataFrame([(1, 1, "B", 2, "tail «|CHUNK|» x"), (1, 0, "A", 1, None)], "q int, o int, t string, p int, c string")
    assert answers.context_blocks(rows, ["q"], "o", "t", "p", "c").first().context == "[1] A (p. 1)\n«|CHUNK|»«|CHUNK|»\n\n[2] B (p. 2)\n«|CHUNK|»tail  x«|CHUNK|»"
    q = spark.createDataFrame([("Please rename this notebook",), ("What is it",), ("hello",), ("cái này là của ai và có được không",), ("",)], "q string")
    assert [r[0] for r in q.select(answers.intent(F.col("q"))).collect()] == ["notebook_op", "doc_qa", "chat", "chat", "chat"]
    assert [r[0] for r in q.select(answers.answer_language(F.col("q"))).collect()] == ["en", "en", "en", "vi", "en"]
    c = spark.createDataFrame([("One [1]\n\nTwo",), ("",), (None,)], "a string").select(answers.citation_coverage(F.col("a")))
    assert [r[0] for r in c.collect()] == [0.5, None, None]


def test_uploads(spark):
    assert uploads.allowed_extensions(".PDF, txt,pdf ,, md") == ["pdf", "txt", "md"]
    rows = [(1, 1, "a.PDF", 5), (2, 1, "b.exe", 5), (3, 1, "c.png", 99), (4, 1, "d.md", 0), (5, 1, "e.txt", 5), (6, 1, "f.txt", 5), (7, 2, "noext", 5)]
    got = uploads.validated(spark.createDataFrame(rows, "upload_id int, notebook_id int, name string, bytes long"), most=2, max_image=50).orderBy("upload_id").collect()
    assert [r.error_code for r in got] == [None, "EXTENSION", "TOO_LARGE", "EMPTY", None, "TOO_MANY", "EXTENSION"]
    pages = spark.createDataFrame([("x" * 120, 0.0), ("short", 0.9), ("short text here", 0.1), (None, None)], "t string, s double")
    methods = pages.select(uploads.page_method(F.char_length(F.coalesce("t", F.lit(""))), F.col("s")), uploads.page_warning(F.col("t"))).collect()
    assert [tuple(r) for r in methods] == [("text", None), ("fast", "NEAR_EMPTY"), ("model", None), ("model", "PAGE_FAILED")]
    meta = uploads.run_metadata(pages, {"tau": "0.35"}, 7, {"embedder": "rev1"}).first()
    assert (meta.rows, meta.seed, meta.config, meta.models) == (4, 7, {"tau": "0.35"}, {"embedder": "rev1"})


def test_owners_and_stores(spark, tmp_path):
    notebooks = spark.createDataFrame([(1, 10), (2, 11)], "notebook_id int, user_id int")
    asked = spark.createDataFrame([(1, 10), (1, 11), (3, 10)], "notebook_id int, user_id int")
    assert [tuple(r) for r in tenancy.visible(asked, notebooks).collect()] == [(1, 10)]
    links = spark.createDataFrame([("t", 1, None), ("u", 2, "2024")], "token string, notebook_id int, revoked_at string")
    assert [r.notebook_id for r in tenancy.opened(spark.createDataFrame([("t",), ("u",), ("v",)], "token string"), links).collect()] == [1]
    old = spark.createDataFrame([(1, 0, 4, "abcd"), (1, 4, 8, "efgh")], "doc_id int, char_start int, char_end int, content string")
    new = spark.createDataFrame([(1, 0, 4, "abcd"), (1, 4, 8, "efgX"), (2, 0, 4, "abcd")], old.schema)
    assert sorted(r.content for r in tenancy.changed_chunks(new, old).collect()) == ["abcd", "efgX"]
    path = str(tmp_path / "chunks")
    tenancy.store_chunks(old, path)
    tenancy.store_chunks(new, path)
    tenancy.store_chunks(new, path)
    assert spark.read.parquet(path).count() == 3
    cache = spark.createDataFrame([(1, 2), (2, 0)], "cache_id int, hit_count long")
    assert {r.cache_id: r.hit_count for r in service.counted_hits(cache, spark.createDataFrame([(1,), (1,)], "cache_id int")).collect()} == {1: 4, 2: 0}


def test_transitions(spark):
    rows = [(1, 1, "queued"), (1, 2, "parsing"), (1, 3, "ready"), (2, 1, "parsing")]
    df = spark.createDataFrame([(s, st, a, a) for s, a, st in rows], "source_id int, status string, at int, event_id int")
    got = {(r.source_id, r.at): r.valid for r in service.transitions(df, windows.TRANSITIONS).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False}


@pytest.mark.parametrize("passed", [True, False])
def test_pass_rates(spark, passed):
    rows = [(0.9, 0.9, 0.9, 0.9), (0.9, 0.9, 0.9, 0.9 if passed else 0.1)]
    got = evaluation.pass_rates(spark.createDataFrame(rows, "faithfulness double, relevancy double, recall double, precision double")).first()
    assert got.n == 2 and got.pass_rate == (1.0 if passed else 0.5)
