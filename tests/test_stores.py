"""Cells of vectors, the inverted index, interval joins and the chunk store against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import inverted, nearest, retrieval, segments, tenancy
from docloom.operators.chunk_store import ChunkStore
from docloom.operators.intervals import as_of, overlaps
from docloom.plans import hybrid  # noqa: F401 (registers its queries)
from docloom.plans.catalog import QUERIES
from docloom.sources.shared import fresh_path


def clustered(spark, n=3000, cells=40, dim=16, spread=0.05):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(cells, dim))
    at = rng.integers(0, cells, n)
    points = centres[at] / np.linalg.norm(centres[at], axis=1, keepdims=True) + rng.normal(size=(n, dim)) * spread
    points[:600] = points[0]  # a fifth of all vectors are equal
    rows = [(i, [float(x) for x in p], int(c), i % 90) for i, (p, c) in enumerate(zip(points, at, strict=True))]
    rows += [(n, [0.0] * dim, 0, 0), (n + 1, None, 0, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, scope int").repartition(5)


def test_cells_give_what_a_full_scan_gives(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 256)  # cells are cut into chunks
    v = clustered(spark)
    index = nearest.build(v, fresh_path(spark, "t"))
    assert index.rows.sum() == 3000 and index.vectors(spark).count() == 3000
    asked = v.filter("vec_id % 150 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("scope").alias("q_scope"))
    known = v.filter("vec_id < 3000")
    scope, self_ = [("scope", "q_scope")], [("vec_id", "query_id")]
    for n, same, other in ((10, [], []), (10, [], self_), (25, scope, []), (50, scope, self_)):
        index.reads.clear()
        got = sorted(map(tuple, nearest.search(index, asked, n, same, other).select("query_id", "vec_id", "score", "rnk").collect()))
        rule = F.lit(True)
        for mine, theirs in same:
            rule = rule & (F.col(mine) == F.col(theirs))
        for mine, theirs in other:
            rule = rule & (F.col(mine) != F.col(theirs))
        assert got == sorted(map(tuple, retrieval.vector_search(asked, known, n, rule).collect()))
        share = sum(r["pairs"] for r in index.reads) / (3000 * asked.count())
        if n == 10:
            assert share < 0.5, index.reads  # of all pairs of a question and a vector


def test_scan_gives_what_rows_give(spark, monkeypatch):
    """Groups of matrices give the rows of vector_search, for odd vectors, scopes and many equal ones too; no pair is a row."""
    for name, value in (("SCAN_VALUES", 16 * 700), ("SCAN_QUERIES", 9), ("SCAN_LEAST", 300), ("EXACT", 1000)):
        monkeypatch.setattr(nearest, name, value)
    v = clustered(spark)
    asked = v.filter("vec_id % 150 = 7 or vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("scope").alias("q_scope"))
    odd = spark.createDataFrame([(4000, [1.0, 2.0], 0, 7), (4001, [float("nan")] * 16, 0, 7), (4002, [None] + [1.0] * 15, 0, 7), (4003, [2.0] * 16, 0, None), (4004, [0.0] * 16, 0, 7)], v.schema)
    more = asked.unionByName(odd.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("scope").alias("q_scope")))
    scope, self_ = [("scope", "q_scope")], [("vec_id", "query_id")]
    for n, q, t, same, other in ((10, asked, v.filter("vec_id < 3000"), [], []), (50, asked, v.unionByName(odd), scope, self_), (25, more, v.unionByName(odd), [], self_), (3, more, odd, [], []), (3, asked.limit(0), v, [], [])):
        rule = F.lit(True)
        for mine, theirs in same:
            rule = rule & (F.col(mine) == F.col(theirs))
        for mine, theirs in other:
            rule = rule & (F.col(mine) != F.col(theirs))
        text = lambda df: sorted(map(str, df.select("query_id", "vec_id", "score", "rnk").collect()))
        got = nearest.scan(q, t, n, same, other)
        assert text(got) == text(retrieval.vector_search(q, t, n, rule))
    for name in ("vector_topk", "refusal_rates", "model_bakeoff"):
        assert "NestedLoop" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_closest_numbers(spark, monkeypatch):
    """Of numbers with gaps and repeats the nearest, as a plain sort gives them; questions meet their neighbours only."""
    monkeypatch.setattr(nearest, "CLOSE", 40)
    rnd = random.Random(3)
    ids = [rnd.randrange(-300, 300) for _ in range(300)] + [10**6 + 7 * i for i in range(60)] + [10**12 + i for i in range(5)] + [5] * 70
    table = spark.createDataFrame([(i,) for i in [*ids, None]], "vec_id long")
    for n in (1, 12, 500):
        asked = spark.createDataFrame([(q,) for q in (5, -300, 0, 299, 10**5, 10**6 + 70, 10**12 + 2, 10**13, None)], "query_id long")
        want = []
        for (q,) in asked.filter("query_id is not null").collect():
            near = sorted((abs(x - q), x) for x in ids if x != q)[:n]
            want += [(q, x, -float(d), k + 1) for k, (d, x) in enumerate(near)]
        assert sorted(map(tuple, nearest.closest(asked, table, n).collect())) == sorted(want)
    assert nearest.closest(asked, table.limit(0), 3).count() == 0 == nearest.closest(asked.limit(0), table, 3).count()
    for name in ("rrf_fusion", "ablation"):
        assert "NestedLoop" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_thin_scopes_probe_on(spark):
    """A scope with fewer vectors than asked for gives all of them, after every cell was probed."""
    v = clustered(spark, n=1000)
    index = nearest.build(v, fresh_path(spark, "t"), cells=20)
    asked = v.filter("vec_id in (700, 801)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.lit(3).alias("q_scope"))
    got = nearest.search(index, asked, 50, [("scope", "q_scope")]).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {v.filter("scope = 3 and vec_id < 1000").count()}
    again = nearest.opened(spark, index.path)
    assert (again.rows == index.rows).all() and np.allclose(again.centres, index.centres)


def test_cells_of_empty_tables(spark):
    v = clustered(spark, n=700)
    index = nearest.build(v.limit(0), fresh_path(spark, "t"))
    asked = v.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    assert nearest.search(index, asked, 5).count() == 0
    assert nearest.search(nearest.build(v, fresh_path(spark, "t")), asked.limit(0), 5).count() == 0


def words(spark, n=300):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["chữ", "nghĩa"]
    rows = [(i * 37, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30)))) for i in range(n)] + [(5, ""), (6, "w1 " * 500), (20_000, "w1")]
    return spark.createDataFrame(rows, "doc_id long, norm string").repartition(4)


def test_index_holds_all_postings(spark, monkeypatch):
    docs, path = words(spark), fresh_path(spark, "t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    inverted.build(docs, path, buckets=8)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = inverted.Stored(spark, path)
    every = retrieval.postings(docs).select("doc_id", "pos", "lexeme")
    asked = every.select("lexeme").distinct()
    assert sorted(map(tuple, index.postings(asked).collect())) == sorted(map(tuple, every.collect()))
    counts = every.groupBy("lexeme").agg(F.countDistinct("doc_id"), F.count("*"))
    assert sorted(map(tuple, index.counts().collect())) == sorted(map(tuple, counts.collect()))
    assert index.blocks().filter("lexeme = 'w1'").count() > 5  # a common word is cut into blocks of documents
    parts = [(1, 0, "w1 w1 w1"), (1, 1, "w1"), (2, 0, "w3 w4"), (2, 1, "chu"), (3, 0, "w5"), (3, 1, "never"), (4, 0, "nghia w2")]
    terms = retrieval.phrase_terms(spark.createDataFrame(parts, "query_id long, part int, text string"))
    full = retrieval.phrase_search(terms, every).select("query_id", "doc_id")
    want = retrieval.occurrences(terms, every).join(full, ["query_id", "doc_id"]).select("query_id", "part", "length", "doc_id", "at")
    assert sorted(map(tuple, index.occurrences(terms).collect())) == sorted(map(tuple, want.collect())) and want.count() > 500
    monkeypatch.setattr(inverted, "AT_ONCE", 3)
    assert index.occurrences(terms).count() == want.count()
    with pytest.raises(ValueError, match="no index"):
        inverted.Stored(spark, path + "-none")


def test_search_reads_the_asked_buckets_only(spark):
    docs, path = words(spark), fresh_path(spark, "t")
    inverted.build(docs, path)
    asked = spark.createDataFrame([("chu",), ("w7",), ("never",)], "lexeme string")
    got = inverted.Stored(spark, path).postings(asked)
    want = retrieval.postings(docs).filter("lexeme in ('chu', 'w7')").select("doc_id", "pos", "lexeme")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[.*?bucket#\d+ (?:IN|INSET) \(?([\d, ]+)", plan)
    assert pruned and len(pruned.group(1).split(",")) <= 3, plan


def test_intervals_against_plain_versions(spark):
    rnd = random.Random(7)
    span = lambda: (a := rnd.randrange(3000), a + rnd.choice([0, 1, 50, 900]))
    left = [(k, i, *span()) for k in range(4) for i in range(40)]
    right = [(k, i, *span()) for k in range(1, 5) for i in range(40)]
    a = spark.createDataFrame(left, "doc long, i int, s int, e int")
    b = spark.createDataFrame(right, "doc long, j int, bs int, be int")
    want = sorted((k, i, j) for k, i, s, e in left for k2, j, bs, be in right if k == k2 and s < e and bs < be and bs < e and be > s)
    for size in (7, 100, 10_000):
        got = overlaps(a, b, "doc", ("s", "e"), ("bs", "be"), size)
        assert sorted((r.doc, r.i, r.j) for r in got.collect()) == want
    marks = b.select("doc", F.col("bs").alias("m"), F.col("j").alias("page"))
    for size in (7, 100, 10_000):
        got = as_of(a.select("doc", "i", "s"), marks, "doc", "s", "m", "page", size)
        assert got.columns == ["doc", "i", "s", "page"]
        for r in got.collect():
            before = [(m, j) for k, j, m, _ in right if k == r.doc and m <= r.s]
            assert r.page == (max(before)[1] if before else None)


def test_chunk_document_matches_a_plain_search(spark):
    from docloom.sources import extract

    rnd = random.Random(9)
    blocks = [(d, p, i, " ".join(f"Word{rnd.randrange(99)}." for _ in range(rnd.randint(0, 60))), None if rnd.random() < 0.1 else (p, 1.0, float(i), 2.0, float(i + 1))) for d in range(5) for p in range(1, 6) for i in range(rnd.randint(1, 9))]
    docs = extract.assemble(spark.createDataFrame(blocks, "doc_id long, page int, block_no int, text string, bbox struct<page:int,x0:double,y0:double,x1:double,y1:double>"))
    held = {r.doc_id: r for r in docs.collect()}
    out = segments.chunk_document(docs, max_tokens=60).collect()
    assert {r.doc_id for r in out} == set(held)
    for r in out:
        d = held[r.doc_id]
        assert d.full_text[r.char_start : r.char_end] == r.content
        assert r.page_no == next(p.page for p in d.pages if p.start <= r.char_start < p.end)
        assert r.bbox == [b.bbox for b in d.blocks if b.char_start < r.char_end and b.char_end > r.char_start and b.bbox is not None]
    for d in held:
        assert sorted(r.chunk_index for r in out if r.doc_id == d) == list(range(sum(r.doc_id == d for r in out)))


def same_chunks(store, docs):
    cols = ["doc_id", "chunk_index", "char_start", "char_end", "token_count", "heading_path", "content"]
    assert sorted(map(tuple, store.chunks().select(cols).collect()), key=str) == sorted(map(tuple, segments.chunks(docs).select(cols).collect()), key=str)


def test_store_keeps_other_sources(spark):
    text = lambda i: f"# A {i}\n" + f"Một câu {i}. " * 40 + "\n## B\nshared text\n# C\n" + f"End {i}."
    docs = spark.createDataFrame([(i, text(i)) for i in range(60)] + [(98, ""), (99, None)], "doc_id long, norm string")
    store = ChunkStore(spark, fresh_path(spark, "t"))
    assert store.chunks().count() == 0
    assert store.put(docs) == {"sources": 62, "sections": 60 * 3}
    same_chunks(store, docs)
    assert store.put(docs) == {"sources": 0, "sections": 0} and store.version() == 1
    one = spark.createDataFrame([(5, text(5).replace("End", "Changed"))], "doc_id long, norm string")
    assert store.put(one) == {"sources": 1, "sections": 1}  # one section of one source is chunked anew
    now = docs.filter("doc_id <> 5").unionByName(one)
    same_chunks(store, now)
    store.remove(docs.filter("doc_id in (7, 98)").select("doc_id"))
    same_chunks(store, now.filter("doc_id <> 7"))
    again = ChunkStore(spark, store.path)
    again.put(docs.filter("doc_id = 7"))
    same_chunks(again, now)


def test_plain_store_keeps_the_other_sources_of_a_bucket(spark, tmp_path):
    path = str(tmp_path / "chunks")
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("char_start"), F.lit("old").alias("content"))
    tenancy.store_chunks(many, path)
    tenancy.store_chunks(many.filter("doc_id = 5").withColumn("content", F.lit("new")), path)
    got = {r.doc_id: r.content for r in spark.read.parquet(path).collect()}
    assert got == {i: "new" if i == 5 else "old" for i in range(1000)}
