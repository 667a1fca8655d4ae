from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docloom.operators import retrieval, service


def test_fusion_counts_an_item_once_per_branch(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 5)], "query_id long, vec_id long, rnk int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, vec_id long, rnk int")
    got = {r.vec_id: (r.rnk, r.score) for r in retrieval.fuse([a, b], "vec_id").collect()}
    assert got[11] == (1, round(1 / 62 + 1 / 61, 9)) and got[10] == (2, round(1 / 61, 9)) and got[12][0] == 3


def test_scope_applies_before_ranking(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10], i % 2) for i in range(10)], "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(0, [1.0, 0.0], 1)], "query_id long, qvec array<float>, q_label int")
    rows = retrieval.vector_search(q, v, 3, F.col("label") == F.col("q_label"))
    assert [r.vec_id for r in rows.orderBy("rnk").collect()] == [1, 3, 5]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("label")  # the window stands above the join that filters


def test_phrases_need_neighbours(spark):
    docs = spark.createDataFrame([(1, "Cơ sở dữ liệu quốc gia"), (2, "cơ sở vật chất và dữ liệu"), (3, "CO SO DU LIEU, co so du lieu")], "doc_id long, norm string")
    parts = spark.createDataFrame([(7, 0, "co so du lieu")], "query_id long, part int, text string")
    got = {r.doc_id: r.score for r in retrieval.phrase_search(retrieval.phrase_terms(parts), retrieval.postings(docs)).collect()}
    assert got == {1: 0.25, 3: 0.5}


def test_gate_and_sweep(spark):
    s = spark.createDataFrame([(1, 0.2, False), (1, 0.4, True), (2, 0.3, True)], "query_id long, score double, positive boolean")
    assert {r.query_id: r.answer_kind for r in retrieval.gate(s).collect()} == {1: "grounded", 2: "no_answer"}
    best = retrieval.threshold_sweep(s, 10, 70, 5).orderBy(F.col("f1").desc_nulls_last(), "cents").first()
    assert (best.cents, best.f1) == (25, 1.0)


def test_cache_is_per_user_and_expires(spark):
    now = datetime(2024, 1, 2)
    asked = spark.createDataFrame([(1, 5, [1.0, 0.0], now), (2, 6, [1.0, 0.0], now)], "query_id long, user_id long, qvec array<float>, now timestamp")
    cache = spark.createDataFrame([(1, 5, [1.0, 0.01], now + timedelta(1)), (2, 5, [1.0, 0.0], now - timedelta(1)), (3, 7, [1.0, 0.0], now + timedelta(1)), (4, 6, [0.0, 1.0], now + timedelta(1))], "cache_id long, user_id long, embedding array<float>, expires_at timestamp")
    assert [(r.query_id, r.cache_id) for r in service.cache_lookup(asked, cache).collect()] == [(1, 1)]


def test_quota_and_lockout(spark):
    t = datetime(2024, 1, 1, 10)
    calls = spark.createDataFrame([(1, t + timedelta(seconds=k)) for k in range(51)] + [(2, t)], "user_id long, ts timestamp")
    assert {r.user_id: r.over_quota for r in service.daily_quota(calls).collect()} == {1: True, 2: False}
    fails = spark.createDataFrame([(1, t + timedelta(seconds=60 * k)) for k in range(5)] + [(2, t + timedelta(seconds=90 * k)) for k in range(5)], "user_id long, ts timestamp")
    locked = service.lockouts(fails).collect()
    assert [(r.user_id, r.failures, r.locked_until) for r in locked] == [(1, 5, t + timedelta(minutes=19))]


def test_retrieval_never_reads_the_cache(spark):
    """No plan of a retrieval query names the cache's columns."""
    from docloom.plans import catalog

    for name in ("keyword_topk", "vector_topk", "rrf_fusion"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "cache" not in plan and "expires_at" not in plan


def test_more_queries_than_a_block(spark, monkeypatch):
    """Queries beyond a block are searched in further blocks, with the same rows."""
    from docloom.plans import catalog

    sf, names = "/root/testdata/sf0.001", ("vector_topk", "vector_topk_scoped", "rrf_fusion")
    want = {n: sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect())) for n in names}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    for n in names:
        assert sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect())) == want[n]
