"""Queries of the whole retrieval chain and of its evaluation: both branches, fusion, reranking, gate, configurations.

A question is a benchmark item: its words by phrase and word, its vector that of the same number. A document's vector
has the document's number; it is right for a question if both vectors have one label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import lexemes, normalized
from docloom.operators import evaluation, nearest, retrieval
from docloom.operators.tenancy import ratio
from docloom.plans.catalog import COSINE, LEXEMES, PHRASES, VECTOR, _judged, _terms, norm_docs, query
from docloom.sources.shared import stored
from docloom.sources.tables import load

DENSE = f"""{PHRASES},
    ev AS (SELECT query_id, doc_id, max(CASE WHEN part = 0 THEN "at" END) OVER w AS a0, max(CASE WHEN part = 1 THEN "at" END) OVER w AS a1 FROM hits WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY "at", part ROWS UNBOUNDED PRECEDING)),
    cover AS (SELECT query_id, doc_id, least(a0, a1) AS b, min(greatest(a0 + 2, a1)) AS e FROM ev WHERE a0 IS NOT NULL AND a1 IS NOT NULL GROUP BY ALL),
    dense AS (SELECT query_id, doc_id, round(sum(0.1::DOUBLE / (1 + greatest(0, e - b + 1 - 4))), 6) AS score FROM cover GROUP BY ALL),
    kb AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rnk FROM dense QUALIFY rnk <= 50)"""
VECTORS = f"""vb AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rnk FROM (
        SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {COSINE} AS score FROM embeddings v JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM documents)) QUALIFY rnk <= 50)"""
HYBRID = f"""{DENSE}, {VECTORS},
    fb AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rnk FROM (
        SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rnk)), 9) AS score FROM (SELECT query_id, doc_id, rnk FROM kb UNION ALL SELECT query_id, doc_id, rnk FROM vb) GROUP BY ALL) QUALIFY rnk <= 50),
    lx AS (SELECT f.query_id, f.doc_id, len(list_intersect(list_distinct(q.w), {LEXEMES})) / len(list_distinct(q.w))::DOUBLE AS share FROM fb f JOIN q ON q.item_id = f.query_id JOIN d USING (doc_id)),
    rb AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rnk FROM (
        SELECT query_id, doc_id, round(1 / (1 + exp(-(8 * coalesce(share, 0) - 4))), 6) AS score FROM lx) QUALIFY rnk <= 8)"""


def _keyword_branch(spark, sf) -> DataFrame:
    return retrieval.top(retrieval.cover_density(_terms(spark, sf), retrieval.postings(norm_docs(spark, sf))), "query_id", "doc_id")


def _vector_branch(spark, sf) -> DataFrame:
    v = load(spark, sf, "embeddings")
    asked = v.join(load(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    held = v.join(load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return nearest.scan(asked, held).withColumnRenamed("vec_id", "doc_id")


def _fused(spark, sf) -> DataFrame:
    return retrieval.fuse([_keyword_branch(spark, sf), _vector_branch(spark, sf)], "doc_id")


def _reranked(spark, sf, fused: DataFrame, *before: str) -> DataFrame:
    """The fused candidates by their words; the reranker sees a document with the columns of `before` in front of it."""
    asked = normalized(load(spark, sf, "benchmark")).select(F.col("item_id").alias("query_id"), lexemes(F.col("norm")).alias("asked"))
    texts = load(spark, sf, "documents").select("doc_id", "text", *before).join(fused.select("doc_id").distinct(), "doc_id", "left_semi")
    own = lexemes(F.col("norm"))
    held = normalized(texts).select("doc_id", (F.concat(lexemes(F.concat_ws(" ", *before)), own) if before else own).alias("held"))
    both = fused.join(asked, "query_id").join(held, "doc_id")
    return retrieval.rerank(both.select("query_id", "doc_id", "asked", "held"), retrieval.lexical_logit(F.col("asked"), F.col("held")), "doc_id").select("query_id", "doc_id", "score", "rnk")


def _steps(spark, sf) -> dict[str, DataFrame]:
    """The candidates after each step, each worked out once and written: a plan that uses them often doesn't grow."""
    keyword, vector = (stored(b, "branch")[0] for b in (_keyword_branch(spark, sf), _vector_branch(spark, sf)))
    fused = stored(retrieval.fuse([keyword, vector], "doc_id"), "fused")[0]
    return {"keyword": keyword, "vector": vector, "fused": fused, "reranked": stored(_reranked(spark, sf, fused), "reranked")[0]}


@query(f"WITH {DENSE} SELECT query_id, doc_id, score, rnk FROM kb")
def keyword_density(spark, sf):
    return _keyword_branch(spark, sf)


@query(f"WITH {HYBRID} SELECT query_id, doc_id, score, rnk FROM fb")
def hybrid_search(spark, sf):
    return _fused(spark, sf)


@query(f"WITH {HYBRID} SELECT query_id, doc_id, score, rnk FROM rb")
def hybrid_rerank(spark, sf):
    return _reranked(spark, sf, _fused(spark, sf))


@query(f"""WITH {HYBRID} SELECT b.item_id AS query_id, max(rb.score) AS top_score, CASE WHEN max(rb.score) >= 0.35 THEN 'grounded' ELSE 'no_answer' END AS answer_kind
    FROM benchmark b LEFT JOIN rb ON rb.query_id = b.item_id GROUP BY b.item_id""")
def hybrid_gate(spark, sf):
    return retrieval.gate(_reranked(spark, sf, _fused(spark, sf)), asked=load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")))


@query(f"""WITH {HYBRID} SELECT query_id, doc_id, 'keyword' AS step, score, rnk FROM kb UNION ALL SELECT query_id, doc_id, 'vector', score, rnk FROM vb
    UNION ALL SELECT query_id, doc_id, 'fused', score, rnk FROM fb UNION ALL SELECT query_id, doc_id, 'reranked', score, rnk FROM rb""")
def query_trace(spark, sf):
    """Every candidate of every question with its place after each step."""
    steps = _steps(spark, sf)
    rows = [r.select("query_id", "doc_id", F.lit(k).alias("step"), "score", "rnk") for k, r in steps.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


CONFIGS = f"""{HYBRID}, c AS (SELECT 'A' AS config, query_id, doc_id, rnk FROM vb UNION ALL SELECT 'B', query_id, doc_id, rnk FROM kb UNION ALL SELECT 'C', query_id, doc_id, rnk FROM fb UNION ALL SELECT 'D', query_id, doc_id, rnk FROM rb
        UNION ALL SELECT 'E', query_id, doc_id, rnk FROM xb UNION ALL SELECT 'F', query_id, doc_id, rnk FROM rb WHERE query_id IN (SELECT query_id FROM rb GROUP BY query_id HAVING max(score) >= 0.35)),"""
CONFIGS = CONFIGS.replace(", c AS (", f""",
    lp AS (SELECT f.query_id, f.doc_id, len(list_intersect(list_distinct(q.w), list_concat({LEXEMES.replace("(t,", "(d.source || ' ' || d.lang,")}, {LEXEMES}))) / len(list_distinct(q.w))::DOUBLE AS share FROM fb f JOIN q ON q.item_id = f.query_id JOIN d USING (doc_id)),
    xb AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rnk FROM (SELECT query_id, doc_id, round(1 / (1 + exp(-(8 * coalesce(share, 0) - 4))), 6) AS score FROM lp) QUALIFY rnk <= 8), c AS (""", 1)


@query(f"""WITH {VECTOR}, t AS (SELECT query_id, max(score) AS faithfulness, avg(CASE WHEN rnk <= 10 THEN score END) AS relevancy, max(CAST(relevant AS INTEGER)) AS recall, avg(CASE WHEN rnk <= 10 THEN CAST(relevant AS INTEGER) END) AS precision FROM vt GROUP BY query_id)
    SELECT count(*) AS n, round(avg(faithfulness), 6) AS faithfulness, round(avg(relevancy), 6) AS relevancy, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
        round(avg(CASE WHEN faithfulness >= 0.3 AND relevancy >= 0.2 AND recall >= 0.75 AND precision >= 0.05 THEN 1 ELSE 0 END), 6) AS pass_rate FROM t""")
def metric_pass_rate(spark, sf):
    """Four metrics of each question; those that reach all minima pass."""
    return evaluation.pass_rates(_samples(spark, sf), {"faithfulness": 0.3, "relevancy": 0.2, "recall": 0.75, "precision": 0.05})


def _samples(spark, sf) -> DataFrame:
    hit = F.col("positive").cast("int")
    near = lambda c: F.avg(F.when(F.col("rnk") <= 10, c))
    return _judged(spark, sf).groupBy("query_id").agg(F.max("score").alias("faithfulness"), near(F.col("score")).alias("relevancy"), F.max(hit).alias("recall"), near(hit).alias("precision"))


TAXONOMY = f"""WITH {VECTOR}, t AS (SELECT query_id, max(CASE WHEN rnk <= 10 AND relevant THEN 1 ELSE 0 END) AS found, max(score) AS best, max(CASE WHEN rnk <= 3 AND relevant THEN 1 ELSE 0 END) AS cited, max(CASE WHEN rnk = 1 AND relevant THEN 1 ELSE 0 END) AS answered FROM vt GROUP BY query_id),
    k AS (SELECT CASE WHEN found = 0 THEN 'retrieval' WHEN best < 0.3 THEN 'grounding' WHEN cited = 0 THEN 'citation' WHEN answered = 0 THEN 'answer' ELSE 'ok' END AS failure FROM t)"""


@query(f"{TAXONOMY} SELECT failure, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM k GROUP BY failure")
def failure_taxonomy(spark, sf):
    """What went wrong first with each question."""
    up_to = lambda n: F.max((F.col("positive") & (F.col("rnk") <= n)).cast("int")) == 1
    t = _judged(spark, sf).groupBy("query_id").agg(up_to(10).alias("found"), F.max("score").alias("best"), up_to(3).alias("cited"), up_to(1).alias("answered"))
    return evaluation.shares(t.select(evaluation.failure_class(F.col("found"), F.col("best") >= 0.3, F.col("cited"), F.col("answered")).alias("failure")), "failure")


@query(f"WITH {VECTOR} SELECT round(avg(CAST(relevant AS INTEGER)), 6) AS citation_accuracy, count(*) AS citations FROM vt WHERE rnk <= 3")
def citation_accuracy(spark, sf):
    """A question cites its first three; those with its label hold the answer."""
    return _judged(spark, sf).filter("rnk <= 3").agg(ratio(F.col("positive")).alias("citation_accuracy"), F.count("*").alias("citations"))


@query(f"""WITH {VECTOR}, g AS (SELECT query_id, max(score) >= 0.35 AS answered FROM vt GROUP BY query_id)
    SELECT query_id % 3 = 0 AS in_scope, count(*) AS n, round(avg(CASE WHEN answered THEN 0 ELSE 1 END), 6) AS refusal_rate FROM g GROUP BY ALL""")
def refusal_rates(spark, sf):
    """Every third question counts as in scope: there a refusal is wrong, elsewhere it is right."""
    kinds = retrieval.gate(_judged(spark, sf)).withColumn("in_scope", F.col("query_id") % 3 == 0)
    return kinds.groupBy("in_scope").agg(F.count("*").alias("n"), ratio(F.col("answer_kind") == "no_answer").alias("refusal_rate"))


@query(f"""WITH {CONFIGS} g AS (SELECT c.*, v.label = q.label AS relevant FROM c JOIN embeddings v ON v.vec_id = c.doc_id JOIN embeddings q ON q.vec_id = c.query_id),
    n AS (SELECT label, count(*) AS total FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) GROUP BY label)
    SELECT config, count(DISTINCT query_id) AS questions, round(avg(p), 6) AS precision_at_10, round(avg(r), 6) AS recall_at_10 FROM (
        SELECT config, query_id, avg(CAST(relevant AS INTEGER)) AS p, sum(CAST(relevant AS INTEGER)) / max(total)::DOUBLE AS r FROM g JOIN embeddings q ON q.vec_id = query_id JOIN n ON n.label = q.label WHERE rnk <= 10 GROUP BY ALL) GROUP BY config""")
def hybrid_ablation(spark, sf):
    """Configurations: vector alone, keywords alone, both, with reranking, with prefixed contents, with a checked top."""
    keyword, vector, fused, plain = _steps(spark, sf).values()
    sure = retrieval.gate(plain).filter("answer_kind = 'grounded'").select("query_id")
    ranked = {"A": vector, "B": keyword, "C": fused, "D": plain, "E": _reranked(spark, sf, fused, "source", "lang"), "F": plain.join(sure, "query_id", "left_semi")}
    rows = [r.select(F.lit(k).alias("config"), "query_id", "doc_id", "rnk") for k, r in ranked.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    v = load(spark, sf, "embeddings").select("vec_id", "label")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    docs = v.withColumnRenamed("vec_id", "doc_id").join(load(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    total = docs.groupBy(F.col("label").alias("q_label")).agg(F.count("*").alias("total"))
    hit = (F.col("label") == F.col("q_label")).cast("int")
    each = every.filter("rnk <= 10").join(docs, "doc_id").join(q, "query_id").join(total, "q_label").groupBy("config", "query_id").agg(F.avg(hit).alias("p"), (F.sum(hit) / F.max("total")).alias("r"))
    return each.groupBy("config").agg(F.countDistinct("query_id").alias("questions"), F.round(F.avg("p"), 6).alias("precision_at_10"), F.round(F.avg("r"), 6).alias("recall_at_10"))


@query(f"""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), m AS (SELECT 'whole' AS model, vec_id, label, embedding FROM v UNION ALL SELECT 'half', vec_id, label, embedding[1:32] FROM v),
    s AS (SELECT v.model, q.vec_id AS query_id, v.vec_id, {COSINE} AS score, v.label = q.label AS relevant FROM m v JOIN m q ON v.model = q.model AND q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, vec_id) AS rnk FROM s QUALIFY rnk <= 10)
    SELECT model, count(DISTINCT query_id) AS questions, round(avg(CAST(relevant AS INTEGER)), 6) AS precision FROM t GROUP BY model""")
def model_bakeoff(spark, sf):
    """Two embedders over the same questions: all dimensions, and the first half of them."""
    v = load(spark, sf, "embeddings")
    rows = []
    for model, vector in (("whole", F.col("embedding")), ("half", F.slice("embedding", 1, 32))):
        own = v.withColumn("embedding", vector)
        asked = own.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
        rows.append(nearest.scan(asked, own, 10, other=[("vec_id", "query_id")]).withColumn("model", F.lit(model)))
    labels = v.select("vec_id", "label")
    judged = rows[0].unionByName(rows[1]).join(labels, "vec_id").join(labels.toDF("query_id", "q_label"), "query_id")
    return judged.groupBy("model").agg(F.countDistinct("query_id").alias("questions"), ratio(F.col("label") == F.col("q_label")).alias("precision"))
