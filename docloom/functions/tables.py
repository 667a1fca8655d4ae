"""Functions for SQL: SELECT * FROM sentences_of(text), chunk_text(text), and sentence_list(text). They run in the JVM only.

Spark joins the rows of a table function with its argument, so over a table whose texts are large sentences_of shuffles them,
twice; sentence_list works in a text's row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from docloom.operators.segments import MARK, NUMBER_GAP, SENTENCE_END


def quoted(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sentence_sql(t: str = "t") -> str:
    """segments.sentence_array as SQL."""
    held = f"regexp_replace({t}, {quoted(NUMBER_GAP)}, concat('$1', char(2)))"
    cut = f"regexp_replace({held}, {quoted(SENTENCE_END)}, concat('$1', {quoted(MARK)}))"
    return f"filter(split(translate({cut}, char(2), ''), {quoted(MARK)}), s -> s <> '')"


def register(spark: SparkSession) -> None:
    """Define the functions in the session: sentence_list(t), sentences_of(t), chunk_text(t, size, overlap).

    Their rows are those of segments.sentences, retrieval.postings and segments.fixed_chunks for one text in normal form,
    as in `SELECT d.doc_id, s.* FROM docs d, LATERAL sentences_of(d.norm) s`. A null or empty text has no rows. sentence_list
    gives the sentences of sentences_of as an array, for LATERAL VIEW.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sentence_list(t STRING) RETURNS ARRAY<STRING> RETURN {sentence_sql()}")
    starts = "transform(a, (s, i) -> struct(i AS no, s AS sentence))"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION sentences_of(t STRING) RETURNS TABLE (sent_no INT, sentence STRING)
        RETURN SELECT x.no, x.sentence FROM (SELECT explode({starts}) AS x FROM (SELECT {sentence_sql()} AS a))""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(t STRING, size INT DEFAULT 800, overlap INT DEFAULT 120) RETURNS TABLE (chunk_index INT, char_start INT, char_end INT, content STRING)
        RETURN SELECT i, at, at + char_length(content), content FROM (
            SELECT i, i * (size - overlap) AS at, substring(array_join(slice(steps, i + 1, 1 + CAST(ceil(overlap / (size - overlap)) AS INT)), ''), 1, size) AS content
            FROM (SELECT posexplode(steps) AS (i, step), steps FROM (SELECT regexp_extract_all(t, concat('(?s).{1,', size - overlap, '}'), 0) AS steps)))""")
