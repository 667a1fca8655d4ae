"""Line dedup: lines that stand on many distinct sites are boilerplate and go.

Sites of each line are sketched with HyperLogLog; sketches merge in the aggregation, so a line on every page of the
corpus costs a few kilobytes. Lines whose estimate is near the threshold are counted exactly; only their rows are
shuffled again. Lines well under it stay, lines well over it go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import as_text, discard, read, written

#: Distinct sites from which a line is boilerplate; sketch precision; estimates this close to the threshold are counted.
MIN_SITES, PRECISION, MARGIN = 5, 12, 0.1
BLANKS = " \t\r\x0b\x0c"


def _site(col: str) -> Column:
    """The site as text; a null site is a site of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("n"))


def _lines(docs: DataFrame) -> DataFrame:
    """g1, g2 (the text), pos, k1, k2 (the line without blanks at its ends), site; blank lines left out."""
    out = docs.select("g1", "g2", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    out = out.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line <> ''")
    return out.select("g1", "g2", "pos", "site", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(3), "line").alias("k2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, precision: int = PRECISION, margin: float = MARGIN) -> DataFrame:
    """(k1, k2) of the lines on min_sites distinct sites or more, as a written table."""
    sketched = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(precision)).alias("sketch"))
    spread = written(sketched.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("n")).filter(F.col("n") >= min_sites * (1 - margin)), "line-spread")
    near = spread.filter(F.col("n") <= min_sites * (1 + margin)).select("k1", "k2")
    exact = lines.select("k1", "k2", "site").join(near, ["k1", "k2"], "left_semi").distinct().groupBy("k1", "k2").count().filter(F.col("count") >= min_sites)
    out = written(spread.filter(F.col("n") > min_sites * (1 + margin)).select("k1", "k2").union(exact.select("k1", "k2")), "line-boilerplate")
    discard(spread)
    return out


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", **options) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines, n_removed for each row of docs.

    Lines are split at newlines and compared without blanks at their ends; blank lines always stay. Null texts count
    as empty, a null site is one site; repeated rows and null ids keep their rows; a text may be of any length and
    may lose all its lines; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), as_text(text_col).alias("text"), _site(site_col).alias("site"))
    rows = rows.withColumns({"g1": F.xxhash64("text"), "g2": F.xxhash64(F.lit(3), "text")})
    lines = _lines(rows)
    flagged = boilerplate(lines, **options)
    # equal texts lose equal lines, so places go by text
    gone = written(lines.select("g1", "g2", "pos", "k1", "k2").join(flagged, ["k1", "k2"], "left_semi").groupBy("g1", "g2").agg(F.collect_set("pos").alias("gone")), "line-places")
    parts = F.split("text", "\n", -1)
    both = rows.join(gone, ["g1", "g2"], "left").withColumn("parts", parts)
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("parts"), i)), "\n"))
    return both.select("doc_id", text.alias("text"), F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


QUERIES = {"op6_line_spread": op6_line_spread}
ORACLE_SQL = {
    "op6_line_spread": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('s' || source, 'n') AS site FROM documents),
        l AS (SELECT r, doc_id, site, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
        k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM l),
        b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 5),
        f AS (SELECT k.*, b.key IS NOT NULL AS gone FROM k LEFT JOIN b ON k.key = b.key),
        o AS (SELECT r, doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                     coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM f GROUP BY r, doc_id)
        SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM o"""
}
