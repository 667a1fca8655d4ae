"""Phrase collocations: phrases whose words stand together far more often than their parts would by chance.

Only the longest windows are counted: one at each word, padded where its piece ends. The count of a shorter phrase is the
sum over the windows that begin with it, which one ROLLUP of the window's columns gives for all lengths at once. A window
is cut where two neighbouring words are too rare to stand in any phrase; a table of bits over hashed pairs tells that,
which lets some rare pairs pass and never stops a frequent one, so counts of frequent phrases stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docloom.llm.importance import lowered
from docloom.llm.shared import as_text, discard, read, seen, written

#: Words of the longest phrase, its least count, phrases reported of each language, percent of a count that drops a part.
LONGEST, MIN_COUNT, TOP, COVERED = 5, 100, 2000, 100
#: Bits of the table of pairs: one for so many bytes of text for each occurrence asked, and 128 MB of them at most.
BYTES_A_BIT, LEAST_BITS, MOST_BITS = 1.6, 1 << 16, 1 << 30
#: Phrases of a language that are put in order in one task.
CELL = 100_000
UNKNOWN = "und"
#: What stands for the end of a piece: a mark itself, so never a word.
END = "."


def words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang and the words of each text in order, with END between pieces; empty strings may stand at both ends."""
    text = F.regexp_replace(lowered(as_text(text_col)), "[.,;:!?\\x0A-\\x0D]", f" {END} ")
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.split(text, "[\\x20\\x09]+").alias("words"))


def _leads(rows: DataFrame, n: int) -> DataFrame:
    """lang, w1 .. wn: each word and those that follow it in its text, null after the last."""
    shifted = [F.slice("words", k, 2**31 - 1).alias(f"w{k}") for k in range(2, n + 1)]
    out = rows.select("lang", F.inline(F.arrays_zip(F.col("words").alias("w1"), *shifted))).toDF("lang", *[f"w{k}" for k in range(1, n + 1)])
    return out.filter((F.col("w1") != "") & (F.col("w1") != END))


def _bit(first: str, second: str, bits: int) -> Column:
    return F.xxhash64("lang", first, second).bitwiseAND(F.lit(bits - 1).cast("long"))


def _is_word(name: str) -> Column:
    return F.coalesce((F.col(name) != "") & (F.col(name) != END), F.lit(False))


def frequent_pairs(rows: DataFrame, bits: int, min_count: int = MIN_COUNT) -> DataFrame:
    """One row with the column `table`, an array of 64-bit words: the bits of hashed pairs that occur min_count times or more together.

    At most bits / 64 rows of two numbers reach the driver, 16 million at MOST_BITS.
    """
    pairs = _leads(rows, 2).filter(_is_word("w2")).select(_bit("w1", "w2", bits).alias("bit")).groupBy("bit").count().filter(F.col("count") >= min_count)
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    found = pairs.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(place).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    lists = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table))
    return rows.sparkSession.createDataFrame(pa.table({"table": lists}))


def bits_for(size: int, min_count: int = MIN_COUNT) -> int:
    """Bits of the table for texts of that many bytes: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(size / (BYTES_A_BIT * min_count)).bit_length()))


def windows(rows: DataFrame, pairs: DataFrame, bits: int, longest: int = LONGEST) -> DataFrame:
    """lang, w1 .. wn, count: the longest windows, padded with empty strings from the first pair on that is rare or ends a piece."""
    out = _leads(rows, longest).withColumn("table", pairs.scalar())
    for k in range(2, longest + 1):
        at = _bit(f"w{k - 1}", f"w{k}", bits)
        hit = F.getbit(F.get("table", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
        go = _is_word(f"w{k}") & hit
        out = out.withColumn(f"go{k}", go if k == 2 else F.col(f"go{k - 1}") & go)
    padded = [F.when(F.col(f"go{k}"), F.col(f"w{k}")).otherwise("").alias(f"w{k}") for k in range(2, longest + 1)]
    return out.select("lang", "w1", *padded).groupBy("lang", *[f"w{k}" for k in range(1, longest + 1)]).count()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, k, words, phrase, f) of phrases of 1 to longest words with f >= min_count, and (lang, n)."""
    rows = words(docs, text_col, lang_col)
    if bits is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0]
        bits = bits_for(size or 0, min_count)
    top = written(windows(rows, frequent_pairs(rows, bits, min_count), bits, longest), "phrase-windows")
    names = [f"w{k}" for k in range(1, longest + 1)]
    sums = top.rollup("lang", *names).agg(F.sum("count").alias("f"), F.grouping_id().alias("g"))
    # level k has k words: the grouping id has a one for each column that is summed away
    level = F.lit(longest) - F.bit_count("g")
    last = F.array(F.lit(END), *[F.col(c) for c in names])
    sums = sums.withColumn("k", level).filter("k >= 0").filter((F.col("k") == 0) | ((F.col("f") >= min_count) & (F.get(last, F.col("k")) != "")))
    both = written(sums.select("lang", "k", F.slice(F.array(*names), F.lit(1), F.col("k")).alias("words"), "f"), "phrase-counts")
    discard(top)
    phrases = both.filter("k > 0").select("lang", "k", "words", F.array_join("words", " ").alias("phrase"), "f")
    return phrases, both.filter("k = 0").select("lang", F.col("f").alias("n"))


def _scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more, by the cut with the lowest score."""
    cuts = phrases.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("words", F.lit(1), F.col("cut")), " "), "right": F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ")})
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(F.broadcast(totals), "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"over": (big("a") * big("n") * F.lit(1000)).cast("decimal(38,0)"), "under": (big("l") * big("r")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def _covered(phrases: DataFrame, covered: int) -> DataFrame:
    """(lang, phrase, most): for each phrase inside longer ones, the largest count of those."""
    spans = F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))
    inner = phrases.filter("k > 2").select("lang", "f", F.explode(F.flatten(spans)).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def _best(rows: DataFrame, rows_at_most: int, top: int) -> DataFrame:
    """The first `top` rows of each lang with their rank: first within cells of hashed phrases, then of what these leave."""
    cells = max(1, -(-rows_at_most // max(CELL, 2 * top)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    while True:
        over = W.Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(cells))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(over).cast("long")).filter(F.col("rank") <= top)
        if cells == 1:
            return rows
        cells = -(-cells * top // max(CELL, 2 * top))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Texts are lower-cased (A-Z) and cut at marks and line ends into pieces, these at blanks into words. A phrase has 2 to
    longest words of a piece and min_count occurrences (a) or more; n is the number of all words of its language, l and r
    are the counts of its parts at the cut with the lowest score, 1000 * a * n / (l * r) rounded down; of equal ones the
    earliest cut. Phrases inside a longer one with covered percent of their count or more are left out. Order: score,
    then a, then the phrase by bytes. A null language is `und`; null and empty texts have no words; repeated rows count
    again; a text may be of any length; other columns are ignored; an empty table gives an empty result. bits: a power of
    two, of the table of pairs; it changes what moves, not the result.
    """
    phrases, totals = counted(docs, text_col, lang_col, min_count, longest, bits)
    scored = _scored(phrases, totals).join(_covered(phrases, covered), ["lang", "phrase"], "left")
    kept = written(scored.filter(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most"), "phrase-scores")
    return _best(kept, seen(kept), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}
ORACLE_SQL = {
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        g AS (SELECT lang, ws[i : i + k - 1] AS words FROM i, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws)),
        f AS (SELECT lang, words, len(words) AS k, array_to_string(words, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, words),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
        u AS (SELECT lang, phrase, f AS a, words, k, unnest(range(1, k)) AS cut FROM c),
        s AS (SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
              FROM u JOIN f AS x ON x.lang = u.lang AND x.words = u.words[1 : cut] JOIN f AS y ON y.lang = u.lang AND y.words = u.words[cut + 1 :] JOIN n ON n.lang = u.lang),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s),
        inner_ AS (SELECT lang, f, words, k, unnest(range(2, k)) AS m FROM c WHERE k > 2),
        spans AS (SELECT lang, f, words, m, unnest(range(1, k - m + 2)) AS i FROM inner_),
        d AS (SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(f) AS most FROM spans GROUP BY 1, 2),
        t AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
              FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE o = 1 AND (most IS NULL OR 100 * most < 100 * a))
        SELECT * FROM t WHERE rank <= 2000"""
}
