"""Exact dedup: of rows whose texts are equal without white space, one stays; only possibly repeated rows shuffle.

Pass 1 puts the hash of each text into a Bloom filter of 64-bit words and works out which of its bits were set more than
once. Pass 2 probes that plane: a row with a bit that nobody else has set is surely unique and passes straight through;
the others, true copies and the few that the filter can't tell from them, are grouped by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import as_text, discard, read, seen, sized, spare_name, with_place, written

#: Rows for each 64-bit word of the filter, at most, and bits that a row sets in it, each in a part of its own.
ROWS_A_WORD, PARTS = 4, 4
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _mask(h: Column) -> Column:
    """The bits of a hash in its word: one in each part."""
    width = 64 // PARTS
    out = F.lit(0).cast("long")
    for part in range(PARTS):
        place = F.shiftrightunsigned(h, 4 * part).bitwiseAND(F.lit(width - 1)).cast("int") + part * width
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def _word(h: Column, words: int) -> Column:
    """The word of a hash: bits that its mask doesn't use."""
    return F.shiftrightunsigned(h, 4 * PARTS).bitwiseAND(F.lit(words - 1).cast("long"))


def words_for(rows: int) -> int:
    return 1 << max(0, (max(rows, 1) - 1) // ROWS_A_WORD).bit_length()


def repeated_bits(hashes: DataFrame, words: int) -> DataFrame:
    """(word, twice), a written table: the bits of each word that two or more rows of the long column h have set.

    Rows of equal hash are counted before they are shuffled, so a hash that a third of all rows share costs a row a task. A
    word gathers distinct masks, 65,536 at most. Words in which no row can be repeated are left out.
    """
    pairs = hashes.select(_word(F.col("h"), words).alias("word"), _mask(F.col("h")).alias("mask")).groupBy("word", "mask").count()
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("once"), zero.alias("twice"))
    step = lambda s, m: F.struct(s["once"].bitwiseOR(m).alias("once"), s["twice"].bitwiseOR(s["once"].bitwiseAND(m)).alias("twice"))
    shared = F.aggregate(F.collect_list("mask"), start, step, lambda s: s["twice"])
    sure = F.coalesce(F.bit_or(F.when(F.col("count") > 1, F.col("mask"))), zero)
    planes = pairs.groupBy("word").agg(shared.bitwiseOR(sure).alias("twice"))
    width = 64 // PARTS
    parts = [F.shiftrightunsigned("twice", part * width).bitwiseAND(F.lit((1 << width) - 1)) != 0 for part in range(PARTS)]
    usable = parts[0]
    for p in parts[1:]:
        usable = usable & p
    return written(planes.filter(usable), "exact-filter")


def _probed(rows: DataFrame, plane: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(rows that are surely unique by their column h, the possibly repeated ones)."""
    word, twice = spare_name(rows, "word"), spare_name(rows, "twice")
    both = rows.withColumn(word, _word(F.col("h"), words)).join(sized(plane).withColumnsRenamed({"word": word, "twice": twice}), word, "left")
    mask = _mask(F.col("h"))
    repeated = F.coalesce(mask.bitwiseAND(F.col(twice)) == mask, F.lit(False))
    return tuple(both.filter(c).select(*rows.columns) for c in (~repeated, repeated))


def _marks(docs: DataFrame, id_col: str, text_col: str, stored: bool) -> tuple[DataFrame, DataFrame, int]:
    """(a written table of f, at, id, chars, sha, h for each row, the plane of repeated bits, the words of the filter)."""
    placed, file, at = with_place(docs, stored)
    slim = placed.select(F.col(file).alias("f"), F.col(at).alias("at"), F.col(id_col).alias("id"), as_text(text_col).alias("text"))
    slim = slim.select("f", "at", "id", F.char_length("text").alias("chars"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("sha"))
    marks = written(slim.withColumn("h", F.xxhash64("sha")), "exact-marks")
    words = words_for(seen(marks))
    return marks, repeated_bits(marks, words), words


def _heads(repeated: DataFrame) -> DataFrame:
    """(sha, best, n), a written table: the row that stays and the number of rows of each text that several rows have."""
    order = F.struct((-F.col("chars")).alias("less"), F.isnull("id").alias("none"), "id", "f", "at")
    return written(repeated.groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1"), "exact-heads")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal when they are identical without ASCII white space; null counts as empty, and texts without words are
    equal to each other. Of equal texts the row with the most characters stays, then that with the least id, nulls last;
    of rows that are equal in that too, the first by file and place, so one row of a group is kept. keep_id is null where
    a row without id stays. Texts of any length are read whole and once; other columns are ignored; an empty table gives
    an empty result. stored: as in with_place.
    """
    marks, plane, words = _marks(docs, id_col, text_col, stored)
    alone, repeated = _probed(marks, plane, words)
    heads = sized(_heads(repeated))
    joined = repeated.join(heads, "sha", "left")
    here = F.col("best").isNull() | ((F.col("f") == F.col("best.f")) & (F.col("at") == F.col("best.at")))
    keep = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    out = alone.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return out.union(joined.select("id", keep, F.coalesce("n", F.lit(1)).cast("long"), here, sha))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns; the rule is that of exact_groups.

    Texts of surely unique rows aren't shuffled; possibly repeated ones only where those that go are too many to broadcast.
    """
    docs = docs if stored else written(docs, "rows")  # both passes must find a row at the same place
    marks, plane, words = _marks(docs, id_col, text_col, True)
    repeated = _probed(marks, plane, words)[1]
    heads = _heads(repeated)
    joined = repeated.join(sized(heads), "sha")
    gone = written(joined.filter((F.col("f") != F.col("best.f")) | (F.col("at") != F.col("best.at"))).select("f", "at"), "exact-gone")
    discard(marks, heads)
    placed, file, at = with_place(docs, True)
    rows = placed.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(file).alias("f"), F.col(at).alias("at"), as_text(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)))).drop("text")
    alone, repeated = _probed(rows, plane, words)
    out = alone.union(repeated.join(sized(gone), ["f", "at"], "left_anti").select(*rows.columns))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op12_bloom_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), stored=True)


QUERIES = {"op12_bloom_exact": op12_bloom_exact}
ORACLE_SQL = {
    "op12_bloom_exact": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size, row_number() OVER w = 1 AS kept, sha AS text_sha256
        FROM t WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id NULLS LAST)"""
}
