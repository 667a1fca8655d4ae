"""Documents from blocks that a parser has found: reading order, offsets, pages, styles, tables.

Binary parsers are not part of this library: they deliver rows (doc_id, page, block_no, text, bbox).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import normalized

# Beginnings of the style names of headings and lists, and the names of titles.
HEADINGS = ["heading", "tiêu đề", "đầu đề"]
TITLES = ["title", "tiêu đề chính"]
LISTS = ["list bullet", "list number", "list paragraph", "danh sách"]
SCAN_CHARS, SCAN_SHARE = 100, 0.5


def heading_level(style: Column) -> Column:
    """The level of a heading by its style: the number after a heading's name, 6 at most, and 1 without a number; titles are 1."""
    name = F.lower(F.regexp_replace(style, "^\\s+|\\s+$", ""))
    number = F.regexp_extract(name, f"^(?:{'|'.join(HEADINGS)})\\s*(\\d+)$", 1)
    numbered = F.when(number != "", F.least(F.lit(6), F.coalesce(number.try_cast("int"), F.lit(6))))
    return F.coalesce(numbered, F.when(name.rlike(f"^(?:{'|'.join(HEADINGS)})") | name.isin(*TITLES), 1))


def styled(style: Column, text: Column) -> Column:
    """A paragraph in Markdown by its style: headings up to level 6, list items, or as it is."""
    level = heading_level(style)
    is_list = F.lower(F.regexp_replace(style, "^\\s+", "")).rlike(f"^(?:{'|'.join(LISTS)})")
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(is_list, F.concat(F.lit("- "), text)).otherwise(text)


def table_markdown(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, table_no, text of rows (key, table_no, row_no, cells); rows of empty cells drop out."""
    cells = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s*\n\\s*", " ")))
    lines = rows.withColumn("cells", cells).filter(F.exists("cells", lambda c: c != ""))
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    joined = lines.groupBy(key, "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line"), F.size("cells").alias("n")))).alias("r"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.get("r", F.lit(0))["n"]))
    head, rest = F.slice("r", 1, 1), F.slice("r", 2, F.greatest(F.lit(0), F.size("r") - 1))
    return joined.select(key, "table_no", F.array_join(F.concat(F.transform(head, lambda x: x["line"]), F.array(rule), F.transform(rest, lambda x: x["line"])), "\n").alias("text"))


def assemble(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, full_text, pages (page, start, end), blocks (page, char_start, char_end, bbox), page_count.

    Blocks come in reading order (page, rounded top, rounded left, number), normalized; blank ones drop out; each is
    followed by a newline, and a page without text is one newline.
    """
    # dealt by document once: windows by page and by document, and groups, then stay where they are
    clean = normalized(blocks).withColumn("norm", F.btrim("norm", F.lit(" \t\n"))).select(key, "page", "block_no", "bbox", "norm").repartition(key)
    order = [F.round("bbox.y0", 1), F.round("bbox.x0", 1), F.col("block_no")]
    kept = clean.withColumn("_has", F.max((F.col("norm") != "").cast("int")).over(Window.partitionBy(key, "page")))
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(key, "page").orderBy((F.col("norm") == ""), *order)))
    kept = kept.filter((F.col("norm") != "") | ((F.col("_has") == 0) & (F.col("_n") == 1)))
    w = Window.partitionBy(key).orderBy("page", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = kept.withColumn("_end", F.sum(F.char_length("norm") + 1).over(w).cast("int"))
    kept = kept.withColumn("_start", F.col("_end") - 1 - F.char_length("norm"))
    pages = kept.groupBy(key, "page").agg(F.min("_start").alias("start"), F.max("_end").alias("end")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "start", "end"))).alias("pages"))
    block = F.struct(F.col("_start").alias("char_start"), (F.col("_end") - 1).alias("char_end"), "page", "bbox", "norm")
    text = kept.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("b"))
    full = F.concat(F.array_join(F.transform("b", lambda x: x["norm"]), "\n"), F.lit("\n"))
    spans = F.transform(F.filter("b", lambda x: x["norm"] != ""), lambda x: F.struct(x["page"].alias("page"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"), x["bbox"].alias("bbox")))
    return text.select(key, full.alias("full_text"), spans.alias("blocks")).join(pages, key).withColumn("page_count", F.size("pages"))


def page_of(pages: Column, pos: Column) -> Column:
    """The page that holds an offset; the last page past the end; 0 without pages."""
    inside = F.filter(pages, lambda p: (p["start"] <= pos) & (pos < p["end"]))
    return F.coalesce(F.get(inside, F.lit(0))["page"], F.try_element_at(pages, F.lit(-1))["page"], F.lit(0))


def bboxes_for(blocks: Column, start: Column, end: Column) -> Column:
    """Boxes of the blocks that overlap a span."""
    return F.transform(F.filter(blocks, lambda b: (b["char_start"] < end) & (b["char_end"] > start) & b["bbox"].isNotNull()), lambda b: b["bbox"])


def scanned(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, poor_share, is_scanned of rows (key, page, text): most pages with few characters."""
    poor = (F.char_length(F.trim(F.coalesce("text", F.lit("")))) < SCAN_CHARS).cast("int")
    return pages.groupBy(key).agg(F.avg(poor).alias("poor_share")).withColumn("is_scanned", F.col("poor_share") > SCAN_SHARE)
