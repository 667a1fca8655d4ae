"""Sentences, headings, sections and chunks with exact character offsets.

Sentence ends are one regular expression over the whole text; packing is a fold over the units of one section, in the
row of its document. Only numbers of pieces, their lengths and finished chunks leave it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import BLANKS, SPACE, estimate_tokens
from docloom.operators.intervals import as_of, overlaps
from docloom.sources.shared import stored

# Abbreviations whose full stop ends no sentence; ranks of legal headings.
ABBREVIATIONS = [
    "ts", "pgs", "gs", "ths", "bs", "ks", "cn", "ncs",
    "ông", "bà", "anh", "chị", "em", "cô", "chú", "bác",
    "tp", "q", "p", "h", "x", "tt", "ttp",
    "đ", "kh", "k", "nđ", "qđ", "cv", "bc", "ttr", "nq", "ct",
    "tcvn", "iso", "iec", "ieee",
    "tr", "st", "stt", "vd", "vv", "v.v", "no", "nr", "vol", "fig",
]
LEGAL_LEVEL = {"phần": 1, "chương": 2, "mục": 3, "điều": 4, "phụ lục": 1}
MARK = "\u0001"  # cannot occur in normalized text
#: A run of closing punctuation and white space that ends a sentence: what stands before and after decides.
_START = f"(?:^|[{SPACE}.])"
_GAP = "\\.?\n?"  # what may stand between a word and the mark: a full stop, and the line's end
SENTENCE_END = (
    f"(?=[.!?…])(?<!{_START}(?iu:{'|'.join(map(re.escape, ABBREVIATIONS))}){_GAP})(?<!{_START}\\p{{L}}{_GAP})(?<![.!?…])"
    f"([.!?…]+[\"'”’)\\]]*[{SPACE}]+)(?=[\\p{{Lu}}\\p{{Lt}}\\p{{Nd}}\"'“‘(\\-–—•])"
)
#: A number before a single mark and a digit after it stay together.
NUMBER_GAP = f"(?=[.!?…])(?<=\\p{{Nd}})([.!?…]+[\"'”’)\\]]*[{SPACE}]+)(?=\\p{{Nd}})"


def sentence_array(norm: Column) -> Column:
    """The sentences of a text, which together are the text; blanks after a sentence belong to it."""
    held = F.regexp_replace(norm, NUMBER_GAP, "$1\u0002")  # a mark that no sentence end may precede
    cut = F.regexp_replace(held, SENTENCE_END, f"$1{MARK}")
    return F.filter(F.split(F.translate(cut, "\u0002", ""), MARK), lambda s: s != "")


def spans(df: DataFrame, pieces: Column, key: str = "doc_id", name: str = "sent_no") -> DataFrame:
    """key, number, char_start, char_end of consecutive pieces of each text; only their lengths are shuffled."""
    each = df.select(key, F.posexplode(F.transform(pieces, F.char_length)).alias(name, "_len"))
    upto = Window.partitionBy(key).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = each.withColumn("char_end", F.sum("_len").over(upto).cast("int"))
    return end.select(key, name, (F.col("char_end") - F.col("_len")).alias("char_start"), "char_end")


def sentences(df: DataFrame, key: str = "doc_id", col: str = "norm") -> DataFrame:
    return spans(df, sentence_array(F.col(col)), key)


def paragraphs(df: DataFrame, key: str = "doc_id", col: str = "norm") -> DataFrame:
    """Blocks between blank lines: key, block_no, char_start, char_end on the text that joins them by newlines."""
    blocks = F.filter(F.split(col, "\n[ \\t]*\n"), lambda b: F.btrim(b, F.lit(" \t\n")) != "")
    blocks = F.transform(blocks, lambda b: F.concat(b, F.lit("\n")))
    out = spans(df, blocks, key, "block_no")
    return out.select(key, "block_no", "char_start", (F.col("char_end") - 1).alias("char_end"))


_MARKDOWN = f"^(#{{1,6}})[{SPACE}]+([^{SPACE}].*)$"
_LEGAL = f"^(PHẦN|Phần|CHƯƠNG|Chương|MỤC|Mục|Điều|PHỤ LỤC|Phụ lục)[{SPACE}]+([IVXLCDM]+|[0-9]+)(?![\\p{{L}}\\p{{N}}_])\\.?[{SPACE}]*(.*)$"


def heading_array(text: Column) -> Column:
    """(pos, level, title) of the Markdown and legal headings of a text: a fold over its lines that carries the offset."""
    levels = F.create_map(*[F.lit(x) for pair in LEGAL_LEVEL.items() for x in pair])
    kind = "array<struct<pos:int,level:int,title:string>>"
    none = F.array().cast(kind)

    def heading(pos: Column, line: Column) -> Column:
        s = F.btrim(line, F.lit(BLANKS))
        rest = F.btrim(F.regexp_extract(s, _LEGAL, 3))
        legal = F.concat(F.regexp_extract(s, _LEGAL, 1), F.lit(" "), F.regexp_extract(s, _LEGAL, 2), F.when(rest != "", F.concat(F.lit(". "), rest)).otherwise(""))
        md = F.struct(pos.alias("pos"), F.char_length(F.regexp_extract(s, _MARKDOWN, 1)).alias("level"), F.btrim(F.regexp_extract(s, _MARKDOWN, 2)).alias("title"))
        law = F.struct(pos.alias("pos"), levels[F.lower(F.regexp_extract(s, _LEGAL, 1))].alias("level"), legal.alias("title"))
        return F.when(s.rlike(_MARKDOWN), F.array(md)).when(s.rlike(_LEGAL), F.array(law)).otherwise(none).cast(kind)

    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    may = lambda line: line.rlike("[#PCMĐ]")
    step = lambda acc, line: F.struct(
        (acc["pos"] + F.char_length(line) + 1).alias("pos"),
        F.when(may(line), F.concat(acc["out"], heading(acc["pos"], line))).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["out"])


def path_array(found: Column) -> Column:
    """(pos, path) of each heading of heading_array(): the titles of it and its ancestors."""
    start = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("stack"), F.array().cast("array<struct<pos:int,path:string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        path = F.array_join(F.transform(stack, lambda x: x["title"]), " > ")
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["pos"].alias("pos"), path.alias("path")))).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def headings(df: DataFrame, key: str = "doc_id", col: str = "norm") -> DataFrame:
    """key, pos, level, title of Markdown and legal headings."""
    return df.select(key, F.inline(heading_array(F.col(col))))


def heading_paths(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, path of headings (key, pos, level, title): the titles of each and its ancestors."""
    own = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "level", "title"))).alias("_h"))
    return own.select(key, F.inline(path_array(F.col("_h"))))


def pack(units: Column, tokens: Callable[[Column], Column], max_tokens: int, tail: int) -> Column:
    """(a, b, lo) of greedy chunks of a section's units, first and last unit and first character: one fold.

    A unit that doesn't fit closes the chunk; the next one begins with the longest run of last units, none before the
    closed chunk's first, that has at most `tail` tokens. Each unit has a token at least, so that run is short.
    """
    none = F.array().cast("array<struct<a:int,b:int,lo:int>>")
    zero = lambda *names: F.struct(*[F.lit(0).alias(x) for x in names])
    sizes = F.transform(units, lambda u: F.struct(F.char_length(u).alias("len"), tokens(u).alias("n")))

    def fold(sized: Column) -> Column:
        def back(acc: Column) -> Column:
            from_ = F.greatest(acc["s"], acc["i"] - tail)
            last = F.reverse(F.slice(sized, from_ + 1, acc["i"] - from_))
            more = lambda t, u: F.when((t["open"] == 0) & (t["q"] + u["n"] <= tail), F.struct((t["k"] + 1).alias("k"), (t["q"] + u["n"]).alias("q"), (t["len"] + u["len"]).alias("len"), F.lit(0).alias("open")))
            return F.aggregate(last, zero("k", "q", "len", "open"), lambda t, u: more(t, u).otherwise(F.struct(t["k"].alias("k"), t["q"].alias("q"), t["len"].alias("len"), F.lit(1).alias("open"))))

        def step(acc: Column, u: Column) -> Column:
            full = (acc["i"] > acc["s"]) & (acc["q"] + u["n"] > max_tokens)
            moved = F.get(F.transform(F.array(back(acc)), lambda t: F.struct(
                (acc["i"] + 1).alias("i"), (acc["pos"] + u["len"]).alias("pos"), (acc["i"] - t["k"]).alias("s"), (acc["pos"] - t["len"]).alias("lo"), (t["q"] + u["n"]).alias("q"),
                F.concat(acc["out"], F.array(F.struct(acc["s"].alias("a"), (acc["i"] - 1).alias("b"), acc["lo"].alias("lo")))).alias("out"),
            )), F.lit(0))
            stays = F.struct((acc["i"] + 1).alias("i"), (acc["pos"] + u["len"]).alias("pos"), acc["s"].alias("s"), acc["lo"].alias("lo"), (acc["q"] + u["n"]).alias("q"), acc["out"].alias("out"))
            return F.when(full, moved).otherwise(stays)

        start = F.struct(*[F.lit(0).alias(x) for x in ("i", "pos", "s", "lo", "q")], none.alias("out"))
        return F.aggregate(sized, start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["s"].alias("a"), (acc["i"] - 1).alias("b"), acc["lo"].alias("lo")))))

    return F.get(F.transform(F.array(sizes), fold), F.lit(0))  # the one-element array names the sizes, worked out once


def section_array(text: Column, respect_headings: bool = True) -> Column:
    """(at, path, body) of the parts of a text that begin at its headings; the first one has no path if no heading starts it."""
    none = "array<struct<pos:int,path:string>>"

    def cut(t: Column, marks: Column) -> Column:
        first = F.array(F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("path")))
        starts = F.when(F.coalesce(F.get(marks, F.lit(0))["pos"] == 0, F.lit(False)), marks).otherwise(F.concat(first, marks))
        ends = lambda s: F.transform(s, lambda x, i: F.struct(x["pos"].alias("at"), x["path"].alias("path"), F.substring(t, x["pos"] + 1, F.coalesce(F.get(s, i + 1)["pos"], F.char_length(t)) - x["pos"]).alias("body")))
        return F.get(F.transform(F.array(starts), ends), F.lit(0))

    marks = path_array(heading_array(text)) if respect_headings else F.array().cast(none)
    # the one-element array names the headings, found once
    found = F.get(F.transform(F.array(marks), lambda m: cut(text, m)), F.lit(0))
    return F.filter(found, lambda s: s["body"] != "")


def chunks(df: DataFrame, key: str = "doc_id", col: str = "norm", max_tokens: int = 768, overlap: float = 0.15, respect_headings: bool = True, tokens: Callable[[Column], Column] = estimate_tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, chunk_index, char_start, char_end, token_count, heading_path, content of greedy chunks.

    Units are sentences of a section; a sentence over max_tokens is cut at blanks. Sections start at headings. A full
    chunk hands on its last units of at most max_tokens * overlap tokens. tokens counts those of a text column.
    Everything happens in the row of a document, numbering too: no text is shuffled or copied for each sentence.
    """
    texts = df.select(key, *keep, section_array(F.col(col), respect_headings).alias("_sections"))
    limit = max(200, int(max_tokens * 2.8))
    blank = F.lit(BLANKS)
    unit = lambda s: F.when(tokens(s) <= max_tokens, F.array(s)).otherwise(hard_split(s, limit))
    cut = lambda s: F.struct(s["at"].alias("at"), s["path"].alias("path"), F.flatten(F.transform(sentence_array(s["body"]), unit)).alias("u"))
    packed = lambda s: F.struct(s["at"].alias("at"), s["path"].alias("path"), s["u"].alias("u"), pack(s["u"], tokens, max_tokens, int(max_tokens * overlap)).alias("runs"))
    body = lambda s, r: F.array_join(F.slice(s["u"], r["a"] + 1, r["b"] - r["a"] + 1), "")
    made = lambda s: F.transform(s["runs"], lambda r: F.struct((s["at"] + r["lo"]).alias("at"), s["path"].alias("path"), body(s, r).alias("raw")))
    units = F.transform("_sections", cut)
    each = F.filter(F.flatten(F.transform(F.transform(units, packed), made)), lambda c: F.btrim(c["raw"], blank) != "")
    raw = texts.select(key, *keep, F.posexplode(each).alias("chunk_index", "_c")).select(key, *keep, "chunk_index", "_c.*")
    start = (F.col("at") + F.char_length("raw") - F.char_length(F.ltrim("raw", blank))).cast("int")
    raw = raw.select(key, *keep, "chunk_index", start.alias("char_start"), F.col("path").alias("heading_path"), F.btrim("raw", blank).alias("content"))
    return raw.select(key, *keep, "chunk_index", "char_start", (F.col("char_start") + F.char_length("content")).alias("char_end"), tokens(F.col("content")).alias("token_count"), "heading_path", "content")


def hard_split(text: Column, limit: int) -> Column:
    """Pieces of at most limit characters, each ending before its last blank in the second half if there is one."""
    half = limit // 2
    # to the end if that fits, else up to the last blank in the second half, else a full piece
    pattern = f"(?s)\\G(?:.{{1,{limit}}}\\z|.{{{half},{limit - 1}}}(?= )|.{{{limit}}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


FIXED_SIZE, FIXED_OVERLAP = 800, 120


def fixed_chunks(df: DataFrame, key: str = "doc_id", col: str = "norm", size: int = FIXED_SIZE, overlap: int = FIXED_OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of a fixed size with an overlap: the text is cut once into steps, and a window joins those that it touches."""
    step = size - overlap
    steps = F.regexp_extract_all(F.col(col), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    window = lambda i: F.substring(F.array_join(F.slice("_steps", i + 1, F.lit(1 - (-overlap // step))), ""), 1, size)
    each = df.select(key, *keep, steps.alias("_steps")).select(key, *keep, F.posexplode(F.transform("_steps", lambda _, i: window(i))).alias("_i", "content"))
    return each.select(key, *keep, (F.col("_i") * step).alias("char_start"), (F.col("_i") * step + F.char_length("content")).alias("char_end"), "content")


def chunk_document(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Chunks of assembled documents (key, full_text, pages, blocks), with page_no and bbox.

    A chunk belongs to the page on which it begins, 0 without pages; its boxes are those of the blocks that it overlaps, in
    the order of the text. Pages and boxes are joined as intervals with the places of chunks, so a chunk's row holds its own
    only; documents are written once in the shared folder, since all three are read from them.
    """
    docs, _, _ = stored(docs.select(key, "full_text", "pages", "blocks"), "documents")
    made = chunks(docs, key, "full_text", **options)
    places, _, _ = stored(made.select(key, "chunk_index", "char_start", "char_end"), "places")
    pages = docs.select(key, F.inline("pages")).select(key, F.col("start").alias("_page_at"), F.col("page").alias("page_no"))
    blocks = docs.select(key, F.inline("blocks")).filter("bbox is not null").select(key, F.col("char_start").alias("_s"), F.col("char_end").alias("_e"), F.col("bbox").alias("_box"))
    hit = overlaps(places, blocks, key, ("char_start", "char_end"), ("_s", "_e"))
    boxes = hit.groupBy(key, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("_s", "_e", "_box"))).alias("_b"))
    boxes = boxes.select(key, "chunk_index", F.transform("_b", lambda b: b["_box"]).alias("bbox"))
    paged = as_of(places.select(key, "chunk_index", "char_start"), pages, key, "char_start", "_page_at", "page_no").select(key, "chunk_index", F.coalesce("page_no", F.lit(0)).alias("page_no"))
    kind = boxes.schema["bbox"].dataType
    found, _, _ = stored(paged.join(boxes, [key, "chunk_index"], "left"), "places-found")
    return made.join(found, [key, "chunk_index"]).withColumn("bbox", F.coalesce("bbox", F.array().cast(kind)))
