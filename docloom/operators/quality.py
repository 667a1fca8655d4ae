"""Quality gate of extracted text: signals, score, routing. One projection over normalized text, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import BLANKS, SPACE, VIETNAMESE, WORD, normalized, sql_bare, sql_norm, strip_accents

# Function words without accents; thresholds of the gate.
FUNCTION_WORDS = (
    "cua va la trong duoc co khong cho den tu voi nhung nay do khi neu thi ma cac mot "
    "nguoi phai se da dang cung theo tren duoi truoc sau tai ve boi vi nen ra vao"
).split()
MOJIBAKE = "Ã[\u0080-¿]|Â[ -¿]|á»|Æ°|áº"
ENTITY = "&(?:[a-zA-Z]{2,10}|#[0-9]{2,5}|#x[0-9a-fA-F]{2,6});"
LETTER_WORD = "[\\p{L}\\p{Nl}\\p{No}]+"
LEGACY_SHARE, MIN_QUALITY = 0.15, 0.60


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _tokens_with(text: Column, chars: str) -> Column:
    """How many tokens between white space hold one of chars: the first such character of a token takes its rest along."""
    return _count(text, f"[{chars}][^{SPACE}]*+")


def signals(df: DataFrame, key: str = "doc_id", col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and ratios of each text, with the columns of keep; empty texts get zeros."""
    t = F.col("norm")
    trimmed = F.btrim(t, F.lit(BLANKS))
    digit_runs = F.regexp_extract_all(t, F.lit(f"(?<![{WORD}])[{WORD}&&[^\\p{{Nd}}]]*+\\p{{Nd}}[{WORD}]*+"), F.lit(0))
    out = normalized(df.select(key, col, *keep), col).withColumns({
        "char_count": F.char_length(t).cast("long"),
        "letters": F.char_length(F.regexp_replace(t, "\\P{L}+", "")).cast("long"),
        "marked": (F.char_length(t) - F.char_length(F.translate(t, VIETNAMESE, ""))).cast("long"),
        "words": _count(t, LETTER_WORD),
        "bare_words": F.regexp_extract_all(F.lower(strip_accents(t)), F.lit(LETTER_WORD), F.lit(0)),
        "loose": F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(f"[{SPACE}]+")) + 1).cast("long"),
        "tcvn3": _tokens_with(t, "¡-¿"),
        "vni": _tokens_with(t, "ñöøÑÖØ"),
        "mojibake": F.when(t.rlike("[ÃÂáÆ]"), _count(t, MOJIBAKE)).otherwise(F.lit(0).cast("long")),
        "replaced": (F.char_length(t) - F.char_length(F.translate(t, "\ufffd", ""))).cast("long"),
        "html_entity_count": F.when(F.contains(t, F.lit("&")), _count(t, ENTITY)).otherwise(F.lit(0).cast("long")),
        "weird": F.size(F.filter(digit_runs, lambda w: (F.char_length(w) >= 4) & w.rlike("[a-zA-ZÀ-ỹ]"))).cast("long"),
    })
    n = F.col("char_count")
    function = F.size(F.filter("bare_words", lambda w: w.isin(FUNCTION_WORDS))).cast("long")
    legacy = lambda c: _share(F.col(c), F.col("loose")) >= LEGACY_SHARE
    return out.select(
        key,
        *keep,
        n,
        _share(F.col("letters"), n).alias("letter_ratio"),
        ((_share(function, F.size("bare_words")) >= 0.04) & (F.size("bare_words") >= 20)).alias("looks_vietnamese"),
        _share(F.col("marked"), F.col("letters")).alias("diacritic_ratio"),
        F.when(legacy("tcvn3"), "tcvn3").when(legacy("vni"), "vni").alias("legacy_encoding"),
        _share(F.col("mojibake"), n).alias("mojibake_ratio"),
        _share(F.col("replaced"), n).alias("replacement_ratio"),
        "html_entity_count",
        _share(F.col("weird"), F.col("words")).alias("weird_alnum_ratio"),
    )


def score() -> Column:
    """The score of a row of signals, 0 to 1."""
    c = F.col
    penalty = (
        F.least(F.lit(0.45), c("mojibake_ratio") * 300)
        + F.least(F.lit(0.30), c("replacement_ratio") * 400)
        + F.least(F.lit(0.20), F.greatest(F.lit(0.0), c("weird_alnum_ratio") - 0.02) * 4)
        + F.greatest(F.lit(0.0), 0.35 - c("letter_ratio")) * 1.2
        + F.when(c("looks_vietnamese") & (c("diacritic_ratio") < 0.03), 0.55).when(c("looks_vietnamese") & (c("diacritic_ratio") < 0.08), 0.25).otherwise(0.0)
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty))
    return F.when(c("char_count") == 0, 0.0).when(c("legacy_encoding").isNotNull(), 0.05).when(c("replacement_ratio") > 0.02, 0.10).otherwise(clamped)


def issues() -> Column:
    """Stable codes of what is wrong with a row of signals."""
    c = F.col
    found = [
        (c("char_count") == 0, "empty"), (c("legacy_encoding") == "tcvn3", "legacy_tcvn3"), (c("legacy_encoding") == "vni", "legacy_vni"), (c("mojibake_ratio") > 0.001, "mojibake"),
        (c("replacement_ratio") > 0, "replacement_chars"), (c("html_entity_count") > 3, "html_entities"), (c("weird_alnum_ratio") > 0.03, "mixed_alnum"),
        (c("looks_vietnamese") & c("legacy_encoding").isNull() & (c("diacritic_ratio") < 0.03), "lost_diacritics"), ((c("char_count") > 0) & (c("letter_ratio") < 0.35), "few_letters"),
    ]
    return F.array_compact(F.array(*[F.when(when, code) for when, code in found]))


def assess(df: DataFrame, key: str = "doc_id", col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Signals, score, issues, usable and where the gate sends the text (index or ocr)."""
    usable = F.col("legacy_encoding").isNull() & (F.col("replacement_ratio") < 0.01)
    return signals(df, key, col, keep).withColumns({"score": score(), "issues": issues(), "usable": usable}).withColumn("route", F.when(F.col("score") < MIN_QUALITY, "ocr").otherwise("index"))


_LOOSE = "regexp_extract_all(t, '[^ \\t\\n\\x{2028}\\x{2029}]+')"
_BARE = f"regexp_extract_all(lower({sql_bare('t')}), '{LETTER_WORD}')"
_N = "nullif(length(t), 0)"
SQL_SIGNALS = f"""
    SELECT doc_id, length(t) AS char_count,
        coalesce(len(regexp_extract_all(t, '\\p{{L}}')) / {_N}::DOUBLE, 0) AS letter_ratio,
        coalesce(len(list_filter({_BARE}, lambda w: list_contains({FUNCTION_WORDS}, w))) / nullif(len({_BARE}), 0)::DOUBLE, 0) >= 0.04 AND len({_BARE}) >= 20 AS looks_vietnamese,
        coalesce(len(regexp_extract_all(t, '[{VIETNAMESE}]')) / nullif(len(regexp_extract_all(t, '\\p{{L}}')), 0)::DOUBLE, 0) AS diacritic_ratio,
        CASE WHEN len(list_filter({_LOOSE}, lambda w: regexp_matches(w, '[¡-¿]'))) / nullif(len({_LOOSE}), 0)::DOUBLE >= 0.15 THEN 'tcvn3'
             WHEN len(list_filter({_LOOSE}, lambda w: regexp_matches(w, '[ñöøÑÖØ]'))) / nullif(len({_LOOSE}), 0)::DOUBLE >= 0.15 THEN 'vni' END AS legacy_encoding,
        coalesce(len(regexp_extract_all(t, 'Ã[\\x{{80}}-\\x{{bf}}]|Â[\\x{{a0}}-\\x{{bf}}]|á»|Æ°|áº')) / {_N}::DOUBLE, 0) AS mojibake_ratio,
        coalesce((length(t) - length(replace(t, chr(65533), ''))) / {_N}::DOUBLE, 0) AS replacement_ratio,
        CAST(len(regexp_extract_all(t, '{ENTITY}')) AS BIGINT) AS html_entity_count,
        coalesce(len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{4,}}'), lambda w: regexp_matches(w, '[a-zA-ZÀ-ỹ]') AND regexp_matches(w, '\\p{{Nd}}')))
            / nullif(len(regexp_extract_all(t, '{LETTER_WORD}')), 0)::DOUBLE, 0) AS weird_alnum_ratio
    FROM (SELECT doc_id, {sql_norm()} AS t FROM documents)"""
SQL_ASSESS = f"""
    WITH s AS ({SQL_SIGNALS}),
    p AS (SELECT *, CASE WHEN char_count = 0 THEN 0.0::DOUBLE WHEN legacy_encoding IS NOT NULL THEN 0.05::DOUBLE WHEN replacement_ratio > 0.02 THEN 0.10::DOUBLE ELSE
        greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (least(0.45::DOUBLE, mojibake_ratio * 300) + least(0.30::DOUBLE, replacement_ratio * 400) + least(0.20::DOUBLE, greatest(0.0::DOUBLE, weird_alnum_ratio - 0.02::DOUBLE) * 4)
            + greatest(0.0::DOUBLE, 0.35::DOUBLE - letter_ratio) * 1.2::DOUBLE
            + CASE WHEN looks_vietnamese AND diacritic_ratio < 0.03 THEN 0.55::DOUBLE WHEN looks_vietnamese AND diacritic_ratio < 0.08 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END))) END AS score FROM s)
    SELECT *, CASE WHEN score < 0.60 THEN 'ocr' ELSE 'index' END AS route, legacy_encoding IS NULL AND replacement_ratio < 0.01 AS usable FROM p"""
