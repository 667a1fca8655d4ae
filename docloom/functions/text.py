"""Text expressions: normalization, accents, tokens. All but NFC run inside the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What normalization drops or turns into a space.
INVISIBLE = "​‌‍⁠﻿­"
ODD_SPACES = "[   -   　]"
CONTROLS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"
#: White space that can be left in normalized text, and words (letters, numbers, underscore), as class members.
SPACE = " \\t\\n  "
WORD = "\\p{L}\\p{N}_"
#: The same white space as plain characters.
BLANKS = SPACE.replace("\\t", "\t").replace("\\n", "\n")
#: Characters that NFC may change; texts without any skip the Python step. Outside are U+0000-02FF, U+1E00-1EF9,
#: U+2010-2027 and U+20AC. (A class of what is inside is matched many times faster than one of what is not.)
UNSTABLE = "[\\u0300-\\u1dff\\u1efa-\\u200f\\u2028-\\u20ab\\u20ad-\\x{10ffff}]"
#: Of those, the characters that can make NFC change a text: marks, what composes with the character before, and characters
#: that stand for others. Letters of other scripts are none; what this
#: Java doesn't know yet may be a mark.
CHANGEABLE = (
    "[\\p{M}\\p{Cn}\\u0374\\u037e\\u0387\\u0958-\\u095f\\u09dc-\\u09df\\u0a33-\\u0a5e\\u0b5c\\u0b5d\\u0f43-\\u0fb9\\u1160-\\u11ff\\u1f71-\\u1ffd"
    "\\u2000\\u2001\\u2126-\\u212b\\u2329\\u232a\\u2adc\\uf900-\\ufaff\\ufb1d-\\ufb4e\\x{1d15e}-\\x{1d1c0}\\x{2f800}-\\x{2fa1f}]"
)


def _vietnamese() -> str:
    """Vowels with their marks and tones, and d with stroke, in both cases, by composition."""
    tones = ["", "̀", "̉", "̃", "́", "̣"]
    lower = [unicodedata.normalize("NFC", v + t) for v in "aăâeêioôơuưy" for t in tones] + ["đ"]
    kept = [c for c in lower if not c.isascii()]
    return "".join(kept + [c.upper() for c in kept])


VIETNAMESE = _vietnamese()
BARE = "".join({"đ": "d", "Đ": "D"}.get(c, unicodedata.normalize("NFD", c)[0]) for c in VIETNAMESE)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _changed() -> tuple[str, str]:
    """The characters that normalization turns into a space or drops, and the spaces for the first of them."""
    spaces = re.sub("(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), ODD_SPACES[1:-1])
    controls = "".join(chr(c) for c in (*range(9), 11, 12, *range(14, 32), *range(127, 160)))
    return spaces + controls + INVISIBLE, " " * len(spaces)


def prepared(text: Column) -> Column:
    """All steps of normalization before NFC; null becomes empty. One look at a text tells whether it needs any."""
    t = F.coalesce(text, F.lit(""))
    lines = F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, "\r\n?", "\n")).otherwise(t)
    return F.when(t.rlike(f"[\r{CONTROLS[1:-1]}{INVISIBLE}{ODD_SPACES[1:-1]}]"), F.translate(lines, *_changed())).otherwise(t)


def normalized(df: DataFrame, col: str = "text", out: str = "norm") -> DataFrame:
    """df with its text in normal form. Only rows with characters that NFC may change go through Python; which these
    are is seen on the raw text, so that each row is prepared once."""
    odd = F.coalesce(F.col(col).rlike(UNSTABLE) & F.col(col).rlike(CHANGEABLE), F.lit(False))
    ready = prepared(F.col(col))
    return df.filter(~odd).withColumn(out, ready).unionByName(df.filter(odd).withColumn(out, nfc(ready)))


def is_normalized(text: Column, norm: Column) -> Column:
    """Whether a text is its own normal form."""
    return text.isNotNull() & (text == norm)


def strip_accents(norm: Column) -> Column:
    """Vietnamese letters to their base letters, one for one; other accents stay."""
    return F.translate(norm, VIETNAMESE, BARE)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / F.lit(2.8)).cast("int"))


def lexemes(norm: Column) -> Column:
    """Lower-case words without accents, in order."""
    return F.regexp_extract_all(F.lower(strip_accents(norm)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def query_parts(norm: Column) -> Column:
    """Parts (kind, text) of a question: compounds joined by _ are phrases, other words plain."""
    cleaned = F.regexp_replace(norm, f"[^{WORD}{SPACE}:.\\-/]", " ")
    tokens = F.transform(F.split(cleaned, f"[{SPACE}]+"), lambda t: F.regexp_replace(t, "^[_\\-:./]+|[_\\-:./]+$", ""))
    part = lambda t: F.struct(F.when(t.contains("_"), "phrase").otherwise("plain").alias("kind"), F.translate(t, "_", " ").alias("text"))
    return F.transform(F.filter(tokens, lambda t: t != ""), part)


# The same steps in DuckDB SQL, for checks.
SQL_NORM = (
    "nfc_normalize(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({t}, ''), '\\r\\n|\\r', chr(10), 'g'), "
    "'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{2060}}\\x{{feff}}\\x{{ad}}]', '', 'g'), "
    "'[\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g'))"
)
SQL_BARE = f"translate({{t}}, '{VIETNAMESE}', '{BARE}')"
SQL_TOKENS = "greatest(1, CAST(floor(length({t}) / 2.8::DOUBLE) AS INTEGER))"


def sql_norm(t: str = "text") -> str:
    return SQL_NORM.format(t=t)


def sql_bare(t: str) -> str:
    return SQL_BARE.format(t=t)


def sql_tokens(t: str) -> str:
    return SQL_TOKENS.format(t=t)
