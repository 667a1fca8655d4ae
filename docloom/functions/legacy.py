"""Texts in the codes of old Vietnamese fonts, read as Latin-1, back to Unicode."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import normalized
from docloom.operators import quality
from docloom.sources.shared import stored

TONES = ["", "̀", "̉", "̃", "́", "̣"]
# The codes of TCVN 5712:1993 (VN1) for each vowel without a tone and with grave, hook, tilde, acute and dot below.
TCVN3 = {
    "a": "61 b5 b6 b7 b8 b9", "ă": "a8 bb bc bd be c6", "â": "a9 c7 c8 c9 ca cb",
    "e": "65 cc ce cf d0 d1", "ê": "aa d2 d3 d4 d5 d6", "i": "69 d7 d8 dc dd de",
    "o": "6f df e1 e2 e3 e4", "ô": "ab e5 e6 e7 e8 e9", "ơ": "ac ea eb ec ed ee",
    "u": "75 ef f1 f2 f3 f4", "ư": "ad f5 f6 f7 f8 f9", "y": "79 fa fb fc fd fe",
    "A": "41 80 81 82 83 84", "Ă": "a1 af ba bf c0 85", "Â": "a2 c1 c2 c3 c4 86",
    "E": "45 87 88 89 8a 8b", "Ê": "a3 c5 cd d9 da 8c", "I": "49 8d 8e 8f 90 91",
    "O": "4f 92 93 94 95 96", "Ô": "a4 db e0 f0 ff 97", "Ơ": "a5 98 99 9a 9b 9c",
    "U": "55 9d 9e 9f 01 02", "Ư": "a6 04 05 06 11 12", "Y": "59 13 14 15 16 17",
}
TCVN3_D = {"đ": "ae", "Đ": "a7"}
# VNI writes a vowel and a sign after it for the tone, for the tone with a circumflex, or with a breve; some
# letters have a code of one character. Upper case is the same in upper case.
VNI_TONES = {"̀": "ø", "̉": "û", "̃": "õ", "́": "ù", "̣": "ï"}
VNI_CIRCUMFLEX = {"": "â", "̀": "à", "̉": "å", "̃": "ã", "́": "á", "̣": "ä"}
VNI_BREVE = {"": "ê", "̀": "è", "̉": "ú", "̃": "ü", "́": "é", "̣": "ë"}
VNI_SINGLE = {"ơ": "ô", "ư": "ö", "đ": "ñ", "í": "í", "ì": "ì", "ỉ": "æ", "ĩ": "ó", "ị": "ò", "ỵ": "î"}


def _tcvn3() -> dict[str, str]:
    """The code of each letter that isn't ASCII."""
    out = {k: bytes.fromhex(v).decode("latin-1") for k, v in TCVN3_D.items()}
    for vowel, codes in TCVN3.items():
        for tone, code in zip(TONES, codes.split(), strict=True):
            letter = unicodedata.normalize("NFC", vowel + tone)
            if not letter.isascii():
                out[letter] = bytes.fromhex(code).decode("latin-1")
    return out


def _vni() -> dict[str, str]:
    """The code of each letter: two characters, or one."""
    out = dict(VNI_SINGLE)
    for vowels, signs, mark in (("aeouyơư", VNI_TONES, ""), ("aeo", VNI_CIRCUMFLEX, "̂"), ("a", VNI_BREVE, "̆")):
        for v in vowels:
            for tone, sign in signs.items():
                out.setdefault(unicodedata.normalize("NFC", v + mark + tone), VNI_SINGLE.get(v, v) + sign)
    return out | {k.upper(): v.upper() for k, v in out.items()}


TO_TCVN3, TO_VNI = _tcvn3(), _vni()


def from_tcvn3(text: Column) -> Column:
    return F.translate(text, "".join(TO_TCVN3.values()), "".join(TO_TCVN3))


def to_tcvn3(text: Column) -> Column:
    """Its opposite, for letters that the code has."""
    return F.translate(text, "".join(TO_TCVN3), "".join(TO_TCVN3.values()))


def _from_vni() -> dict[str, str]:
    """The letter of each pair of a vowel and a sign."""
    one = VNI_SINGLE | {k.upper(): v.upper() for k, v in VNI_SINGLE.items()}
    base = {v: k for k, v in one.items()}
    out = {}
    for vowels, signs, mark in (("aeouyAEOUYôöÔÖ", VNI_TONES, ""), ("aeoAEO", VNI_CIRCUMFLEX, "̂"), ("aA", VNI_BREVE, "̆")):
        for v in vowels:
            for tone, sign in signs.items():
                letter = unicodedata.normalize("NFC", base.get(v, v) + mark + tone)
                out[v + sign] = out[v + sign.upper()] = letter
    return out


FROM_VNI = _from_vni()
_PAIR = re.compile(f"[{''.join(sorted({k[0] for k in FROM_VNI}))}][{''.join(sorted({k[1] for k in FROM_VNI}))}]")
_ONE = str.maketrans({v: k for k, v in (VNI_SINGLE | {k.upper(): v.upper() for k, v in VNI_SINGLE.items()}).items()})
_CODES = str.maketrans(TO_VNI)


@F.pandas_udf(T.StringType())
def _vni_decoded(s: pd.Series) -> pd.Series:
    # a sign is never a vowel, so pairs can't overlap; what they become is marked off from codes of one character by the order
    pair = lambda m: FROM_VNI.get(m[0]) or m[0].translate(_ONE)

    def decoded(t: str) -> str:
        out, at = [], 0
        for m in _PAIR.finditer(t):
            out += [t[at : m.start()].translate(_ONE), pair(m)]
            at = m.end()
        return "".join([*out, t[at:].translate(_ONE)])

    return s.map(decoded, na_action="ignore")


@F.pandas_udf(T.StringType())
def _vni_encoded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t.translate(_CODES), na_action="ignore")


def from_vni(text: Column) -> Column:
    """Pairs of a vowel and a sign, and codes of one character, in one pass over a text."""
    return _vni_decoded(text)


def to_vni(text: Column) -> Column:
    """Its opposite, for composed letters."""
    return _vni_encoded(text)


def transcoded(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, legacy_encoding, norm: texts that the quality gate takes for TCVN3 or VNI in Unicode, all in normal form.

    The gate looks at the text as it is; decoding comes before normalization, which would drop codes that are controls
    or soft hyphens. A text that isn't in an old code stays as it is; null becomes empty. Decoded texts are written once
    in the shared folder: normalization looks at a text often, and would have it graded and decoded each time.
    """
    t = F.coalesce(F.col(col), F.lit(""))
    graded = quality.signals(df.select(key, t.alias(col), t.alias("_raw")), key, col, keep=("_raw",))
    raw = F.col("_raw")
    text = F.when(F.col("legacy_encoding") == "tcvn3", from_tcvn3(raw)).when(F.col("legacy_encoding") == "vni", from_vni(F.when(F.col("legacy_encoding") == "vni", raw))).otherwise(raw)
    decoded, _, _ = stored(graded.select(key, "legacy_encoding", text.alias("_text")), "decoded")
    return normalized(decoded, "_text", "norm").select(key, "legacy_encoding", "norm")
