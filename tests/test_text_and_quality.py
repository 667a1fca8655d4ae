import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import quality

VI = "Điều 5. Cơ sở dữ liệu quốc gia được xây dựng và quản lý theo quy định của pháp luật. Các cơ quan phải bảo đảm an toàn thông tin khi kết nối với hệ thống này. "


def norm(spark, *texts):
    rows = tx.normalized(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")).collect()
    return [r.norm for r in sorted(rows, key=lambda r: r.id)]


def test_normalize(spark):
    nfd = unicodedata.normalize("NFD", VI)
    got = norm(spark, nfd, "a\r\nb\rc", "x​­y﻿", "p q　r s", "k\x00l\x85m\tn", None, "", "ÅÅ")
    assert got == [VI, "a\nb\nc", "xy", "p q r s", "klm\tn", "", "", "ÅÅ"]
    assert norm(spark, *got) == got


def test_letters_are_built_by_rule():
    assert len(tx.VIETNAMESE) == 134 and len(set(tx.VIETNAMESE)) == 134 and len(tx.BARE) == 134
    assert "đĐữỸ"[0] in tx.VIETNAMESE and "Ỹ" in tx.VIETNAMESE and "ü" not in tx.VIETNAMESE


def test_strip_accents_and_tokens(spark):
    df = spark.createDataFrame([("Đường dữ liệu é ü",), ("",), ("abc",), ("x" * 28,)], "t string")
    rows = df.select(tx.strip_accents(F.col("t")).alias("a"), tx.estimate_tokens(F.col("t")).alias("n")).collect()
    assert [r.a for r in rows] == ["Duong du lieu e ü", "", "abc", "x" * 28] and [r.n for r in rows] == [6, 1, 1, 10]


def test_question_parts(spark):
    df = spark.createDataFrame([("cơ_sở_dữ_liệu là gì? TCVN 5945:2005 -- ./",)], "t string")
    parts = [(p.kind, p.text) for p in df.select(tx.query_parts(F.col("t")).alias("p")).first().p]
    assert parts == [("phrase", "cơ sở dữ liệu"), ("plain", "là"), ("plain", "gì"), ("plain", "TCVN"), ("plain", "5945:2005")]


@pytest.fixture(scope="module")
def graded(spark):
    bare = VI.translate(str.maketrans(tx.VIETNAMESE, tx.BARE))
    texts = {"clean": VI * 4, "stripped": bare * 4, "mojibake": (VI * 2).encode().decode("latin-1"), "tcvn3": "c¸c c¬ quan ph¶i b¶o ®¶m " * 20, "english": "The board met on Monday and agreed to publish the annual report in full. " * 10, "empty": "", "broken": "text ��� " * 9, "none": None}
    rows = quality.assess(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_gate_on_kinds_of_text(graded):
    assert graded["clean"].score >= 0.85 and graded["english"].score >= 0.85
    assert graded["stripped"].score < 0.60 and graded["mojibake"].score < 0.60 and graded["tcvn3"].score <= 0.10
    assert graded["clean"].looks_vietnamese and not graded["english"].looks_vietnamese and graded["tcvn3"].legacy_encoding == "tcvn3"
    assert graded["empty"].score == 0 == graded["none"].score and graded["empty"].issues == ["empty"]
    assert "lost_diacritics" in graded["stripped"].issues and "replacement_chars" in graded["broken"].issues
    assert graded["clean"].usable and not graded["tcvn3"].usable and graded["clean"].route == "index" and graded["stripped"].route == "ocr"
