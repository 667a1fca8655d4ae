import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import segments

SAMPLES = [
    "", "   ", "One. Two! Three?", "TS. Nguyễn Văn A. đã đến. Ông gặp PGS. Trần.", "Mục 5. 2 là số. TCVN 5945:2005 quy định. v.v. Hết.", "dòng một.\nDòng hai.\n\nDòng ba…  \"Bốn\" (Năm). – Sáu",
    "no end here", "Điều 3.\nNội dung. chữ thường. Q. 5 là quận. Xong?! Vâng.", "Nguyễn V. A. Bình. Kết. 1.000.000 đồng. Hết.",
]


def plain_sentences(t):
    """The rule read from its description, one candidate after the other."""
    import re

    cuts = [0]
    for m in re.finditer("([.!?…]+)([\"'”’)\\]]*)([ \t\n  ]+)", t):
        before, after = t[: m.start()], t[m.end() :]
        if not after:
            continue
        prev = re.search("([^\\s.]+)\\.?$", before)
        token = prev.group(1) if prev else ""
        if token.lower() in segments.ABBREVIATIONS or (len(token) == 1 and token.isalpha()):
            continue
        if before[-1:].isdigit() and after[0].isdigit():
            continue
        if after[0].isupper() or after[0].isdigit() or after[0] in "\"'“‘(-–—•":
            cuts.append(m.end())
    return [t[a:b] for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True) if a < b]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, norm string")


def test_sentences_match_the_rule_and_cover_the_text(spark):
    rnd = random.Random(0)
    parts = ["TS", "A", "từ", "Xin", "12", "5", ".", "!", "…", " ", "\n", "\"", ")", "(", "-", "vd", "Hà Nội", "tp", "chữ"]
    texts = SAMPLES + ["".join(rnd.choice(parts) + rnd.choice(["", " ", ". ", "! "]) for _ in range(rnd.randint(1, 25))) for _ in range(3000)] + ["tp\n. 5A", "tp.\n. 5A", "x\n! Có", "v.v. Và", "v.v\n. Và"]
    rows = frame(spark, texts).select("doc_id", segments.sentence_array(F.col("norm")).alias("s")).collect()
    got = {r.doc_id: r.s for r in rows}
    for i, t in enumerate(texts):
        assert "".join(got[i]) == t
    assert [t for i, t in enumerate(texts) if got[i] != plain_sentences(t)] == []
    spans = segments.sentences(frame(spark, SAMPLES)).collect()
    assert all(SAMPLES[r.doc_id][r.char_start : r.char_end] == got[r.doc_id][r.sent_no] for r in spans)


def plain_chunks(t, max_tokens, ratio):
    count = lambda s: max(1, int(len(s) / 2.8))
    limit, units = max(200, int(max_tokens * 2.8)), []
    at = 0
    for s in plain_sentences(t):
        a, end = at, at + len(s)
        at = end
        if count(s) <= max_tokens:
            units.append((a, end))
            continue
        while a < end:
            stop = min(a + limit, end)
            if stop < end and (b := t.rfind(" ", a + limit // 2, stop)) > a:
                stop = b
            units.append((a, stop))
            a = stop
    out, held = [], []
    size = lambda us: sum(count(t[a:b]) for a, b in us)
    for u in units:
        if held and size(held) + count(t[u[0] : u[1]]) > max_tokens:
            out.append((held[0][0], held[-1][1]))
            k = len(held)
            while k and size(held[k - 1 :]) <= int(max_tokens * ratio):
                k -= 1
            held = held[k:]
        held.append(u)
    if held:
        out.append((held[0][0], held[-1][1]))
    trimmed = [(a + len(t[a:b]) - len(t[a:b].lstrip()), t[a:b].strip()) for a, b in out]
    return [(a, a + len(c), c) for a, c in trimmed if c]


@pytest.mark.parametrize(("max_tokens", "ratio"), [(60, 0.15), (60, 0.5), (300, 0.0)])
def test_chunks_match_a_plain_walk(spark, max_tokens, ratio):
    rnd = random.Random(1)
    texts = ["", " \n ", "A" * 5000, "Một câu ngắn."] + [" ".join("Từ " + "xy" * rnd.randint(1, 60) + rnd.choice([".", ",", "!"]) for _ in range(rnd.randint(1, 60))) for _ in range(25)]
    rows = segments.chunks(frame(spark, texts), max_tokens=max_tokens, overlap=ratio, respect_headings=False).orderBy("doc_id", "chunk_index").collect()
    for i, t in enumerate(texts):
        assert [(r.char_start, r.char_end, r.content) for r in rows if r.doc_id == i] == plain_chunks(t, max_tokens, ratio), t[:80]
        assert all(t[r.char_start : r.char_end] == r.content for r in rows if r.doc_id == i)


def test_headings_and_paths(spark):
    t = "mở đầu\n# Một\nthân một.\n## Hai  \n\nChương II. Quy định\nĐiều 5. Phạm vi\nnội dung\n### Ba\n# Bốn"
    rows = segments.headings(frame(spark, [t]))
    assert [(r.level, r.title) for r in rows.orderBy("pos").collect()] == [(1, "Một"), (2, "Hai"), (2, "Chương II. Quy định"), (4, "Điều 5. Phạm vi"), (3, "Ba"), (1, "Bốn")]
    assert [r.path for r in segments.heading_paths(rows).orderBy("pos").collect()] == ["Một", "Một > Hai", "Một > Chương II. Quy định", "Một > Chương II. Quy định > Điều 5. Phạm vi", "Một > Chương II. Quy định > Ba", "Bốn"]
    chunks = segments.chunks(frame(spark, [t])).orderBy("chunk_index").collect()
    assert [c.heading_path for c in chunks] == [None, "Một", "Một > Hai", "Một > Chương II. Quy định", "Một > Chương II. Quy định > Điều 5. Phạm vi", "Một > Chương II. Quy định > Ba", "Bốn"]
    assert all(t[c.char_start : c.char_end] == c.content for c in chunks) and [c.chunk_index for c in chunks] == list(range(7))
