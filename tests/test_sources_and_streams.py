from pathlib import Path

from pyspark.sql import functions as F

from docloom.sources import extract, plain
from docloom.streaming import windows


def test_plain_files(spark, tmp_path):
    vi = "Đường phố Hà Nội có nhiều cây xanh. " * 5
    for name, raw in {"a.txt": ("﻿một\r\n\r\nhai\n \nba " + vi).encode(), "b.md": b" \n", "c.txt": "café déjà vu ".encode("cp1252") * 9, "d.bin": b"\x00", "e.txt": b"\x80\xff\x81\x8d" * 3}.items():
        (tmp_path / name).write_bytes(raw)
    docs, blocks = plain.read_plain(spark, str(tmp_path))
    got = {Path(r.path).name: r for r in docs.collect()}
    assert got["a.txt"].method == "plain:utf-8-sig" and got["a.txt"].norm.startswith("một\n\nhai\n \nba ")
    assert got["b.md"].error_code == "TEXT_EMPTY" and got["d.bin"].error_code == "KIND_UNSUPPORTED"
    assert got["c.txt"].method in ("plain:cp1258", "plain:cp1252") and "caf" in got["c.txt"].norm and len(got) == 5
    text = "\n".join(["một", "hai"])
    first = {r.block_no: text[r.char_start : r.char_end] for r in blocks.filter(F.col("path").endswith("a.txt")).collect() if r.block_no < 2}
    assert first == {0: "một", 1: "hai"}


def test_blocks_keep_their_offsets(spark):
    box = lambda p, y: (p, 72.0, float(y), 300.0, float(y + 10))
    rows = [(1, 1, 0, "second block", box(1, 50)), (1, 1, 1, "first", box(1, 10)), (1, 2, 0, "  ", box(2, 5)), (1, 3, 0, "third", None), (2, 1, 0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_no int, text string, bbox struct<page:int,x0:double,y0:double,x1:double,y1:double>")
    got = {r.doc_id: r for r in extract.assemble(df).collect()}
    assert got[1].full_text == "first\nsecond block\n\nthird\n" and got[2].full_text == "\n" and got[1].page_count == 3
    assert [got[1].full_text[b.char_start : b.char_end] for b in got[1].blocks] == ["first", "second block", "third"]
    assert [(p.page, p.start, p.end) for p in got[1].pages] == [(1, 0, 19), (2, 19, 20), (3, 20, 26)]
    out = extract.assemble(df).filter("doc_id = 1").select(*[extract.page_of(F.col("pages"), F.lit(k)).alias(f"p{k}") for k in (0, 19, 25, 99)], F.size(extract.bboxes_for(F.col("blocks"), F.lit(3), F.lit(8))).alias("n")).first()
    assert tuple(out) == (1, 2, 3, 3, 2)


def test_styles_and_tables(spark):
    styles = {"Heading 2": "## t", "Title": "# t", "heading 9": "###### t", "List Bullet 2": "- t", "Normal": "t", None: "t", "Heading": "# t", " Tiêu đề chính ": "# t", "đầu đề 2": "## t", "Tiêu đề 3": "### t", "đề mục 3": "t", "Heading Char": "# t", "Subtitle": "t", "Danh sách 1": "- t"}
    df = spark.createDataFrame([(s, "t") for s in styles], "s string, t string")
    assert [r[0] for r in df.select(extract.styled(F.col("s"), F.col("t"))).collect()] == list(styles.values())
    rows = spark.createDataFrame([(1, 0, 0, ["a", "b\nc"]), (1, 0, 1, ["", None]), (1, 0, 2, ["d", ""])], "doc_id long, table_no int, row_no int, cells array<string>")
    assert extract.table_markdown(rows).first().text == "| a | b c |\n| --- | --- |\n| d |  |"
    pages = spark.createDataFrame([(1, 1, ""), (1, 2, "x"), (1, 3, "y" * 200), (2, 1, "z" * 200)], "doc_id long, page int, text string")
    assert {r.doc_id: r.is_scanned for r in extract.scanned(pages).collect()} == {1: True, 2: False}


def test_ingest_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"Câu một của tài liệu {i}. Câu hai nói thêm. " * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows.ingest(stream, lambda c, epoch: c.write.mode("append").parquet(out), str(tmp_path / "ck")).awaitTermination(120)
    from docloom.functions.text import normalized
    from docloom.operators import segments

    want = segments.chunks(normalized(df))
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_quota_stream_equals_batch(spark):
    from docloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    batch = catalog.QUERIES["daily_quota"](spark, sf).select("user_id", "day", "calls")
    assert sorted(map(tuple, catalog.QUERIES["daily_quota_stream"](spark, sf).collect())) == sorted(map(tuple, batch.collect()))


def test_quota_stream_leaves_its_rows_in_files(spark):
    from docloom.plans import catalog

    out = catalog.QUERIES["daily_quota_stream"](spark, "/root/testdata/sf0.001")
    assert out.inputFiles() and out.count() > 0
