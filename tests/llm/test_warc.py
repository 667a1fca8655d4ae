import hashlib
import zlib

from docloom.llm import files, warc


def pages(spark):
    big, other = "<p>" + "long page é " * 200, "<p>" + "another 日本 " * 200
    rows = [(1, "http://www.A.example.org:80/x?q=1#f", big), (5, "https://b.example.net/y", big), (3, "http://a.example.org/x?q=1", big), (2, "http://c.org", "short"), (4, "http://d.org/", "short"), (6, None, None), (7, "", ""), (8, "not a url at all", other), (None, "http://n.org/", big), (9, "http://a.example.org/x?q=1", other), (9, "http://a.example.org/x?q=1", other)]
    rows += [(100 + i, f"http://h{i % 7}.example.com/p/{i:03d}", f"page {i} " * 30) for i in range(200)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").repartition(4), rows


def plain(rows):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and i is not None and i < best[h or ""]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best[h or ""] if revisit else None))
    return sorted(out, key=str)


def test_archives_match_brute_force(spark):
    df, rows = pages(spark)
    table = warc.write_archives(df, lines=16)
    assert sorted((tuple(r) for r in warc.read_archives(table).collect()), key=str) == plain(rows)
    assert sorted((tuple(r) for r in warc.read_by_key(table, df).collect()), key=str) == plain(rows)
    assert warc.read_by_key(warc.write_archives(df.limit(0)), df).count() == 0
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_lookup_finds_all_captures_of_a_key(spark):
    df, rows = pages(spark)
    table = warc.write_archives(df, lines=8)
    asked = spark.createDataFrame([("http://a.example.org/x?q=1",), ("http://h3.example.com/p/003",), ("http://nowhere.org/",), (None,)], "url string")
    got = {}
    for r in warc.lookup(table, asked).collect():
        got.setdefault(r.url, []).append(r)
    assert sorted(r.page_id for r in got["http://a.example.org/x?q=1"]) == [1, 3, 9, 9]
    assert {r.page_id: r.record_type for r in got["http://a.example.org/x?q=1"]} == {1: "revisit", 3: "revisit", 9: "response"}
    assert [(r.page_id, r.payload) for r in got["http://h3.example.com/p/003"]] == [(103, "page 3 " * 30)]
    assert "http://nowhere.org/" not in got


def test_archive_is_plain_warc(spark):
    df, rows = pages(spark)
    types = 0
    for f in warc.write_archives(df).collect():
        raw = files.open_range(f.warc).read()
        while raw:
            z = zlib.decompressobj(31)
            record = z.decompress(raw)
            raw = z.unused_data
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            head = record.partition(b"\r\n\r\n")[0].decode().split("\r\n")
            types += any(h.startswith("WARC-Type: ") for h in head) and any(h.startswith("Content-Length: ") for h in head)
    assert types == len(rows)


def test_a_key_of_a_third_of_all_captures(spark):
    """One address in many blocks and files: each capture comes back once, whatever file it lies in."""
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{i % 50}.example/{i}", f"<p>{i}</p>") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    table = warc.write_archives(df, lines=7)
    got = warc.read_by_key(table, df).collect()
    assert sorted(r.page_id for r in got) == list(range(900))
    assert sorted(r.page_id for r in warc.read_by_key(table, df.filter("page_id < 2")).collect()) == sorted([1, *range(0, 900, 3)])
