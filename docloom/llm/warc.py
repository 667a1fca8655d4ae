"""WARC archives with a two-level capture index.

Captures are ranged by their reversed-host key. Each task writes one archive (a gzip member for each record) and one
index file: the sorted index lines of its captures in compressed blocks, then a sparse directory with the first key
and the place of each block. The table of files, with their first and last keys, is the level above. A lookup
searches the table, then the directory, then the block, each by bisection, and reads the record's byte range.
Records with equal payloads of some size are written once and revisited by the others.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import files
from docloom.llm.shared import as_text, fresh_path, read, written

#: Payloads under this many bytes are always written; index lines of a block; most files whose table is searched in a task.
SMALL, BLOCK_LINES, MOST_FILES = 1000, 1000, 1_000_000
MAGIC = b"DLCDX1\0\0"
#: The profile that the WARC standard names for equal payloads, and a date for pages that have none.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """http://www.a.example.org:80/p?q#f -> org,example,a)/p?q, in lower-case hosts; null -> ")"."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, parts, 1))
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_extract(text, parts, 2))


def _record(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, refers_to: int | None) -> bytes:
    """One record; digest is hexadecimal, payload empty for a revisit."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}:{digest}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {''.join(url.split())}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of one record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    number = lambda name: None if (x := fields[name].split(":")[2]) == "none" else int(x)
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload doesn't match its digest")
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To") if revisit else None, "payload": payload}


class IndexWriter:
    """Index lines in key order, in compressed blocks, and their directory."""

    def __init__(self, uri: str, lines: int = BLOCK_LINES):
        self.out, self.most, self.held, self.directory, self.at = files.create(uri), lines, [], [], 0

    def add(self, key: str, entry: dict) -> None:
        self.held.append((key, entry))
        if len(self.held) >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.held:
            block = zlib.compress("\n".join(json.dumps([k, e]) for k, e in self.held).encode())
            self.out.write(block)
            self.directory.append([self.held[0][0], self.at, len(block)])
            self.at, self.held = self.at + len(block), []

    def close(self) -> None:
        self.flush()
        directory = zlib.compress(json.dumps(self.directory).encode())
        self.out.write(directory + struct.pack("<Q", len(directory)) + MAGIC)
        self.out.close()


class IndexReader:
    def __init__(self, uri: str):
        self.file = files.open_range(uri)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a capture index")
        n = struct.unpack("<Q", tail[:8])[0]
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 16 - n)))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple[int, list[tuple[str, dict]]] = (-1, [])

    def block(self, k: int) -> list[tuple[str, dict]]:
        """The lines of a block; the last one read is held, since keys are mostly asked for in order."""
        if self.held[0] != k:
            _, at, n = self.directory[k]
            self.held = (k, [json.loads(line) for line in zlib.decompress(self.file.read_at(n, at)).decode().split("\n")])
        return self.held[1]

    def entries(self) -> Iterator[tuple[str, dict]]:
        for k in range(len(self.directory)):
            yield from self.block(k)

    def find(self, key: str) -> list[dict]:
        """All captures of a key; blocks that can't hold it are not read."""
        out, k = [], max(0, bisect_left(self.firsts, key) - 1)
        while k < len(self.firsts) and self.firsts[k] <= key:
            lines = self.block(k)
            of = lambda x: x[0]
            out += [e for _, e in lines[bisect_left(lines, key, key=of) : bisect_right(lines, key, key=of)]]
            k += 1
        return out


def with_revisits(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """page_id, url, payload (null where a revisit leaves it out), n, digest, refers_to."""
    html = as_text("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    shared = written(rows.filter(F.col("n") >= small).groupBy("digest").agg(F.max("page_id").alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k"), "warc-shared")
    typed = rows.join(shared, "digest", "left")
    refers = F.when((F.col("n") >= small) & (F.col("page_id") < F.col("main")), F.col("main"))
    return typed.withColumn("refers_to", refers).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n", "digest", "refers_to")


def write_archives(pages: DataFrame, small: int = SMALL, lines: int = BLOCK_LINES) -> DataFrame:
    """Write one record for each row of pages (page_id, url, html); returns the table of files.

    Rows: warc, cdx (addresses), first, last (keys), n. Of equal payloads of at least `small` bytes the row with the
    largest page_id is the response and rows with smaller ids revisit it; rows with that same id, and rows without
    an id, are responses too. Null html is an empty payload; null and odd addresses have keys like any other; pages
    of any length and repeated rows are written whole; other columns are ignored. No rows give no file.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    rows = with_revisits(pages, small).withColumns({"key": url_key(F.col("url")), "spread": F.xxhash64("page_id", "digest")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = index = first = key = None
        n = at = 0
        for b in batches:
            for key, page_id, url, payload, size, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, first = f"{folder}/{uuid.uuid4().hex}", key
                    out, index = files.create(f"{name}.warc.gz"), IndexWriter(f"{name}.cdx", lines)
                raw = _record(page_id, url, payload or b"", size, digest, refers_to)
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = z.compress(raw) + z.flush()
                out.write(member)
                index.add(key, {"url": url, "page_id": page_id, "digest": digest, "offset": at, "length": len(member)})
                at, n = at + len(member), n + 1
        if out:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"warc": f"{name}.warc.gz", "cdx": f"{name}.cdx", "first": first, "last": key, "n": n}])

    ordered = rows.repartitionByRange("key", "spread").sortWithinPartitions("key", "spread").select("key", "page_id", "url", "payload", "n", "digest", "refers_to")
    return written(ordered.mapInArrow(run, "warc string, cdx string, first string, last string, n long"), "warc-files")


def _rows(found: list[dict], columns: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kinds.get(c, pa.string())) for c in columns], columns)


def read_archives(table: DataFrame) -> DataFrame:
    """One row per record, through the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    columns = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                archive, found = files.open_range(f["warc"]), []
                for _, e in IndexReader(f["cdx"]).entries():
                    found.append(parse_record(zlib.decompress(archive.read_at(e["length"], e["offset"]), 31)) | {"payload": None})
                    if len(found) == 4096:
                        yield _rows(found, columns)
                        found = []
                yield _rows(found, columns)

    return table.select("warc", "cdx").repartition(max(1, table.count()), "warc").mapInArrow(run, OUT)


def _placed(table: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (url, key) with warc and cdx of each file that may hold the key, the rows of a file in the order of keys."""
    spans = sorted((r.first, r.last, r.warc, r.cdx) for r in table.select("first", "last", "warc", "cdx").limit(MOST_FILES + 1).collect())
    if len(spans) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    firsts = [s[0] for s in spans]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = bisect_right(firsts, key) - 1
                while k >= 0 and spans[k][1] >= key:  # a key can go on from one file to the next
                    out.append((url, key, spans[k][2], spans[k][3]))
                    k -= 1
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(4)], ["url", "key", "warc", "cdx"])

    placed = asked.mapInArrow(place, "url string, key string, warc string, cdx string")
    return placed.repartition("warc").sortWithinPartitions("warc", "key")


def read_by_key(table: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows of read_archives for all captures of the addresses of pages, each found by its key.

    Each different key is looked up once: the table of files is bisected, then the directory of blocks of its index, then
    the block; only the byte ranges of its captures are read. A key of many captures is as many tasks' work as it has files.
    """
    columns = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None, None)
        for b in batches:
            found = []
            for key, warc, cdx in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if opened[0] != warc:
                    opened = (warc, files.open_range(warc), IndexReader(cdx))
                for e in opened[2].find(key):
                    found.append(parse_record(zlib.decompress(opened[1].read_at(e["length"], e["offset"]), 31)) | {"payload": None})
                    if len(found) == 4096:
                        yield _rows(found, columns)
                        found = []
            yield _rows(found, columns)

    keys = pages.select(url_key(F.col(url_col).cast("string")).alias("key")).distinct()
    return _placed(table, keys.select(F.lit(None).cast("string").alias("url"), "key")).mapInArrow(run, OUT)


def lookup(table: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each row of urls: url, then the columns of read_archives and the payload as text.

    Urls without a capture give no row; repeated urls give repeated rows. The table of files, one small row a file,
    is what tasks bisect first (a table of more than MOST_FILES files is refused); each index file is opened once.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None, None)
        for b in batches:
            found = []
            for r in b.to_pylist():
                if opened[0] != r["warc"]:
                    opened = (r["warc"], files.open_range(r["warc"]), IndexReader(r["cdx"]))
                for e in opened[2].find(r["key"]):
                    record = parse_record(zlib.decompress(opened[1].read_at(e["length"], e["offset"]), 31))
                    found.append(record | {"url": r["url"], "payload": record["payload"].decode("utf-8", "surrogatepass")})
            yield _rows(found, ["url", *[c.split()[0] for c in OUT.split(", ")], "payload"])

    asked = urls.select(F.col(url_col).cast("string").alias("url"), url_key(F.col(url_col)).alias("key"))
    return _placed(table, asked).mapInArrow(fetch, f"url string, {OUT}, payload string")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return read_by_key(write_archives(pages), pages)


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS m FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < m THEN m END AS refers_to
        FROM q"""
}
