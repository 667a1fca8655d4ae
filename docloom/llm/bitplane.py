"""Token ids in binary files: blocks of ids, transposed into bit or byte planes, each plane compressed.

A file holds the ids of a run of documents in ascending id order. Ids are cut into blocks of a fixed number, whatever
document they belong to. A block becomes one plane for each byte (or bit) of an id, low ones first, up to the
highest that is not all zero; each plane is one zstandard frame. The chunk index at the end gives each block's
place and number of ids, and the document index each document's id and number of ids. Layout, little-endian:

    magic | blocks | zstd(footer) | length of the footer, uint64 | magic
    footer: lengths of its three parts, uint64 each | chunk index | document ids | document lengths
    chunk index: uint64 rows (offset, ids, then the length of each of 32 planes, 0 if absent)

Ids are written by tasks into the shared folder under names that no other attempt uses; the table of the files that
succeeded is written last, so what failed attempts left behind is never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import files
from docloom.llm.shared import as_text, fresh_path, read, written

MAGIC = b"DLPLANE1"
#: Ids of a block; texts' pieces whose ids a worker remembers (then it starts anew; results don't depend on it).
BLOCK, REMEMBER = 1 << 16, 1_000_000
END = b"\0\0\0\0"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Ids of texts as little-endian uint32 bytes, with the tokenizers library.

    Byte-level BPE never merges across its pre-tokens, so their ids are remembered: a text is cut at single spaces
    between other characters, which always start a pre-token, and new pieces are cut into pre-tokens, which the
    library's model encodes. Texts with other spacing, unusual characters, or an added token's string, and tokenizers
    of another kind, take the library's way as they are.
    """

    #: The pre-token pattern of the byte-level vocabulary.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    UNUSUAL = re.compile(r"[^\n -~¡-ſ]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        added = [t["content"] for t in kind.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        pre = kind.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer")
        self.split = regex.compile(self.PATTERN).findall if plain else None
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}  # by what follows the space
        self.tokens: dict[str, bytes] = {}  # pre-tokens that aren't a space and letters

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        odd = not self.split or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        if odd or self.UNUSUAL.search(text) or (self.added and self.added.search(text)):
            return self.plain(text)
        first, *rest = text.split(" ")
        known = self.pieces
        if new := [p for p in {*rest} if p not in known]:
            if len(known) > REMEMBER:
                known.clear()
                new = {*rest}
            self.learn(new)
        return (self.plain(first) if first else b"") + b"".join(map(known.__getitem__, rest))

    def model(self, token: str) -> bytes:
        """The ids of one pre-token."""
        spelt = token.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.library.model.tokenize(spelt)], "<u4").tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        known, tokens = self.pieces, self.tokens
        if len(tokens) > REMEMBER:
            tokens.clear()
        for p in pieces:
            if p.isalpha():
                if p not in known:
                    known[p] = self.model(f" {p}")
                continue
            ids = []
            for t in self.split(f" {p}"):
                if t[0] == " " and (w := t[1:]).isalpha():
                    if (x := known.get(w)) is None:
                        x = known[w] = self.model(t)
                elif (x := tokens.get(t)) is None:
                    x = tokens[t] = self.model(t)
                ids.append(x)
            known[p] = b"".join(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file, so that what it remembers lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of one block of uint32 ids, low ones first, without those above the highest that is needed."""
    top = int(ids.max(initial=0)).bit_length()
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        each = np.unpackbits(raw, axis=1, bitorder="little")
        return [np.packbits(each[:, k]).tobytes() for k in range(top)]
    return [raw[:, k].tobytes() for k in range((top + 7) // 8)]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    if bits:
        each = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            each[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        raw = np.packbits(each, axis=1, bitorder="little")
    else:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Writer:
    """One file; documents come in order."""

    def __init__(self, uri: str, block: int = BLOCK, bits: bool = False, level: int = 3):
        self.out, self.block, self.bits = files.create(uri), block, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_ids, self.at = [], 0, len(MAGIC)
        self.chunks, self.docs, self.lengths = [], [], []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        if self.held_ids >= self.block:
            self.flush(self.held_ids - self.held_ids % self.block)

    def flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for a in range(0, n, self.block):
            part = ids[a : min(a + self.block, n)]
            planes = [self.zstd.compress(p) for p in to_planes(part, self.bits)]
            self.chunks.append([self.at, len(part), *map(len, planes), *[0] * (32 - len(planes))])
            self.out.write(b"".join(planes))
            self.at += sum(map(len, planes))
        self.held, self.held_ids = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> tuple[int, int, int, int]:
        """Documents, ids, blocks and bytes of the file."""
        self.flush(self.held_ids)
        parts = [np.array(self.chunks, "<u8").tobytes(), pa.array(self.docs, pa.int64()), np.array(self.lengths, "<u8").tobytes()]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as w:
            w.write_batch(pa.record_batch([parts[1]], ["doc_id"]))
        parts[1] = sink.getvalue().to_pybytes()
        footer = self.zstd.compress(struct.pack("<3QB", *map(len, parts), self.bits) + b"".join(parts))
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        return len(self.docs), sum(self.lengths), len(self.chunks), self.at + len(footer) + 16


class Reader:
    """One file; any block or document can be read by itself."""

    def __init__(self, uri: str):
        self.file = files.open_range(uri)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a file of id planes")
        n = struct.unpack("<Q", tail[:8])[0]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, size - 16 - n))
        a, b, c, bits = struct.unpack_from("<3QB", raw)
        at, self.bits = struct.calcsize("<3QB"), bool(bits)
        self.chunks = np.frombuffer(raw[at : at + a], "<u8").reshape(-1, 34).astype(np.int64)
        self.docs = pa.ipc.open_stream(raw[at + a : at + a + b]).read_all()["doc_id"].to_pylist()
        self.lengths = np.frombuffer(raw[at + a + b : at + a + b + c], "<u8").astype(np.int64)
        self.ends, self.firsts = np.cumsum(self.lengths), np.cumsum(self.chunks[:, 1])
        self.zstd = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        offset, n, *lengths = self.chunks[k].tolist()
        raw, at, planes = self.file.read_at(sum(lengths), offset), 0, []
        for size in lengths:
            if size:
                planes.append(self.zstd.decompress(raw[at : at + size]))
                at += size
        return from_planes(planes, n, self.bits)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from the blocks that hold them."""
        start, end = int(self.ends[i] - self.lengths[i]), int(self.ends[i])
        a, b = np.searchsorted(self.firsts, start, "right"), np.searchsorted(self.firsts, end, "left")
        ids = np.concatenate([self.block(k) for k in range(a, b + 1)]) if end > start else np.zeros(0, "<u4")
        skip = start - int(self.firsts[a] - self.chunks[a, 1]) if end > start else 0
        return ids[skip : skip + end - start]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, ids before it in this file, ids) of all documents, each block read once."""
        held, k, start = b"", 0, 0
        for doc_id, n in zip(self.docs, self.lengths.tolist(), strict=True):
            if len(held) < 4 * n:
                more = [held]
                have = len(held)
                while have < 4 * n:
                    more.append(self.block(k).tobytes())
                    have += len(more[-1])
                    k += 1
                held = b"".join(more)
            yield doc_id, start, held[: 4 * n]
            held, start = held[4 * n :], start + n


def write_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Encode every whole text, append id 0, and write the ids in ascending id order; returns the table of files.

    Rows: part, uri, n_docs, n_ids, n_blocks, bytes; files in order of part hold the documents in order. Null texts
    count as empty, so such a document is its end id alone; null ids come first; rows with equal ids are ordered by
    a hash of the text, so that many of them still spread over files. Other columns are ignored. An empty table
    writes no file.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        tool = encoder(tokenizer)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if writer is None:
                    uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                    writer = Writer(uri, block, bits)
                writer.add(doc_id, tool.encode(text.as_py()) + END)
        if writer:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "uri", "n_docs", "n_ids", "n_blocks", "bytes"), (part, uri, *writer.close()), strict=True))])

    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(ordered.mapInArrow(run, "part long, uri string, n_docs long, n_ids long, n_blocks long, bytes long"), "ids-files")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; a task reads one file after the other."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("uri", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = [(d, r["base"] + s, len(x) // 4, zlib.crc32(x)) for d, s, x in Reader(r["uri"]).documents()]
                for i in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + (1 << 16)], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return placed.repartition(n, "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op4_bitplane": op4_bitplane}
ORACLE_SQL: dict[str, str] = {}
