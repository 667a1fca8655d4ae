"""Near-duplicate documents: SimHash fingerprints, linked where they differ in a few bits.

Fingerprints are split into blocks. Two that differ in at most `distance` bits agree on at least
blocks - distance whole blocks, so each fingerprint is dealt out under every choice of that many blocks, and only
fingerprints that share such a key are compared. Linked fingerprints form components.

A few bits of 64 find copies with few changes only. For a given similarity of shingles (one_of_similar) fingerprints have
1,024 bits, whose distance tells the angle between the sets of shingles, and blocks of a byte, joined three at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.components import connected_components
from docloom.llm.shared import appended, discard, read, sized, with_place, written

#: Fingerprints of one key that are compared in one cell; larger keys are cut into chunks, and cells hold two chunks.
CELL = 1024
#: Shingle hashes whose bits are counted at once.
AT_ONCE = 1 << 15
#: Bytes of a wide fingerprint.
WIDE = 128
#: Bytes that a key of wide fingerprints joins, as steps from each byte in a ring. No difference occurs twice, so two keys
#: share one byte at most.
STEPS = (0, 1, 3)


def _shingles(text: str | None, width: int, seed: int) -> list[int]:
    """Hashes of the word shingles of a text, repeats included; that of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[:-width].tolist(), (starts[width:] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text, as a signed 64-bit integer; a text without words (or null) has 0."""
    hashes = _shingles(text, width, seed)
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    packed = np.array(hashes, dtype=">u8")
    for i in range(0, len(packed), AT_ONCE):
        ones += np.unpackbits(packed[i : i + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(packed)).view(">i8")[0])


def _wide_bits(hashes: np.ndarray) -> np.ndarray:
    """8 * WIDE bits for each hash, as rows of 0 and 1: the hash counted up and mixed, once for every 64 bits."""
    z = hashes[:, None] + np.arange(1, WIDE // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.unpackbits(z.astype("<u8").view(np.uint8), axis=1)


def wide_fingerprint(text: str | None, width: int = 5, seed: int = 42) -> bytes:
    """The SimHash of the set of shingles of one text in WIDE bytes; a text without words (or null) has zeros.

    Where as many shingles have a bit as lack it, the shingle with the least hash decides, so that texts of few
    shingles don't share zeros.
    """
    hashes = np.unique(np.array(_shingles(text, width, seed), dtype=np.uint64))
    if not len(hashes):
        return bytes(WIDE)
    ones = np.zeros(8 * WIDE, dtype=np.int64)
    for i in range(0, len(hashes), 255 << 2):  # sums of 255 bits fit a byte
        bits = _wide_bits(hashes[i : i + (255 << 2)])
        whole = len(bits) // 255 * 255
        ones += np.add.reduce(bits[:whole].reshape(-1, 255, 8 * WIDE), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + _wide_bits(hashes[:1])[0] > len(hashes)).tobytes()


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", width: int = 3, wide: bool = False) -> DataFrame:
    """docs with the column `out`, long or (wide) binary; rows stay where they are (no shuffle)."""
    at, of, kind = docs.columns.index(text_col), wide_fingerprint if wide else fingerprint, pa.binary() if wide else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([of(x.as_py(), width) for x in b.column(at)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, fps], [*b.schema.names, out])

    return docs.mapInArrow(run, appended(docs, (out, T.BinaryType() if wide else T.LongType())))


def _masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks - distance blocks, as signed 64-bit integers."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    sums = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in sums]


def _links(rows: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Within runs of equal cells (rows gives each row's run): (place, that of a linked one that stands for its group).

    fps: 64 bits a column. Every pair of a run is compared; what comes out is one link a row at most, which join the
    same groups.
    """
    root = np.arange(len(fps))
    at, step = np.arange(len(fps)), 1
    while len(at := at[at + step < len(fps)]) and len(at := at[rows[at] == rows[at + step]]):
        near = at[np.bitwise_count((fps[at] ^ fps[at + step]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= distance]
        a, b = near, near + step
        while len(a):  # join the trees of a and b, the larger root under the smaller
            ra, rb = root[a], root[b]
            while (up := root[ra]) is not None and (up != ra).any():
                ra = up
            while (up := root[rb]) is not None and (up != rb).any():
                rb = up
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        step += 1
    while (root[root] != root).any():
        root = root[root]
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return moved, root[moved]


def _linker(distance: int, wide: bool = False):
    """Links (u, v) of nodes. Rows: four numbers of the cell, the node, and (wide) its fingerprint, else the node is that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cells: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            change = (cells[1:] != cells[:-1]).any(axis=1) if len(cells) else np.zeros(0, bool)
            u, v = _links(np.concatenate([[0], np.cumsum(change)])[: len(cells)], fps, distance)
            return pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], ["u", "v"])

        cells, nodes, fps = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE // 8 if wide else 1), np.int64)
        for b in batches:  # rows come sorted by cell; the last cell of a batch waits for the next batch
            cells = np.concatenate([cells, np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)])
            nodes = np.concatenate([nodes, b.column(4).to_numpy()])
            more = np.frombuffer(b"".join(b.column(5).to_pylist()), np.int64) if wide else b.column(4).to_numpy()
            fps = np.concatenate([fps, more.reshape(-1, fps.shape[1])])
            last = np.flatnonzero((cells != cells[-1:]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links(cells[:cut], nodes[:cut], fps[:cut])
                cells, nodes, fps = cells[cut:], nodes[cut:], fps[cut:]
        if len(fps):
            yield links(cells, nodes, fps)

    return run


def link_fingerprints(fps: DataFrame, distance: int = 3, blocks: int = 5, cell: int = CELL) -> DataFrame:
    """Links (u, v) that join the fingerprints of the long column fp exactly where a chain of close ones does.

    A key that holds more than `cell` fingerprints is cut into chunks by a hash, and each two chunks meet in a
    cell of their own; so no task gathers a whole key, and no pair is missed. Keys of one fingerprint drop out.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(blocks, distance)])
    keyed = fps.select(F.col("fp").cast("long").alias("fp")).filter("fp is not null").distinct().select("fp", F.posexplode(masks).alias("kind", "mask"))
    keyed = keyed.select(F.col("kind").cast("long").alias("kind"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    cells = _dealt(keyed, "fp", cell).repartition("kind", "key", "a", "b").sortWithinPartitions("kind", "key", "a", "b", "fp")
    return cells.mapInArrow(_linker(distance), "u long, v long")


def _dealt(keyed: DataFrame, node: str, cell: int) -> DataFrame:
    """(kind, key, a, b, node): the rows of keys that more than one node has, dealt to the cells in which two chunks meet."""
    sizes = keyed.groupBy("kind", "key").count().filter("count > 1")
    chunks = F.ceil(F.col("count") / F.lit(cell)).cast("long")
    mine = F.pmod(F.xxhash64(node), F.col("chunks"))
    return (
        keyed.join(sizes, ["kind", "key"]).withColumn("chunks", chunks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("kind", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), node)
    )


@cache
def _wide_places() -> np.ndarray:
    """The bytes that each key of a wide fingerprint joins."""
    return np.array([[(i + k) % WIDE for k in STEPS] for i in range(WIDE)])


def wide_keys(fps: np.ndarray) -> np.ndarray:
    """The keys of wide fingerprints (rows of bytes), one column for each kind of key."""
    parts = fps[:, _wide_places()].astype(np.int64)
    return (parts[:, :, 0] << 16) | (parts[:, :, 1] << 8) | parts[:, :, 2]


def _keyed_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = wide_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, WIDE))
        nodes = np.repeat(b.column(0).to_numpy(), keys.shape[1])
        kinds = np.tile(np.arange(keys.shape[1], dtype=np.int16), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys.ravel().astype(np.int32)), pa.array(nodes)], ["kind", "key", "node"])


def wide_distance(similarity: float) -> int:
    """Differing bits of wide fingerprints at which texts of equal length with that Jaccard similarity are linked.

    The share of differing bits has the mean angle / pi; the limit lies a standard deviation above, so that chance leaves
    few texts of that similarity apart.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(8 * WIDE * share + math.sqrt(8 * WIDE * share * (1 - share)))


def link_wide(fps: DataFrame, distance: int, cell: int = CELL) -> DataFrame:
    """Links (u, v) that join the nodes of fps (node long, fp of WIDE bytes) where a chain of close ones that share a key does.

    As link_fingerprints; the fingerprints themselves move only for keys that several nodes have.
    """
    keyed = fps.select("node", "fp").mapInArrow(_keyed_wide, "kind short, key int, node long")
    dealt = _dealt(keyed, "node", cell).select(*[F.col(c).cast("long") for c in ("kind", "key", "a", "b", "node")])
    cells = dealt.join(fps.select("node", "fp"), "node").select("kind", "key", "a", "b", "node", "fp")
    cells = cells.repartition("kind", "key", "a", "b").sortWithinPartitions("kind", "key", "a", "b", "node")
    return cells.mapInArrow(_linker(distance, wide=True), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint, component_id).

    component_id is the least id reachable over links of at most `distance` differing bits, itself included.
    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other. Null ids
    keep their rows and never name a component while another id does. Repeated rows stay repeated; texts are
    read whole, however long; other columns of docs are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = written(with_fingerprint(rows, "text", "fp", width).select("doc_id", "fp"), "simhash")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(link_fingerprints(least, distance, blocks)).withColumnsRenamed({"node": "fp", "root": "root"})
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(named.join(names, "root").select("fp", "component_id"), "simhash-classes")  # a table: Spark may split a hot fingerprint
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False, width: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """The rows of docs that stay when one row of each component does: that with the least id, nulls last.

    Columns are those of docs. Of rows that are equal in all these respects, the first by file and place stays.
    stored: as in with_place. What is joined with the rows is the table of those that go, broadcast while it is small.
    """
    return _one_of_each(docs, id_col, text_col, stored, width, False, lambda fps: link_fingerprints(fps.select("fp"), distance, blocks))


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """As one_of_each, for texts whose shingles of `width` words have that Jaccard similarity or more.

    Similarity is read off the Hamming distance of wide fingerprints (wide_distance), so pairs near the limit may fall
    to either side. Fingerprints that share no key of three bytes are not compared: none of those that differ in 42 bits
    or fewer, for a byte takes part in three of the 128 keys; of those at the limit about one in thirty.
    """
    limit = wide_distance(similarity)
    return _one_of_each(docs, id_col, text_col, stored, width, True, lambda fps: link_wide(fps, limit))


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, stored: bool, width: int, wide: bool, link) -> DataFrame:
    """link: links (u, v) for a table (node, fp); a node is the fingerprint itself, or (wide) a number for it."""
    placed, file, at = with_place(docs, stored)
    slim = placed.select(F.col(file).alias("f"), F.col(at).alias("at"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = written(with_fingerprint(slim, "text", "fp", width, wide).select("f", "at", "id", "fp"), "simhash")
    best = marked.groupBy("fp").agg(F.min(F.struct(F.isnull("id").alias("n"), "id", "f", "at")).alias("best"), F.count("*").alias("n"))
    best = written(best.withColumn("node", F.monotonically_increasing_id() if wide else F.col("fp")), "simhash-best")  # numbers hold, once written
    roots = connected_components(link(best.select("node", "fp")))
    named = best.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("best").alias("stays"), F.sum("n").alias("rows")).filter("rows > 1")
    heads = written(heads, "simhash-heads")  # a table: Spark may split a hot group
    groups = written(named.select("fp", "root").join(sized(heads), "root").select("fp", "stays.f", "stays.at"), "simhash-groups")
    other = (F.col("m.f") != F.col("g.f")) | (F.col("m.at") != F.col("g.at"))
    gone = marked.alias("m").join(groups.alias("g"), "fp").filter(other).select(F.col("m.f").alias(file), F.col("m.at").alias(at))
    gone = written(gone, "simhash-gone")
    discard(marked, best, heads, groups)
    return placed.join(sized(gone), [file, at], "left_anti").select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
