"""Benchmark decontamination: latent semantic retrieval of benchmark passages, then word-order and answer checks.

Passages are TF-IDF vectors, whose counts cover the whole corpus. A distributed randomised SVD of all passages of the
benchmark spans the latent space over its vocabulary. Every window of every document is compared with every passage
of the benchmark by cosine there. Beside that, runs of GRAM words that a document shares with an item
make it a candidate whatever its words weigh, so a passage that many documents hold is found however common that
makes its words. Candidates are confirmed by the longest common subsequence of words and by the item's closing words,
its answer. Arrow cuts a batch of texts into words and numbers them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import discard, read, written

#: Words of a passage and of a document's window, and the step from one to the next (half a window).
WINDOW, STEP = 32, 16
#: Least cosine of a candidate; least common subsequence as a share of the item, alone or with half of its answer.
COSINE, ALONE, WITH_ANSWER, ANSWER_WORDS = 0.45, 0.8, 0.6, 8
#: Words of a run that makes an item a candidate (a shorter item is one run); what a term of every passage still weighs.
GRAM, LEAST_WEIGHT = 5, 0.05
#: Fixed odd numbers that hash a run, one for each place.
ODDS = np.random.default_rng(7).integers(1 << 62, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same for the bytes of a word.
SPOTS = np.random.default_rng(8).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bound of benchmark items; buckets of words outside the benchmark.
MOST_ITEMS, BUCKETS = 20_000, 1 << 16
#: The SVD's rank is the number of the benchmark's passages; beyond RANK, while a block (terms x rank) has at most CELLS numbers.
RANK, CELLS = 512, 1 << 23
EDGE = ".,;:!?*%&#|\"'`´()[]{}<>«»“”‘’…~^=/\\_-$@+"


class Terms:
    """Numbers words: the benchmark's by themselves, all others by bucket."""

    def __init__(self, vocabulary: dict[str, int]):
        self.n, self.known = len(vocabulary), pa.array(vocabulary, pa.string())

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers of all words of all texts in a row, where each text begins there and the end of the last)."""
        lists = words(texts)
        coded = lists.flatten().dictionary_encode()
        ids = np.where((found := pc.fill_null(pc.index_in(coded.dictionary, self.known), -1).to_numpy()) >= 0, found, self.n + buckets(coded.dictionary))
        ids = np.where(pc.binary_length(coded.dictionary).to_numpy() > 0, ids, -1).astype(np.int32)[coded.indices.to_numpy()]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ids >= 0, out=ends[1:])
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return ids[ids >= 0], ends[offsets - offsets[0]]


def words(texts: pa.Array) -> pa.ListArray:
    """The lower-case words of each text, without marks at their ends; marks alone are empty words."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    return pa.ListArray.from_arrays(lists.offsets, pc.utf8_trim(lists.values, EDGE))


def buckets(names: pa.StringArray) -> np.ndarray:
    """A bucket for each word, by a sum over its bytes."""
    _, offsets, data = names.buffers()
    at = np.frombuffer(offsets, np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    raw = np.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), 0).astype(np.uint64)
    place = np.arange(len(raw)) - np.append(np.repeat(at[:-1], np.diff(at)) - at[0], 0)
    sums = np.add.reduceat((raw + np.uint64(1)) * SPOTS[place % len(SPOTS)], at[:-1] - at[0]) if len(names) else np.zeros(0, np.uint64)
    return (sums >> np.uint64(48)).astype(np.int64) % BUCKETS


def starts(n: int) -> np.ndarray:
    """Where the windows of n words begin; the last one may be shorter than the others."""
    return np.arange(0, max(1, n - STEP), STEP)


def passage_starts(n: int) -> np.ndarray:
    """Where the passages of an item of n words begin: every step, and one that ends with the item."""
    return np.unique(np.append(np.arange(0, max(1, n - WINDOW + 1), STEP), max(0, n - WINDOW)))


def grid(ids: np.ndarray, begins: np.ndarray, width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of `width` words, each text from a row of its own on; first row of each text and the end of the last)."""
    n = np.diff(begins)
    rows = np.append(0, np.cumsum(-(-n // width)))
    out = np.full(rows[-1] * width, pad, np.int32)
    out[np.arange(len(ids)) + np.repeat(rows[:-1] * width - begins[:-1], n)] = ids
    return out.reshape(-1, width), rows


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int], text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many passages of the whole corpus each term is, and how many passages there are."""
    size = len(vocabulary) + BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total, passages = Terms(vocabulary), np.zeros(size + 1, np.int64), 0
        for b in batches:
            rows, _ = grid(*terms.of(b.column(0)), WINDOW, size)
            rows.sort(axis=1)
            new = np.ones(rows.shape, bool)
            new[:, 1:] = rows[:, 1:] != rows[:, :-1]
            total += np.bincount(rows[new], minlength=size + 1)
            passages += len(rows)
        total[size] = passages
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n  # one row a term: bounded by the benchmark's words and the buckets
    return out[:size], int(out[size])


def svd(matrix: DataFrame, n: int, rank: int, seed: int = 0, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (n x rank) of the rows (ids, values) of matrix, by random projection.

    Each round multiplies A'A with a thin block: tasks go over their rows and send one n x rank block each.
    """
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, rank)))[0].astype(np.float32)
    for _ in range(rounds):
        q = block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(q)  # noqa: B023
            for b in batches:
                for ids, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    v = np.array(values, np.float32)
                    out[ids] += v[:, None] * (v @ q[ids])  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["block"])

        product = np.zeros(q.shape)
        for r in matrix.mapInArrow(run, "block binary").toLocalIterator():
            product += np.frombuffer(r.block, np.float32).reshape(q.shape)
        inner = q.T @ product
        block = np.linalg.qr(product)[0].astype(np.float32)
    squares, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-squares)
    return np.sqrt(np.maximum(squares[order], 0)), (q @ turn)[:, order]


def places(item: np.ndarray) -> dict[int, int]:
    """The bits of the places of each term of an item."""
    out: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        out[t] = out.get(t, 0) | 1 << i
    return out


def common(n: int, bits: dict[int, int], region: np.ndarray) -> int:
    """Length of the longest common subsequence of an item of n terms with these bits and a region, bit-parallel."""
    full = (1 << n) - 1
    row = full
    for m in map(bits.get, region.tolist()):
        if m:
            hit = row & m
            row = (row + hit) | (row - hit)
    return n - (row & full).bit_count()


def runs(ids: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, hash) of the runs of `size` terms under n."""
    m = max(0, len(ids) - size + 1)
    known, ok = ids < n, np.ones(m, bool)
    hashes = np.full(m, size, np.uint64)
    for k in range(size):
        ok &= known[k : k + m]
        each = (np.arange(n + 1, dtype=np.uint64) + np.uint64(1)) * ODDS[k]
        hashes += each[np.minimum(ids[k : k + m], n)]
    first = np.flatnonzero(ok)
    return first, hashes[first]


@dataclass
class Ready:
    """What a worker makes of an index once: numbers of tokens, the table whose rows windows add up, a filter of runs."""

    terms: Terms
    table: np.ndarray
    folded: bool
    may: np.ndarray
    bits: list[dict[int, int]]
    answer_bits: list[dict[int, int]]


#: By index: workers outlive tasks.
_READY: dict[str, Ready] = {}


@dataclass
class LatentIndex:
    """The benchmark in latent space. basis: terms x rank; queries: rank x passages, each over the share of it that the
    rank keeps; owner: each passage's item."""

    ids: list[int | None]
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    idf: np.ndarray
    basis: np.ndarray
    queries: np.ndarray
    owner: np.ndarray
    cosine: float = COSINE
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64), repr=False)
    gram_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64), repr=False)
    gram_sizes: tuple[int, ...] = ()
    key: str = field(default_factory=lambda: uuid4().hex)

    @property
    def ready(self) -> Ready:
        if self.key not in _READY:
            _READY.clear()
            # up to about as many passages as ranks, each term's product with every passage is worked out once
            folded = self.queries.shape[1] <= 2 * self.basis.shape[1]
            table = self.basis @ self.queries if folded else self.basis
            may = np.zeros(1 << 20, bool)
            may[self.grams >> np.uint64(44)] = True
            answers = [places(x[-ANSWER_WORDS:]) for x in self.items]
            _READY[self.key] = Ready(Terms(self.vocabulary), np.vstack([table, np.zeros_like(table[:1])]), folded, may, [places(x) for x in self.items], answers)
        return _READY[self.key]

    def candidates(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, item, cosine) of the windows of a batch of texts that come near a passage of the benchmark."""
        n, pad, ready = len(self.vocabulary), len(self.idf), self.ready
        blocks, rows = grid(ids, begins, STEP, pad)
        blocks = np.vstack([blocks, np.full((1, STEP), pad, np.int32)])
        squares = np.append(self.idf**2, 0)
        heads = np.ones(len(blocks), bool)  # a window is a block and the next one; a text's last block only goes along
        heads[rows[1:][np.diff(rows) > 1] - 1] = False
        heads[-1] = False
        alone = np.zeros(len(blocks), bool)
        alone[rows[:-1][np.diff(rows) == 1]] = True
        shift = begins[:-1] - rows[:-1] * STEP
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(blocks) - 1, 1024):
            part = blocks[a : a + 1025]
            known = np.minimum(part, n)
            sums = ready.table[known[:, 0]]
            row = np.empty_like(sums)
            for j in range(1, STEP):
                sums += np.take(ready.table, known[:, j], axis=0, out=row)
            at = np.flatnonzero(heads[a : a + len(part) - 1])
            one = alone[a + at]
            after = np.where(one, len(part) - 1, at + 1)
            both = np.concatenate([part[at], np.where(one[:, None], pad, part[after])], axis=1)
            both.sort(axis=1)
            place = np.arange(WINDOW)
            first = np.zeros(both.shape, np.int64)
            first[:, 1:] = np.where(both[:, 1:] != both[:, :-1], place[1:], 0)
            length = np.sqrt(((2 * (place - np.maximum.accumulate(first, axis=1)) + 1) * squares[both]).sum(axis=1))  # k equal terms: k squared
            latent = sums[at] + np.where(one[:, None], 0, sums[after])
            least = (self.cosine * length)[:, None]
            for q in range(0, self.queries.shape[1], 2048):
                found = latent if ready.folded else latent @ self.queries[:, q : q + 2048]
                w, p = np.nonzero((found >= least) & (found > 0))
                block = a + at[w]
                out.append((block * STEP + shift[np.searchsorted(rows, block, "right") - 1], self.owner[q + p], found[w, p] / length[w]))
                if ready.folded:
                    break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def copies(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, item) of the runs of words that a text shares with an item: the ends of each stretch of them."""
        text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        at, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in self.gram_sizes:
            first, h = runs(ids, len(self.vocabulary), size)
            hit = np.flatnonzero(self.ready.may[h >> np.uint64(44)])
            hit = hit[text[first[hit]] == text[first[hit] + size - 1]]
            first, h = first[hit], h[hit]
            low = np.searchsorted(self.grams, h)
            n = np.searchsorted(self.grams, h, "right") - low
            at.append(np.repeat(first, n))
            item.append(self.gram_item[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        at, item = np.concatenate(at), np.concatenate(item)
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        spread, inner = at + 8 * text[at], np.zeros(len(at), bool)  # a gap between texts
        inner[1:-1] = (item[:-2] == item[2:]) & (spread[2:] - spread[:-2] <= 2)
        return at[~inner], item[~inner]

    def near(self, window: np.ndarray, item: int) -> float:
        """The cosine of a window with the nearest passage of an item."""
        t, k = np.unique(window, return_counts=True)
        latent = k[t < len(self.vocabulary)] @ self.basis[t[t < len(self.vocabulary)]]
        mine = slice(*np.searchsorted(self.owner, [item, item + 1]))
        return float((latent @ self.queries[:, mine]).max(initial=0) / max(1e-9, np.linalg.norm(k * self.idf[t])))

    def in_order(self, item: int, region: np.ndarray) -> tuple[float, float, int]:
        """The best (share of an item in order, share of its answer, first word) over windows of twice the item.

        Windows overlap by three quarters, so that any stretch of one and a half times the item lies in one of them. In longer
        ones the words of an item come together by chance, however they are shuffled.
        """
        n = len(self.items[item])
        answer = min(n, ANSWER_WORDS)
        best = (-1.0, 0.0, 0)
        for a in range(0, max(1, len(region) - 2 * n + -(-n // 2)), -(-n // 2)):
            window = region[a : a + 2 * n]
            share = common(n, self.ready.bits[item], window) / n
            if share > best[0]:
                best = (share, common(answer, self.ready.answer_bits[item], window) / answer, a)
        return best

    def hits(self, texts: pa.Array) -> list[list[tuple[int | None, int, float, float, float]]]:
        """(item id, first word, cosine, share of the item in order, share of its answer) of what each text leaks."""
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        if not self.items or not len(texts):
            return out
        ids, begins = self.ready.terms.of(texts)
        if not len(ids):
            return out
        at, item, cos = self.candidates(ids, begins)
        place, same = self.copies(ids, begins)
        at, item, cos = np.append(at, place), np.append(item, same), np.append(cos, np.zeros(len(place)))
        text = np.searchsorted(begins, at, "right") - 1
        order = np.lexsort((at, item, text))
        rows = list(zip(text[order].tolist(), item[order].tolist(), at[order].tolist(), cos[order].tolist(), strict=True))
        seen = np.zeros(len(self.idf), bool)
        best: dict[tuple[int, int], tuple] = {}
        k = 0
        while k < len(rows):  # windows of one item that touch each other are one region
            d, i, a, c = rows[k]
            n, b, top = len(self.items[i]), a + WINDOW, a
            k += 1
            while k < len(rows) and rows[k][:2] == (d, i) and rows[k][2] <= b + n:
                b = rows[k][2] + WINDOW
                c, top = max((c, top), (rows[k][3], rows[k][2]), key=lambda x: x[0])
                k += 1
            low = int(max(begins[d], a - n))
            region = ids[low : min(begins[d + 1], b + n)]
            seen[region] = True
            most = np.count_nonzero(seen[self.items[i]])
            seen[region] = False
            if most < WITH_ANSWER * n:  # no order of these words can be enough
                continue
            share, told, from_ = self.in_order(i, region)
            if (share >= ALONE or (share >= WITH_ANSWER and told >= 0.5)) and ((d, i) not in best or (share, -a) > best[d, i][0]):
                c = c or self.near(ids[top : min(top + WINDOW, begins[d + 1])], i)
                best[d, i] = ((share, -a), (self.ids[i], int(low + from_ - begins[d]), c, share, told))
        for d, i in sorted(best):
            out[d].append(best[d, i][1])
        return out


def build(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", cosine: float = COSINE) -> LatentIndex:
    """The index of a benchmark of at most MOST_ITEMS items; more are refused. Items without words are left out.

    Term counts cover all documents. The SVD sees all benchmark passages and nothing else: they are all that windows are
    compared with, so what a window holds beside their span adds to no product. Up to the rank's bound the cosines are
    those of the whole TF-IDF vectors.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} benchmark items")
    split = [[w for w in ws if w] for ws in words(pa.array([r.text for r in rows], pa.string())).to_pylist()]
    items = sorted(((r.id, ws) for r, ws in zip(rows, split, strict=True) if ws), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    n = len(vocabulary)
    coded = [np.array([vocabulary[w] for w in ws]) for _, ws in items]
    if not items:
        return LatentIndex([], [], {}, np.zeros(BUCKETS), np.zeros((0, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.int64), cosine)
    df, passages = document_frequencies(docs, vocabulary, text_col)
    idf = np.log((passages + 1) / (df + 1)) + LEAST_WEIGHT
    owner, vectors = [], []
    for i, ids in enumerate(coded):
        for a in passage_starts(len(ids)):
            t, k = np.unique(ids[a : a + WINDOW], return_counts=True)
            if size := np.linalg.norm(k * idf[t]):
                owner.append(i)
                vectors.append((t, k * idf[t] / size))

    spark = docs.sparkSession
    matrix = written(spark.createDataFrame([([int(x) for x in t], [float(x) for x in v]) for t, v in vectors], "ids array<int>, values array<double>").repartition(4), "passages")
    rank = max(1, min(n, len(vectors), max(RANK, CELLS // n)))
    _, right = svd(matrix, n, rank)
    discard(matrix)
    latent = np.stack([v @ right[t] for t, v in vectors])
    basis = (idf[:n, None] * right).astype(np.float32)
    found = [(h, i) for i, ids in enumerate(coded) for h in np.unique(runs(ids, n, min(GRAM, len(ids)))[1]).tolist()]
    grams, whose = np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found], np.int64)
    order = np.argsort(grams, kind="stable")
    whole = latent / np.maximum((latent**2).sum(axis=1, keepdims=True), 1e-9)  # a copy has cosine 1, whatever the rank keeps of it
    queries = np.ascontiguousarray(whole.T).astype(np.float32)
    return LatentIndex([i for i, _ in items], coded, vocabulary, idf, basis, queries, np.array(owner), cosine, grams[order], whose[order], tuple(sorted({min(GRAM, len(x)) for x in coded})))


def find_leaks(docs: DataFrame, index: LatentIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, cosine, item_share, answer_share: one row per document and item that it leaks.

    Every whole text is read where it lies, however long (no shuffle). Null, empty and clean texts give no row;
    repeated rows and null ids give rows like any other; other columns are ignored; an empty benchmark finds nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(d, *h) for d, hits in zip(b.column(0).to_pylist(), index.hits(b.column(1)), strict=True) for h in hits]
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "first_word", "cosine", "item_share", "answer_share"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, item_id long, first_word long, cosine double, item_share double, answer_share double")


def without_leaks(docs: DataFrame, index: LatentIndex, text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not hits for hits in index.hits(b.column(at).cast(pa.string()))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find_leaks(docs, build(docs, read(spark, sf_dir, "benchmark")))


QUERIES = {"op1_latent": op1_latent}
ORACLE_SQL: dict[str, str] = {}
