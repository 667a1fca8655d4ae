"""Quality classifier: a linear-chain conditional random field labels the lines of a text good or bad.

Each line is described by its own statistics and those of its neighbours. Forward-backward marginals, weighted by
the lines' lengths, give the share of good text, and a logistic curve turns that into a document score. The model is
some dozens of numbers, learnt from all labelled texts by sums over the executors; scoring is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import MOST_BROADCAST, appended, discard, free_name, is_held_out, known_labels, read, seen, spare_name, written

#: Lines of labelled texts that are worked on at once.
BLOCK = 1 << 15
SYMBOLS, UPPER, DIGITS, MARKS, STOPS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:"
N_OWN = 12
#: Own features of a line, the same of the lines before and after it, and a constant.
N_FEATURES = 3 * N_OWN + 1


def own_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines by N_OWN, lengths) of the lines with a word; a text without words has no line."""
    own, lengths, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = sum(map(len, words)), len(words)
        share = lambda chars, of: (len(line) - len(line.translate(None, chars))) / of  # noqa: B023, E731
        repeats = sum(map(eq, words, words[1:]))
        own.append((
            math.log1p(k), share(SYMBOLS, n), share(UPPER, n), min(share(MARKS, k), 4.0), share(DIGITS, n), len(set(words)) / k, repeats / k,
            min(n / k, 40.0), float(line.rstrip()[-1:] in (b".", b"!", b"?")), float(line in seen), min(share(STOPS, k), 2.0), float(k < 4),
        ))
        seen.add(line)
        lengths.append(n)
    return np.array(own, np.float32).reshape(-1, N_OWN), np.array(lengths, np.float64)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """lines by N_FEATURES of texts with so many lines each, one after the other."""
    x = np.zeros((len(own), N_FEATURES), np.float32)
    if len(own):
        ends = np.cumsum(counts)
        x[:, :N_OWN] = own
        x[1:, N_OWN : 2 * N_OWN] = own[:-1]
        x[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
        x[ends[:-1], N_OWN : 2 * N_OWN] = 0
        x[ends - 1, 2 * N_OWN : 3 * N_OWN] = 0
        x[:, -1] = 1
    return x


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines by N_FEATURES, lengths) of the lines with a word; a text without words has no line."""
    own, lengths = own_features(text)
    return with_neighbours(own, np.array([len(own)])), lengths


@dataclass
class LineModel:
    """weights: of a good line against a bad one; moves[i][j]: of state j after i; curve: intercept and slope."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]

    def marginals(self, x: np.ndarray) -> list[float]:
        """The probability that each line is good, by forward-backward over the whole text."""
        good = np.exp(np.clip(((x - self.mean) / self.scale) @ self.weights, -30, 30)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        ahead, p, first = [], 0.5, True
        for e in good:
            b, g = (1.0, 1.0) if first else ((1 - p) * bb + p * gb, (1 - p) * bg + p * gg)
            p, first = g * e / (b + g * e), False
            ahead.append(p)
        out, u, v = [0.0] * len(good), 1.0, 1.0  # u, v: what the lines after this one say of bad and good
        for i in range(len(good) - 1, -1, -1):
            g, b = ahead[i] * v, (1 - ahead[i]) * u
            out[i] = g / (g + b)
            u, v = bb * u + bg * good[i] * v, gb * u + gg * good[i] * v
            u, v = u / (u + v), v / (u + v)
        return out

    def share(self, text: str | None) -> float | None:
        """The share of the text in good lines; None for a text without words."""
        x, lengths = line_features(text)
        return float(lengths @ np.array(self.marginals(x)) / lengths.sum()) if len(x) else None

    def score(self, text: str | None) -> float:
        """0 to 1; a text without words gets the middle of the curve."""
        share = self.share(text)
        z = self.curve[0] + self.curve[1] * ((0.5 if share is None else share) - 0.5)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _grouped(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the lines, text by line; which of them are lines) of texts whose longest has at most twice the lines
    of the shortest (or 16), so that long ones pad no short ones."""
    order, begins = np.argsort(counts, kind="stable"), np.cumsum(counts) - counts
    while len(order):
        n = int(np.searchsorted(counts[order], max(16, 2 * counts[order[0]]), "right"))
        some, order = order[:n], order[n:]
        at = np.arange(counts[some].max())
        on = at < counts[some][:, None]
        yield np.where(on, begins[some][:, None] + at, 0), on


def _chain(s: np.ndarray, on: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good lines, expected counts of the moves and the sum of the log normalisers, over padded texts."""
    n, t = s.shape
    s = s.astype(np.float64)
    top = np.maximum(s, 0)
    e, m = np.exp(np.stack([-top, s - top], axis=2)), np.exp(moves)
    a, b, norms = np.zeros((n, t, 2)), np.ones((n, t, 2)), np.ones((n, t))
    for i in range(t):
        a[:, i] = e[:, 0] if i == 0 else (a[:, i - 1] @ m) * e[:, i]
        norms[:, i] = a[:, i].sum(axis=1)
        a[:, i] /= norms[:, i, None]
    pairs = np.zeros((2, 2))
    for i in range(t - 2, -1, -1):
        back = e[:, i + 1] * b[:, i + 1]
        q = a[:, i, :, None] * m * back[:, None, :]
        q /= q.sum(axis=(1, 2), keepdims=True)
        pairs += q[on[:, i + 1]].sum(axis=0)
        step = back @ m.T
        b[:, i] = np.where(on[:, i + 1, None], step / step.sum(axis=1, keepdims=True), 1.0)
    p = a * b
    return p[:, :, 1] / p.sum(axis=2), pairs, float((np.log(norms) + top)[on].sum())


def _expect(s: np.ndarray, on: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good lines, and expected counts of the moves, over padded texts."""
    return _chain(s, on, moves)[:2]


@dataclass
class Block:
    """Some labelled texts, their lines one after the other. good: which lines are taken for good."""

    counts: np.ndarray
    labels: np.ndarray
    own: np.ndarray
    lengths: np.ndarray
    good: np.ndarray

    SCHEMA = "counts binary, labels binary, own binary, lengths binary, good binary"

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Iterator[Block]:
        kinds = (np.int64, np.int8, np.float32, np.float64, bool)
        for i in range(batch.num_rows):
            counts, labels, own, lengths, good = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(batch.columns, kinds, strict=True))
            yield cls(counts, labels, own.reshape(-1, N_OWN), lengths, good)

    def row(self) -> pa.RecordBatch:
        parts = (self.counts.astype(np.int64), self.labels.astype(np.int8), self.own.astype(np.float32), self.lengths.astype(np.float64), self.good.astype(bool))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in parts], ["counts", "labels", "own", "lengths", "good"])

    @property
    def begins(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    @property
    def text(self) -> np.ndarray:
        """The text of each line."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def marginals(self, s: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """As _chain, over lines with scores s; marginals line by line."""
        p, pairs, norm = np.zeros(len(s)), np.zeros((2, 2)), 0.0
        for at, on in _grouped(self.counts):
            mine, moved, z = _chain(np.where(on, s[at], 0), on, moves)
            p[at[on]], pairs, norm = mine[on], pairs + moved, norm + z
        return p, pairs, norm


def blocks(docs: DataFrame, known: DataFrame) -> DataFrame:
    """All rows of docs whose id has a label in known (a table of written()), as a table of Blocks of about BLOCK lines.

    Rows of one id count one by one. Texts stay where they lie: few labels are broadcast to them, else the features of
    all texts meet the labels.
    """
    rows, few = docs.select(F.col("doc_id"), F.col("text").cast("string")), seen(known) <= MOST_BROADCAST
    if few:
        rows = rows.join(F.broadcast(known), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [own_features(t.as_py()) for t in b.column("text")]
            own, lengths = (pa.array([part.tobytes() for part in parts], pa.binary()) for parts in ([f[0] for f in found], [f[1] for f in found]))
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), own, lengths], [*rest, "own", "lengths"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        n = 0

        def block() -> pa.RecordBatch:
            counts, labels = np.array([len(x) // 8 for _, _, x in held]), np.array([y for y, _, _ in held])
            own, lengths = (np.frombuffer(b"".join(h[i] for h in held), t) for i, t in ((1, np.float32), (2, np.float64)))
            return Block(counts, labels, own, lengths, np.repeat(labels == 1, counts)).row()

        for b in batches:
            for y, own, lengths in zip(*(b.column(c).to_pylist() for c in ("label", "own", "lengths")), strict=True):
                if not lengths:
                    continue
                held.append((y, own, lengths))
                n += len(lengths) // 8
                if n >= BLOCK:
                    yield block()
                    held.clear()
                    n = 0
        if held:
            yield block()

    kept = [f for f in rows.schema.fields if f.name != "text"]
    rows = rows.mapInArrow(describe, T.StructType([*kept, T.StructField("own", T.BinaryType()), T.StructField("lengths", T.BinaryType())]))
    if not few:
        rows = rows.join(known.hint("merge"), "doc_id")
    return written(rows.select("label", "own", "lengths").mapInArrow(pack, Block.SCHEMA), "line-blocks")


def totals(table: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of a table of the `size` numbers that `each` makes of one; a row a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            out += each(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    return sum((np.frombuffer(r.sums) for r in table.mapInArrow(run, "sums binary").collect()), np.zeros(size))


def least(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, inverse: np.ndarray, steps: int = 80, enough: float = 1e-4) -> np.ndarray:
    """Where a smooth convex function over 0 (value and gradient) is least, by L-BFGS from x.

    inverse: about the inverse of its second derivatives. It ends when a step promises less than that share of the value.
    """
    past: list[tuple[np.ndarray, np.ndarray]] = []
    f, g = value(x)
    for _ in range(steps):
        d, parts = g.copy(), []
        for s, y in reversed(past):
            parts.append(s @ d / (y @ s))
            d -= parts[-1] * y
        d = inverse @ d
        for (s, y), part in zip(past, reversed(parts), strict=True):
            d += s * (part - y @ d / (y @ s))
        size = 1.0
        if g @ d < enough * f:
            break
        while (new := value(x - size * d))[0] > f - 1e-4 * size * (g @ d):
            size /= 2
            if size < 1e-6:
                return x
        s, y = -size * d, new[1] - g
        if y @ s > 0:
            past = [*past[-11:], (s, y)]
        x, (f, g) = x + s, new
    return x


def train(table: DataFrame, prior: float, rounds: int = 2, decay: float = 1e-3) -> LineModel | None:
    """Fit the field to the whole texts of a table of blocks() whose lines all start with the text's label.

    After each round, lines of bad texts that look good are taken for good (the heaviest suspect stays bad), since
    bad texts also hold ordinary lines. prior: the share of label 1 among all labelled rows. Every step sums the
    gradient over all texts where they lie; only sums reach the driver. None where one class has no text.
    """

    def moments(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(2 + N_FEATURES**2)
        for k in Block.of(b):
            x = with_neighbours(k.own, k.counts).astype(np.float64)
            out += np.concatenate([np.bincount(k.labels, minlength=2), (x.T @ x).ravel()])
        return out

    sums = totals(table, moments, 2 + N_FEATURES**2)
    texts, products = sums[:2], sums[2:].reshape(N_FEATURES, N_FEATURES)
    if not texts.all():
        discard(table)
        return None
    lines = products[-1, -1]  # the last feature is 1
    mean = products[-1] / lines
    spread = products / lines - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0)) + 1e-3
    mean[-1], scale[-1], spread[-1, -1] = 0, 1, 1
    curved = np.zeros((N_FEATURES + 4, N_FEATURES + 4))  # second derivatives of a field without moves, at most
    curved[:N_FEATURES, :N_FEATURES] = spread / np.outer(scale, scale) / 4
    curved[N_FEATURES:, N_FEATURES:] = np.eye(4) / 4
    inverse = np.linalg.inv(curved + decay * np.eye(len(curved)))
    theta, old = np.zeros(N_FEATURES + 4), [table]
    for r in range(rounds):

        def value(at: np.ndarray, table: DataFrame = table) -> tuple[float, np.ndarray]:
            w, moves = at[:N_FEATURES], at[N_FEATURES:].reshape(2, 2)

            def gains(b: pa.RecordBatch) -> np.ndarray:
                out = np.zeros(1 + N_FEATURES + 4)
                for k in Block.of(b):
                    x = (with_neighbours(k.own, k.counts) - mean) / scale
                    s, y = x @ w, k.good.astype(np.int64)
                    p, pairs, norm = k.marginals(s, moves)
                    inner = np.ones(len(y), bool)
                    inner[k.begins] = False
                    seen_pairs = np.bincount(2 * y[:-1][inner[1:]] + y[1:][inner[1:]], minlength=4)
                    out += np.concatenate([[s @ y + seen_pairs @ moves.ravel() - norm], (y - p) @ x, seen_pairs - pairs.ravel()])
                return out

            sums = totals(table, gains, 1 + N_FEATURES + 4) / lines
            return float(decay / 2 * at @ at - sums[0]), decay * at - sums[1:]

        theta = least(value, theta, inverse)
        w, moves = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        if r < rounds - 1:

            def renew(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, moves: np.ndarray = moves) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for k in Block.of(b):
                        p, _, _ = k.marginals(((with_neighbours(k.own, k.counts) - mean) / scale) @ w, moves)
                        bad = k.labels[k.text] == 0
                        suspect = (1 - p) * k.lengths
                        order = np.lexsort((np.arange(len(p)), -suspect, k.text))
                        good = np.where(bad, p > 0.5, k.good)
                        first = order[k.begins]
                        good[first[bad[first]]] = False
                        yield Block(k.counts, k.labels, k.own, k.lengths, good).row()

            table = written(table.mapInArrow(renew, Block.SCHEMA), "line-blocks")
            old.append(table)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in Block.of(b):
                p, _, _ = k.marginals(((with_neighbours(k.own, k.counts) - mean) / scale) @ w, moves)
                good = np.add.reduceat(p * k.lengths, k.begins) / np.add.reduceat(k.lengths, k.begins)
                yield pa.RecordBatch.from_arrays([pa.array(k.labels.astype(np.float64)), pa.array(good)], ["label", "share"])

    share = written(table.mapInArrow(shares, "label double, share double"), "line-shares")
    discard(*old)
    weight = np.array([(1 - prior) / texts[0], prior / texts[1]])

    def logistic(c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def gains(b: pa.RecordBatch) -> np.ndarray:
            y, v = b.column(0).to_numpy(), b.column(1).to_numpy() - 0.5
            z, each = np.stack([np.ones(len(v)), v], axis=1), weight[y.astype(int)]
            a = z @ c
            q = 1 / (1 + np.exp(-np.clip(a, -30, 30)))
            return np.concatenate([[each @ (np.logaddexp(0, a) - y * a)], z.T @ (each * (q - y)), (z.T @ (z * (each * q * (1 - q))[:, None])).ravel()])

        sums, ridge = totals(share, gains, 7), 0.5 / texts.sum()
        return float(sums[0] + ridge / 2 * c @ c), sums[1:3] + ridge * c, sums[3:].reshape(2, 2) + ridge * np.eye(2)

    c = np.zeros(2)
    f, g, h = logistic(c)
    for _ in range(50):  # Newton steps, halved while they gain nothing
        d, size = np.linalg.solve(h, g), 1.0
        if g @ d < 1e-12:
            break
        while (new := logistic(c - size * d))[0] > f and size > 1e-6:
            size /= 2
        c, (f, g, h) = c - size * d, new
    discard(share)
    return LineModel(mean, scale, w, moves, (float(c[0]), float(c[1])))


def fit(docs: DataFrame, labels: DataFrame) -> LineModel:
    """Learn from every labelled document that isn't held out.

    Their lines stay on the executors; only sums reach the driver. With no labelled rows of one class, the model is
    neutral: every document scores the prior (one half without any label).
    """
    known = written(known_labels(labels, "quality"), "labels")
    mean = labels.filter(~is_held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).agg(F.avg("quality").alias("m")).first().m
    prior = min(0.999, max(0.001, float(0.5 if mean is None else mean)))
    model = train(blocks(docs, known), prior)
    discard(known)
    return model or LineModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)), (math.log(prior / (1 - prior)), 0.0))


def with_quality(docs: DataFrame, model: LineModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the double column `out`; every whole text is scored where it lies, however long.

    Null and empty texts get the curve's middle. Rows, their order and all other columns stay as they are; where docs
    has a column `out`, the score takes a spare name (an underscore before it).
    """
    at, out = docs.columns.index(text_col), free_name(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.score(t.as_py()) for t in b.column(at)], pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(run, appended(docs, (out, T.DoubleType())))


def keep_good(docs: DataFrame, model: LineModel, least: float = 0.7) -> DataFrame:
    """The rows of docs that score `least` or more, columns as they were."""
    score = spare_name(docs, "score")
    return with_quality(docs, model, out=score).filter(F.col(score) >= least).select(*docs.columns)


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op7_line_crf": op7_line_crf}
ORACLE_SQL: dict[str, str] = {}
