"""Toxicity: noisy-channel deobfuscation, then a score of the restored words.

A character trigram model, counted over all documents, says how likely a spelling is. Tokens with look-alike
characters, long repetitions or single spaced letters become lattices of what each character may stand for, and
Viterbi decoding picks the likeliest path. Restored words and their first letters are the features of a logistic
score, learnt from a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import appended, discard, free_name, is_held_out, labelled_sample, read, written

#: Bounds: labelled documents of each class, learnt features, tokens that a worker remembers (no result depends on it).
PER_CLASS, MOST_FEATURES, REMEMBER = 4000, 4000, 500_000
#: Documents of label 1 that a feature must be in.
MIN_TOXIC = 4
#: Letters of the model (others count as one more letter, everything else as a gap), look-alikes.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
EDGE = ".,;:!?*%&#|\"'`´()[]{}<>«»“”‘’…~^=/\\_-"
K = len(LETTERS) + 2
CODE = np.zeros(0x250, np.int64)
CODE[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
INDEX = {c: i for i, c in enumerate(LETTERS, 1)}
RUN = regex.compile(r"(\p{L})\1{2,}")
SPACED = regex.compile(r"(?:\p{L}|[0-9@$!|+])(?:[.\-_*~](?:\p{L}|[0-9@$!|+])){2,}")
MIXED = regex.compile(r"\p{L}[0-9@$!|+*]+\p{L}|^[0-9@$|+]+\p{L}|\p{L}[0-9@$]+$")


def codes(text: str) -> np.ndarray:
    """Each character's number in the model: 0 gap, 1.. LETTERS, the last one any other letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = CODE[np.minimum(points, len(CODE) - 1)]
    for i in np.flatnonzero(points >= len(CODE)) if points.max(initial=0) >= len(CODE) else ():
        out[i] = K - 1 if chr(points[i]).isalpha() else 0
    return out


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts, K x K x K; tasks send one row for each that they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for b in batches:
            texts, held, size = [t.as_py() or "" for t in b.column(0)], [], 0
            for i, t in enumerate(texts):
                held.append(t)
                size += len(t)
                if size > 1 << 20 or i == len(texts) - 1:
                    c = codes("  ".join(held).lower())
                    held, size = [], 0
                    if len(c) > 2:
                        total += np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    counts = np.zeros(K**3, np.int64)
    summed = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # at most K ** 3 rows, however many texts
        counts[r.gram] = r.n
    return counts.reshape(K, K, K)


class Restorer:
    """Decodes tokens under the character model."""

    def __init__(self, counts: np.ndarray):
        tri = counts.astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + K)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()

    def units(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """What each place of the token may stand for, with the channel's costs; a space is a gap between words."""
        i, n = 0, len(token)
        spaced = SPACED.fullmatch(token) is not None
        letters = [k for k in (next((k for k in r if token[k].isalpha()), None) for r in (range(n), range(n - 1, -1, -1))) if k is not None]
        while i < n:
            c, j = token[i], i + 1
            while j < n and token[j] == c:
                j += 1
            if c.isalpha():
                if j - i > 2:
                    yield [(c, 1.0)]
                    yield [("", 0.5), (c, 1.0)]
                else:
                    yield from ([(c, 0.0)],) * (j - i)
            else:
                inside = bool(letters) and letters[0] < i and letters[-1] >= j
                for _ in range(j - i):
                    looks = [(x, 1.0 + math.log(len(LOOKS[c]))) for x in LOOKS.get(c, "")]
                    gap = [("", 0.2), (" ", 3.0)] if spaced and c in ".-_*~ " else [("", (9.0 if inside else 4.0) if looks else 1.0)]
                    yield looks + gap if not (spaced and c in ".-_~ ") else gap
            i = j

    def decode(self, token: str) -> str:
        """The likeliest reading: Viterbi over the last two characters.

        What all readings begin with is set aside now and then, so that a token costs its length, however long it is.
        """
        cost, best, read = self.cost, {(0, 0): (0.0, "")}, []
        for step, options in enumerate(self.units(token)):
            if step % 64 == 63:
                k = len(commonprefix([text for _, text in best.values()]))
                read.append(next(iter(best.values()))[1][:k])
                best = {state: (total, text[k:]) for state, (total, text) in best.items()}
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (total, text) in best.items():
                for x, extra in options:
                    if x:
                        k = INDEX.get(x, K - 1 if x.isalpha() else 0)
                        state, value = (b, k), (total + extra + cost[a][b][k], text + x)
                    else:
                        state, value = (a, b), (total + extra, text)
                    if state not in after or value < after[state]:
                        after[state] = value
            best = after
        return "".join(read) + min((total + cost[a][b][0], text) for (a, b), (total, text) in best.items())[1]

    def words(self, token: str) -> list[str]:
        """The words of one lower-case token (or of a run of single letters, joined by spaces)."""
        core = token.strip(EDGE)
        if core.isalpha():
            return self.decode(core).split() if RUN.search(core) else [core]
        if not any(c.isalpha() for c in core):
            return []
        if SPACED.fullmatch(core) or " " in core or MIXED.search(core) or RUN.search(core):
            return self.decode(core.replace(" ", "~") if " " in core else core).split()
        return regex.findall(r"\p{L}+", core)


def tokens(text: str) -> set[str]:
    """The distinct lower-case tokens of a text; three or more single characters in a row are one token."""
    parts = text.lower().split()
    lengths = bytes([min(len(p), 2) for p in parts])
    found, at = set(parts), lengths.find(b"\1\1\1")
    while at >= 0:
        end = at
        while end < len(lengths) and lengths[end] == 1:
            end += 1
        found.add(" ".join(parts[at:end]))
        at = lengths.find(b"\1\1\1", end)
    return found


def features(words: list[str]) -> set[str]:
    """A word counts as itself and by its first four to seven letters, which catch forms that were never seen."""
    return {w for w in words if len(w) > 2} | {f"{w[:k]}-" for w in words for k in range(4, min(8, len(w)))}


@dataclass
class ToxicModel:
    restorer: Restorer
    weights: dict[str, float]
    bias: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"restorer": self.restorer, "weights": self.weights, "bias": self.bias, "known": {}}

    def hits(self, text: str | None) -> set[str]:
        """The features of the model that a whole text has."""
        known, out = self.known, set()
        if len(known) > REMEMBER:
            known.clear()
        for t in tokens(text or ""):
            h = known.get(t)
            if h is None:
                h = known[t] = tuple(f for f in features(self.restorer.words(t)) if f in self.weights)
            if h:
                out.update(h)
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(self.hits(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _feature_counts(sample: DataFrame, restorer: Restorer) -> DataFrame:
    """feature, toxic, clean: documents of the sample that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = (Counter(), Counter())
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counts[label].update(features([w for t in tokens(text.as_py() or "") for w in restorer.words(t)]))
            keys = list({*counts[0], *counts[1]})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[k][x] for x in keys], pa.int64()) for k in (1, 0))], ["feature", "toxic", "clean"])

    return sample.select("text", "label").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(rows: list[tuple[list[int], int]], n_features: int, prior: float, steps: int = 300, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic weights, none below zero, and bias; classes weigh as in all labelled rows."""
    y = np.array([label for _, label in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(h) for h, _ in rows])
    hit = np.array([f for h, _ in rows for f in h], np.int64)
    each = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    w, b = np.zeros(n_features), math.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for k in range(1, steps + 1):
        z = b + np.bincount(doc, w[hit], len(rows))
        g = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gb = np.bincount(hit, g[doc], n_features) + decay * w / len(w) ** 0.5, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w = np.maximum(w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6), 0)
        b -= 0.05 * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.99**k)) + 1e-6)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = MOST_FEATURES) -> ToxicModel:
    """The character model from all texts, the score from at most per_class labelled documents of each class.

    Equal texts of the sample count once. With no labelled rows of one class every document scores the prior (one
    half without any label).
    """
    restorer = Restorer(count_trigrams(docs))
    known = labels.filter(~is_held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic").alias("m")).first()
    prior = min(0.999, max(0.001, float(0.5 if known.m is None else known.m)))
    ids = labelled_sample(labels, "toxic", per_class)
    sample = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(ids), "doc_id").groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text"))
    sample = written(sample, "toxic-sample")  # at most 2 * per_class texts, read four times
    counts = _feature_counts(sample, restorer)
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    rate = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * (n.get(0, 0) + 1) / (n.get(1, 0) + 1)
    best = counts.filter((F.col("toxic") >= MIN_TOXIC) & (rate > 12)).orderBy((F.col("toxic") * F.log(rate)).desc(), "feature").limit(most)
    names = [r.feature for r in best.select("feature").collect()]
    model = ToxicModel(restorer, dict.fromkeys(names, 0.0), math.log(prior / (1 - prior)))
    if names:
        number = {f: i for i, f in enumerate(names)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = [sorted(number[f] for f in model.hits(t.as_py())) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int64())), b.column(2)], ["h", "hits", "label"])

        rows = sample.select("h", "text", "label").mapInArrow(run, "h long, hits array<long>, label int").collect()
        w, model.bias = train([(r.hits, r.label) for r in sorted(rows, key=lambda r: (r.h, r.label))], len(names), prior)
        model.weights = {f: float(x) for f, x in zip(names, w.tolist(), strict=True) if x > 0.01}
        model.known.clear()
    discard(sample)
    return model


def with_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the double column `out` (0 to 1); every whole text is read where it lies, however long.

    Null and empty texts have no feature and score the bias. Rows and all other columns stay as they are; where docs
    has a column `out`, the score takes a spare name (an underscore before it).
    """
    at, out = docs.columns.index(text_col), free_name(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.score(t.as_py()) for t in b.column(at)], pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(run, appended(docs, (out, T.DoubleType())))


def op3_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op3_noisy_channel": op3_noisy_channel}
ORACLE_SQL: dict[str, str] = {}
