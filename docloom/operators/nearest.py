"""Nearest neighbours without a full scan: vectors stored by cell, cells probed until the best n are proven.

Cells come from k-means over unit vectors. A vector of a cell lies between the least and the largest distance of that cell's
vectors from its centre, so by the triangle inequality none is nearer to a question than its distance from the centre less
the largest, or the least less that distance. A question probes cells in the order of this bound and ends when no cell that
is left can hold anything as good as its n-th result: the results are those of a scan of everything.

scan() is that scan, without an index: questions and vectors meet as matrices, in groups of bounded size. closest() ranks
numbers by their distance in groups of neighbours.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.retrieval import TOP_N, length, top, vector_search
from docloom.sources.shared import delete, stored

#: Vectors for each cell in the sample on which k-means is fit, about; the most cells; its rounds.
FIT, MOST_CELLS, ROUNDS = 256, 4096, 6
#: Vectors compared with all centres at once.
AT_ONCE = 1024
#: Vectors and questions that are compared in one group; larger cells are cut into chunks, each two of which meet.
CHUNK = 4096
#: Scores are rounded to six places; bounds allow for that and for rounding of distances.
SLACK = 1e-6
#: Numbers in the vectors of one group of a scan, the most questions of one, and those compared at once; with fewer vectors
#: than SCAN_LEAST a group isn't cut for the sake of idle cores.
SCAN_VALUES, SCAN_QUERIES, SCAN_ROWS, SCAN_LEAST = 1 << 22, 16_384, 64, 1024
#: Pairs whose exact scores are taken at once.
EXACT = 1 << 16
#: Numbers in one group of closest(), about, and the most groups.
CLOSE, MOST_GROUPS = 16_384, 1000


@dataclass
class Cells:
    """An index at a path: centres (cells x dimensions), and rows, least and largest distance of each cell."""

    path: str
    centres: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    schema: T.StructType
    #: What searches have read: rounds, vectors scanned, pairs of question and vector scored.
    reads: list[dict] = field(default_factory=list)

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each unit vector and its distance."""
    squares = (centres**2).sum(axis=1)
    cells = np.empty(len(units), np.int32)
    for i in range(0, len(units), AT_ONCE):
        part = units[i : i + AT_ONCE]
        cells[i : i + AT_ONCE] = np.argmin(squares - 2 * part @ centres.T, axis=1)
    return cells, np.linalg.norm(units - centres[cells], axis=1)


def _sums(centres: np.ndarray):
    """(cell, n, sums) of a task's vectors: k-means moves one row a cell and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            units = _unit(_matrix(b.column(0), centres.shape[1]))
            cells, _ = _nearest(units, centres)
            np.add.at(total, cells, units)
            n += np.bincount(cells, minlength=len(centres))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["cell", "n", "sums"])

    return run


def fit(vectors: DataFrame, cells: int, rounds: int = ROUNDS, key: str = "vec_id", col: str = "embedding") -> np.ndarray:
    """Centres of k-means over the vectors of a table; at first they are the vectors whose keys have the least hashes."""
    first = vectors.select(col, F.xxhash64(key).alias("h")).orderBy("h").limit(cells).collect()
    centres = _unit(np.array([r[0] for r in first], dtype=np.float64))
    for _ in range(rounds):
        part = vectors.select(col).mapInArrow(_sums(centres), "cell int, n long, sums array<double>")
        by = part.select("cell", "n", F.posexplode("sums").alias("d", "x")).groupBy("cell", "d").agg((F.sum("x") / F.sum("n")).alias("x"))
        means = by.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean")).collect()
        for cell, mean in means:  # at most a row a cell; a cell that lost all its vectors keeps its centre
            centres[cell] = mean
    return centres


def build(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS, key: str = "vec_id", col: str = "embedding") -> Cells:
    """Write the index of a table with all its columns and return it.

    Centres are fit on about FIT vectors a cell, chosen by a hash of their key; every vector is stored. There are about as
    many cells as vectors in one, MOST_CELLS at most. Null vectors and those of length 0 have no cosine and are left out.
    Cells of any size are split over files, so no task writes a whole large one.
    """
    spark = vectors.sparkSession
    known = vectors.filter(F.coalesce(length(F.col(col)) > 0, F.lit(False)))
    total = known.count()
    cells = cells or int(min(MOST_CELLS, max(1, round(total**0.5))))
    cells = max(1, min(cells, total))
    share = min(1.0, FIT * cells / max(total, 1))
    sample, _, at = stored(known.filter(F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 30)) < int(share * (1 << 30))).select(key, col), "cells-sample")
    centres = fit(sample, cells, rounds, key, col) if total else np.zeros((0, 1))
    delete(spark, at)
    place = known.columns.index(col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = _nearest(_unit(_matrix(b.column(place), centres.shape[1])), centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "_distance_cell", "_distance"])

    schema = T.StructType([*known.schema.fields, T.StructField("_distance_cell", T.IntegerType()), T.StructField("_distance", T.DoubleType())])
    placed = known.mapInArrow(assign, schema).withColumnRenamed("_distance_cell", "cell")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    seen = spark.read.schema(placed.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("rows"), F.min("_distance").alias("low"), F.max("_distance").alias("high"))
    middle = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>")
    middle.join(seen, "cell", "left").fillna(0, ["rows"]).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(placed.schema.json(),)], "schema string").write.mode("overwrite").parquet(f"{path}/schema")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Cells:
    """The index that build() has written at a path: a row a cell is read."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    column = lambda name: np.array([np.nan if r[name] is None else r[name] for r in rows], dtype=np.float64)
    return Cells(path, np.array([r.centre for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0].centre) if rows else 1), column("rows").astype(np.int64), column("low"), column("high"), T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()[0])))


def _probes(index: Cells, enough: int):
    """(query_id, qvec, cells, done, seen, least): the cells that each question probes next; questions that are proven drop out.

    Input: query_id, qvec, least (the score of the n-th result so far, null if there are fewer), done (cells probed), seen
    (vectors in them). A round probes about as many vectors as all before it, `enough` at first.
    """
    centres, sizes = index.centres, index.rows
    low, high = np.where(sizes > 0, index.low, np.inf), np.where(sizes > 0, index.high, -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            units = _unit(_matrix(b.column(1), centres.shape[1]))
            least, done, seen = (b.column(i).to_pylist() for i in (2, 3, 4))
            for i, u in enumerate(units):
                far = np.linalg.norm(centres - u, axis=1)
                bound = np.maximum(0, np.maximum(far - high, low - far))
                order = np.lexsort((far, bound))
                order = order[: np.searchsorted(bound[order], np.inf)]  # cells without vectors come last
                if least[i] is not None:
                    reach = np.sqrt(max(0.0, 2 - 2 * (least[i] - SLACK))) + SLACK
                    order = order[: np.searchsorted(bound[order], reach, side="right")]
                rest = order[done[i] :]
                if len(rest):
                    new = np.cumsum(sizes[rest])
                    k = min(len(rest), int(np.searchsorted(new, max(enough, seen[i]))) + 1)
                    out.append((i, rest[:k].tolist(), done[i] + k, seen[i] + int(new[k - 1])))
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int64()), b.column(2).take(rows)], ["query_id", "qvec", "cells", "done", "seen", "least"])

    return run


def _raw_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows, with sums in the order in which retrieval.dot takes them, so that both give the same doubles."""

    def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
        return total

    return dots(v, q) / (np.sqrt(dots(v, v)) * np.sqrt(dots(q, q)))


def _scorer(n: int, key: str, col: str, same: list[tuple[str, str]], other: list[tuple[str, str]]):
    """(query_id, key, raw) of a chunk of vectors and one of questions: the n best of each question, and all as good as these.

    What can't be better than a question's n-th result so far (_least) is left out.
    """

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(vectors) and len(asked):
            matrix = lambda t, c: np.array(t.column(c).to_pylist(), dtype=np.float64)
            v, q = matrix(vectors, col), matrix(asked, "qvec")
            units, wanted = _unit(v), _unit(q)
            values = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
            for i in range(0, len(q), 256):
                some = slice(i, i + 256)
                near = wanted[some] @ units.T
                for pairs, equal in ((same, True), (other, False)):
                    for mine, theirs in pairs:
                        near[(values(vectors, mine)[None, :] == values(asked, theirs)[some, None]) != equal] = -np.inf
                least = np.partition(near, -n, axis=1)[:, -n] if len(v) > n else np.full(len(near), -np.inf)
                least = np.maximum(least, values(asked, "_least")[some])
                a, b = np.nonzero((near >= least[:, None] - 2 * SLACK) & (near > -np.inf))
                out.append((a + i, b, _raw_scores(v[b], q[a + i])))
        rows = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([asked.column("query_id").take(pa.array(rows[0])), vectors.column(key).take(pa.array(rows[1])), pa.array(rows[2])], ["query_id", key, "raw"])

    return run


def search(index: Cells, queries: DataFrame, n: int = TOP_N, same: list[tuple[str, str]] = (), other: list[tuple[str, str]] = (), key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(query_id, key, score, rnk) of the n best vectors of each question: exactly those of retrieval.vector_search.

    queries: query_id, qvec and the second columns of same and other. A vector counts for a question only if each pair of
    columns (of the vector, of the question) in `same` is equal and each in `other` differs, before anything is ranked; so a
    question whose scope is thin probes on until n of its vectors are found or no cell is left. Null matches nothing.
    Questions without a vector, or of length 0, have no results. Each round is one scan of the cells that some question asks
    for; pairs are compared as matrices, by chunks of cells, and never become rows. A number a cell reaches the driver;
    results are a table of n rows a question.
    """
    spark = queries.sparkSession
    known = F.coalesce(length(F.col("qvec")) > 0, F.lit(False))
    for _, theirs in (*same, *other):
        known = known & F.col(theirs).isNotNull()
    more = sorted({theirs for _, theirs in (*same, *other)} - {"query_id"})
    asked = queries.filter(known).select("query_id", "qvec", *more)
    fields = [T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("qvec", asked.schema["qvec"].dataType)]
    schema = T.StructType([*fields, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("done", T.IntegerType()), T.StructField("seen", T.LongType()), T.StructField("least", T.DoubleType())])
    of_vector = T.StructField(key, index.schema[key].dataType)
    state = asked.select("query_id", "qvec", F.lit(None).cast("double").alias("least"), F.lit(0).alias("done"), F.lit(0).cast("long").alias("seen"))
    vectors, best, old = index.vectors(spark), None, []
    for mine, _ in (*same, *other):
        vectors = vectors.filter(F.col(mine).isNotNull())
    vectors = vectors.select(*dict.fromkeys([key, col, "cell", *[mine for mine, _ in (*same, *other)]]))
    while len(index.rows):
        probes, left, at = stored(state.mapInArrow(_probes(index, 4 * n), schema), "cells-probes")
        old.append(at)
        if not left:
            break
        pairs = probes.select("query_id", "qvec", F.coalesce("least", F.lit(-2.0)).alias("_least"), F.explode("cells").alias("cell"))
        counts = dict(pairs.groupBy("cell").count().collect())
        index.reads.append({"vectors": int(sum(index.rows[c] for c in counts)), "pairs": int(sum(index.rows[c] * k for c, k in counts.items()))})
        parts = [(int(c), int(-(-index.rows[c] // CHUNK)), int(-(-k // CHUNK))) for c, k in counts.items()]  # a row a cell
        cut = F.broadcast(spark.createDataFrame(parts, "cell int, v_parts int, q_parts int"))
        dealt = lambda df, by, own, others: df.join(cut, "cell").withColumn(f"_{own}", F.pmod(F.xxhash64(by), F.col(f"{own}_parts"))).withColumn(f"_{others}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{others}_parts").cast("long") - 1))).drop("v_parts", "q_parts")
        pairs = pairs.join(asked.select("query_id", *more), "query_id") if more else pairs
        one = dealt(vectors.filter(F.col("cell").isin(list(counts))), key, "v", "q").groupBy("cell", "_v", "_q")
        two = dealt(pairs, "query_id", "q", "v").groupBy("cell", "_v", "_q")
        found = one.cogroup(two).applyInArrow(_scorer(n, key, col, list(same), list(other)), T.StructType([fields[0], of_vector, T.StructField("raw", T.DoubleType())]))
        found = found.select("query_id", key, F.round("raw", 6).alias("score"))
        found = found if best is None else found.unionByName(best.drop("rnk"))
        best, _, at = stored(top(found, "query_id", key, n), "cells-best")
        last = best.filter(F.col("rnk") == n).select("query_id", F.col("score").alias("least"))
        state = probes.select("query_id", "qvec", "done", "seen").join(last, "query_id", "left").select("query_id", "qvec", "least", "done", "seen")
        old.append(at)
    delete(spark, *[p for p in old if best is None or p != old[-2]])  # the last results stay
    if best is None:
        return spark.createDataFrame([], T.StructType([fields[0], of_vector, T.StructField("score", T.DoubleType()), T.StructField("rnk", T.IntegerType())]))
    return best


def _plain(col: str, dim: int) -> Column:
    """Whether a vector has the usual dimensions, finite numbers and a length that can be divided by."""
    x = F.col(col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < 1e100))
    return F.coalesce((F.size(x) == dim) & fine & (length(x) > 1e-100), F.lit(False))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order of retrieval.dot."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _first(rows: np.ndarray, keys: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """Places of what can be among the n best of each row: scores that may round alike stay, n at most of equal ones."""
    order = np.lexsort((keys, -raw, rows))
    r, s = rows[order], raw[order]
    at = np.arange(len(order))
    starts = lambda new: np.maximum.accumulate(np.where(np.concatenate(([True], new)), at, 0))
    row = starts(r[1:] != r[:-1])
    run = starts((r[1:] != r[:-1]) | (s[1:] != s[:-1]))
    last = s[np.minimum(row + n - 1, len(s) - 1)]
    ends = np.searchsorted(r, r, side="right")
    last = np.where(row + n <= ends, last, -np.inf)
    return order[(at - run < n) & (s >= last - 2 * SLACK)]


def _scanner(n: int, dim: int, key: str, col: str, same: list[tuple[str, str]], other: list[tuple[str, str]]):
    """(query_id, key, raw) of a group of vectors and one of questions: the n best of each question, and all as good as these.

    Single precision finds what can be among them: the n-th greatest of the greatest values of 4 n sets of vectors is a bound.
    """
    slack = 2 * (SLACK + dim * 2.0**-23)

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(vectors) and len(asked):
            v, q = (_matrix(t.column(c).combine_chunks(), dim) for t, c in ((vectors, col), (asked, "qvec")))
            v_length, q_length = np.sqrt(_dots(v, v)), np.sqrt(_dots(q, q))
            units, wanted = ((m / m_length[:, None]).astype(np.float32) for m, m_length in ((v, v_length), (q, q_length)))
            values = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
            equal = [(values(vectors, mine), values(asked, theirs)) for mine, theirs in same]
            apart = []
            for mine, theirs in other:
                own = values(vectors, mine)
                order = np.argsort(own, kind="stable")
                apart.append((order, *(np.searchsorted(own[order], values(asked, theirs), side=s) for s in ("left", "right"))))
            keys, sets, out = np.argsort(np.argsort(values(vectors, key), kind="stable"), kind="stable"), min(len(v), 4 * n), []
            for i in range(0, len(q), SCAN_ROWS):
                some = slice(i, min(i + SCAN_ROWS, len(q)))
                near = wanted[some] @ units.T
                for mine, theirs in equal:
                    near[mine[None, :] != theirs[some, None]] = -np.inf
                for order, low, high in apart:
                    for j in np.flatnonzero(low[some] < high[some]):
                        near[j, order[low[i + j] : high[i + j]]] = -np.inf
                wide = len(v) // sets
                best = near[:, : sets * wide].reshape(len(near), sets, wide).max(axis=2)
                least = np.partition(best, -n, axis=1)[:, -n] if sets >= n else np.full(len(near), -np.inf)
                places = np.flatnonzero(near >= np.maximum(least - slack, -2)[:, None].astype(np.float32))
                a, b = places // len(v) + i, places % len(v)
                raw = np.empty(len(a))
                for k in range(0, len(a), EXACT):
                    x, y = a[k : k + EXACT], b[k : k + EXACT]
                    raw[k : k + EXACT] = _dots(v[y], q[x]) / (v_length[y] * q_length[x])
                kept = _first(a, keys[b], raw, n) if len(a) else slice(0)
                out.append((a[kept], b[kept], raw[kept]))
            rows = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([asked.column("query_id").take(pa.array(rows[0])), vectors.column(key).take(pa.array(rows[1])), pa.array(rows[2])], ["query_id", key, "raw"])

    return run


def scan(queries: DataFrame, vectors: DataFrame, n: int = TOP_N, same: list[tuple[str, str]] = (), other: list[tuple[str, str]] = (), key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(query_id, key, score, rnk): every question is compared with every vector; the rows of retrieval.vector_search.

    queries: query_id, qvec and the second columns of same and other, which restrict the pairs as in search(). Vectors and
    questions are dealt to groups; each pair of groups is a product of matrices, and only what can be among the n best leaves
    it. Vectors that have no cosine, or other dimensions than the questions, are compared as rows.
    """
    spark = queries.sparkSession
    vectors = vectors.select(*dict.fromkeys([key, col, *[mine for mine, _ in (*same, *other)]]))
    queries = queries.select(*dict.fromkeys(["query_id", "qvec", *[theirs for _, theirs in (*same, *other)]]))
    dim = max(queries.agg(F.max(F.size("qvec"))).first()[0] or 0, 1)
    count = lambda df, c: df.agg(F.count("*"), F.count_if(_plain(c, dim))).first()
    (v_all, v_plain), (q_all, q_plain) = count(vectors, col), count(queries, "qvec")
    known, asked = vectors.filter(_plain(col, dim)), queries.filter(_plain("qvec", dim))
    for mine, theirs in (*same, *other):  # null matches nothing
        known, asked = known.filter(F.col(mine).isNotNull()), asked.filter(F.col(theirs).isNotNull())
    cut = lambda rows, most: max(1, -(-rows // most))
    v_parts = max(cut(v_plain, max(SCAN_LEAST, SCAN_VALUES // dim)), min(cut(v_plain, SCAN_LEAST), 8))
    q_parts = max(cut(q_plain, SCAN_QUERIES), min(cut(q_plain, 256), cut(spark.sparkContext.defaultParallelism, v_parts)))

    def dealt(df: DataFrame, by: str, own: int, others: int, group) -> DataFrame:
        each = df.withColumn("_own", F.pmod(F.xxhash64(F.lit(2), by), F.lit(own))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
        return each.withColumn("_group", group(F.col("_own"), F.col("_other"))).drop("_own", "_other").repartition(2 * v_parts * q_parts, "_group").groupBy("_group")

    one = dealt(known, key, v_parts, q_parts, lambda v, q: v * q_parts + q)
    two = dealt(asked, "query_id", q_parts, v_parts, lambda q, v: v * q_parts + q)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("raw", T.DoubleType())])
    found = one.cogroup(two).applyInArrow(_scanner(n, dim, key, col, list(same), list(other)), schema).select("query_id", key, F.round("raw", 6).alias("score"))
    rule = F.lit(True)
    for mine, theirs in same:
        rule = rule & (F.col(mine) == F.col(theirs))
    for mine, theirs in other:
        rule = rule & (F.col(mine) != F.col(theirs))
    rows = lambda q, v: vector_search(q, v.withColumnsRenamed({key: "vec_id", col: "embedding"}), n, rule).drop("rnk").withColumnRenamed("vec_id", key)
    if v_plain < v_all:
        found = found.unionByName(rows(queries, vectors.filter(~_plain(col, dim))))
    if q_plain < q_all:
        found = found.unionByName(rows(queries.filter(~_plain("qvec", dim)), vectors.filter(_plain(col, dim))))
    return top(found, "query_id", key, n)


def closest(queries: DataFrame, items: DataFrame, n: int = TOP_N, key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rnk): the n numbers of a table (key) nearest to each question's, other than it; ties to the smaller.

    score is the distance, negative. Numbers are cut into ranges with n in each at least, so those asked for are in a
    question's range and the ones beside it; at most MOST_GROUPS cuts and counts reach the driver.
    """
    ids = items.select(F.col(key).cast("long").alias("x")).filter("x is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("x")).filter("x is not null")
    parts = min(MOST_GROUPS, max(1, -(-ids.count() // CLOSE)))
    cuts = np.array([], np.int64)
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        cuts = np.unique(np.array(ids.agg(F.percentile_approx("x", shares, 20 * parts)).first()[0], np.int64))

    def placed(df: DataFrame, borders: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.searchsorted(borders, b.column(0).to_numpy(zero_copy_only=False), side="left")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32))], ["x", "g"])

        return df.mapInArrow(run, "x long, g int")

    sizes, kept, held = dict(placed(ids, cuts).groupBy("g").count().collect()), [], 0
    for g, cut in enumerate(cuts):  # a range up to each cut, with n numbers at least
        held += sizes.get(g, 0)
        if held >= n:
            kept.append(cut)
            held = 0
    if kept and held + sizes.get(len(cuts), 0) < n:
        kept.pop()
    borders = np.array(kept, np.int64)
    beside = F.explode(F.sequence(F.greatest(F.col("g") - 1, F.lit(0)), F.least(F.col("g") + 1, F.lit(len(borders)))))

    def nearest(numbers: pa.Table, wanted: pa.Table) -> pa.Table:
        x, q = np.sort(numbers.column("x").to_numpy()), wanted.column("x").to_numpy()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
        for i in range(0, len(q) if len(x) else 0, AT_ONCE):
            part = q[i : i + AT_ONCE, None]
            at = np.concatenate([np.searchsorted(x, part) + np.arange(-n, 0), np.searchsorted(x, part, side="right") + np.arange(n)], axis=1)
            there = (at >= 0) & (at < len(x))
            far = np.where(there, np.abs(x[np.clip(at, 0, len(x) - 1)] - part), np.iinfo(np.int64).max)
            order = np.argsort(far, axis=1, kind="stable")[:, :n]
            fits = np.take_along_axis(there, order, axis=1)
            a, b = np.nonzero(fits)
            for name, value in enumerate((part[a, 0], x[at[a, order[a, b]]], -far[a, order[a, b]], (b + 1).astype(np.int32))):
                out[name].append(value)
        return pa.table([pa.array(np.concatenate(c)) for c in out], ["query_id", key, "score", "rnk"])

    groups = 2 * (len(borders) + 1)
    one = placed(ids, borders).select("x", beside.alias("g")).repartition(groups, "g").groupBy("g")
    two = placed(asked, borders).repartition(groups, "g").groupBy("g")
    found = one.cogroup(two).applyInArrow(nearest, f"query_id long, {key} long, score long, rnk int")
    return found.withColumn("score", F.col("score").cast("double"))
