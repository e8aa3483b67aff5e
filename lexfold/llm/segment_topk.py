"""Exact top-k search by inner product with multi-resolution segment statistics.

Components are quantised to floor(scale * x).  A vector is cut into 1, 4, 16, ...
segments, and each segment is described by its mean and its deviation from it.
For two segments of length l the inner product is at most
l * mean * mean' + deviation * deviation', which is to say that the squared
distance |q|^2 + |x|^2 - 2<q, x> is at least the distance between their
means and deviations.  A candidate goes from the coarse level to
the finer ones only while its bound reaches the k-th best score so far, and
survivors get their exact integer product.

Queries are a stated set of rows.  They are collected in blocks of bounded size;
each block is broadcast and meets every partition of candidates once, and only
the k best of each query leave a partition.  The queries of a block are candidates
of each other, so that the k-th best among them, found before the block is sent,
is a bound that prunes from the first candidate on.

Edge cases: vectors that are null or hold null or non-finite components take no
part; vectors meet only vectors of the same length; a query's own row is no
candidate, while other rows with its id are; ties go to the smaller id, null ids
last; repeated query rows each give their own result; with fewer than k
candidates all are returned; an empty table gives no rows; other columns are
ignored; scores beyond a long are clamped to its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfold.llm.common import cut, over_batches

#: Components of one block of queries together, about.
BLOCK_COMPONENTS = 1 << 19
#: Segments at the first level, and how many times more at each next.
FIRST, FACTOR = 1, 4
#: Candidates compared at once.
STRIPE = 512
_LONG = (1 << 63) - 1


def quantised(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as float64 if all products are exact in it, else as Python integers."""
    q = np.floor(rows.astype(np.float64) * scale)
    most = float(np.abs(q).max(initial=0))
    if most * most * max(1, rows.shape[1]) < 2.0**52:
        return q
    return np.array([[int(x) for x in row] for row in q.tolist()], dtype=object).reshape(rows.shape)


def levels(dim: int) -> list[np.ndarray]:
    """Where the segments begin, coarse to fine; the finest has two components or more to a segment."""
    out, n = [], FIRST
    while n <= max(1, dim // 2):
        out.append(np.unique(np.linspace(0, dim, n + 1).astype(np.int64)[:-1]))
        n *= FACTOR
    return out


def statistics(v: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Means (times the root of the length) and deviations of each segment; the inner product of two rows' bounds that of the vectors."""
    length = np.diff(np.append(begins, v.shape[1]))
    mean = np.add.reduceat(v, begins, axis=1) / length
    square = np.add.reduceat(v * v, begins, axis=1) - mean * mean * length
    return np.hstack([mean * np.sqrt(length), np.sqrt(np.maximum(square, 0))])


@dataclass
class Block:
    """Queries of one length: numbers, ids, quantised vectors."""

    numbers: np.ndarray
    vectors: np.ndarray
    #: Scores that each query's k-th best reaches at least.
    known: np.ndarray

    def prepare(self, k: int) -> None:
        dim = self.vectors.shape[1]
        self.exact = self.vectors.dtype != object and dim > 0
        self.levels = levels(dim) if self.exact else []
        self.stats = [statistics(self.vectors, b) for b in self.levels]
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1)) if self.exact else None
        n = len(self.numbers)
        self.k = k
        self.least = self.known.copy()
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 2), np.int64))]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take the candidates x (same length as the queries) into the best lists."""
        if not self.exact or x.dtype == object:
            scores = self.vectors.astype(object) @ x.astype(object).T if x.shape[1] else np.zeros((len(self.numbers), len(x)), object)
            i, j = np.nonzero(np.ones(scores.shape, bool))
            self._take(i, np.array([min(max(int(s), -_LONG - 1), _LONG) for s in scores[i, j]], object), ids[j])
            return
        norm = np.sqrt((x * x).sum(axis=1))
        slack = 1e-9 * self.norm[:, None] * norm[None, :] + 1e-6
        alive = np.ones((len(self.numbers), len(x)), bool)
        pairs = None
        for begins, stats in zip(self.levels, self.stats):
            mine = statistics(x, begins)
            if pairs is None:
                alive &= stats @ mine.T + slack >= self.least[:, None]
                if alive.sum() * 8 < alive.size:
                    pairs = np.nonzero(alive)
            else:
                i, j = pairs
                bound = np.einsum("ij,ij->i", stats[i], mine[j]) + slack[i, j]
                keep = bound >= self.least[i]
                pairs = i[keep], j[keep]
        if pairs is None:
            scores = self.vectors @ x.T
            i, j = np.nonzero(alive)
            s = scores[i, j]
        else:
            i, j = pairs
            s = np.einsum("ij,ij->i", self.vectors[i], x[j])
        keep = s >= self.least[i]
        self._take(i[keep], s[keep], ids[j[keep]])

    def _take(self, i: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        if not len(i):
            return
        old = self.best[0]
        i, s, ids = np.concatenate([old[0], i]), np.concatenate([old[1], s]), np.concatenate([old[2], ids])
        order = np.lexsort((ids[:, 1], ids[:, 0], -s, i)) if s.dtype != object else np.array(sorted(range(len(i)), key=lambda a: (i[a], -s[a], *ids[a])))
        i, s, ids = i[order], s[order], ids[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < self.k
        i, s, ids, rank = i[keep], s[keep], ids[keep], rank[keep]
        self.best[0] = i, s, ids
        full = rank == self.k - 1
        self.least[i[full]] = np.maximum(self.least[i[full]], s[full].astype(np.float64))


def seeds(vectors: np.ndarray, k: int) -> np.ndarray:
    """What the k-th best of each query reaches among the other queries of its block, which are candidates themselves; none is known where they are fewer."""
    n = len(vectors)
    out = np.full(n, -np.inf)
    if vectors.dtype == object or n <= k or not vectors.shape[1]:
        return out
    for at in range(0, n, STRIPE):
        scores = vectors[at : at + STRIPE] @ vectors.T
        scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
        out[at : at + STRIPE] = np.partition(scores, n - k, axis=1)[:, n - k]
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the batch's rows, for each length of vector; an id is a pair, whether it is null, which sorts last, and itself."""
    ids = np.array([(1, 0) if i is None else (0, i) for i in batch.column(0).to_pylist()], np.int64).reshape(-1, 2)
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    length = np.diff(offsets)
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for n in np.unique(length):
        at = np.nonzero(length == n)[0]
        yield ids[at], values[offsets[at][:, None] + np.arange(n)[None, :]] if n else np.zeros((len(at), 0))


def _pass(block, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for dim, (numbers, vectors, known) in block.value.items():
            held[dim] = Block(numbers, vectors, known)
            held[dim].prepare(k)
        for b in batches:
            for ids, x in _rows(b):
                if x.shape[1] in held:
                    for at in range(0, len(x), STRIPE):
                        held[x.shape[1]].meet(ids[at : at + STRIPE], quantised(x[at : at + STRIPE], scale))
        for h in held.values():
            i, s, ids = h.best[0]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(h.numbers[i]), pa.array([None if null else x for null, x in ids.tolist()], pa.int64()), pa.array([int(x) for x in s.tolist()], pa.int64())], names=["number", "vec", "score"])

    return run


def top_k(df: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its k best other rows."""
    spark = df.sparkSession
    usable = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = df.where(usable).select(F.col(id).cast("bigint").alias("vec"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    asked = rows.where("asks").select("vec", "x")
    size = asked.agg(F.coalesce(F.sum(F.size("x") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_COMPONENTS))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec", "x"), F.lit(blocks)) == b).toArrow()
        ids, held, at = [], {}, 0
        for batch in part.combine_chunks().to_batches():
            for own, x in _rows(batch):
                numbers = np.arange(at, at + len(own))
                at += len(own)
                ids.append(own)
                held.setdefault(x.shape[1], []).append((numbers, x))
        if not at:
            continue
        merged = {d: (np.concatenate([n for n, _ in x]), quantised(np.concatenate([v for _, v in x]), scale)) for d, x in held.items()}
        own = np.concatenate(ids)
        selves = np.zeros(at, object)
        for n, v in merged.values():
            selves[n] = [min(sum(int(c) * int(c) for c in row), _LONG) for row in v.tolist()]
        merged = {d: (n, v, seeds(v, k)) for d, (n, v) in merged.items()}
        shared = spark.sparkContext.broadcast(merged)
        # one more than k, as a query's own row is still among them
        best = over_batches(rows.select("vec", "x"), _pass(shared, k + 1, scale), "number bigint, vec bigint, score bigint")
        asks = spark.createDataFrame([(n, None if i[0] else i[1], int(s)) for n, (i, s) in enumerate(zip(own.tolist(), selves.tolist()))], "number bigint, query bigint, self bigint")
        order = [F.desc("score"), F.asc_nulls_last("vec")]
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(f"nth <= {k + 1}")
        best = best.join(F.broadcast(asks), "number").withColumn("own", F.col("vec").eqNullSafe(F.col("query")) & (F.col("score") == F.col("self")))
        best = best.withColumn("own", F.col("own") & (F.row_number().over(Window.partitionBy("number", "own").orderBy("nth")) == 1)).where("not own")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy("nth"))).where(f"rank <= {k}")
        best = best.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")
        if blocks > 1:
            best = cut(best)
            shared.unpersist()
        found = best if found is None else found.union(best)
    return found if found is not None else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
