"""Nearest neighbours by collision-counting hashing with query-centred windows.

Vectors are dealt into blocks. In a block each of ``PROJECTIONS`` random lines gets one sorted array of
the vectors' projections; no buckets are fixed in advance. For a query, a window of half width R around
its own projection is opened in every array, and R grows step by step (virtual rehashing: only what is
new in the wider windows is counted). A vector that collides in enough arrays is verified with its
exact inner product. A vector at distance R collides in a line with the probability that a normal
deviate stays within one; the threshold lies so low that such a vector passes with a probability of
about 0.84, and nearer ones more often. The search stops once R reaches the distance of the k-th best
verified vector, so whatever could still displace it had that chance or a better one. Every row is
indexed, and R grows until k are found or all are verified. Largest inner product becomes smallest
distance by one added coordinate that gives all vectors of a block the length of its longest.

Each block's rows arrive at one task, sorted before the queries that come to it: the task builds the
block's arrays once and streams the queries past them, a batch at a time. Only queries are copied, once a
block. Each block gives back k rows a query; their best k are ranked by a window over each query.

Defined results: vectors that are null or empty, have null or non-finite components or no length, or have a null
id take no part. Vectors of different lengths are not compared. A query has no neighbour of its own id;
rows repeated with one id count once, by their best score. Equal scores go by the smaller id. With no more
than k candidates all are found. Columns beyond the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PROJECTIONS, GROWTH = 128, 1.04
#: The first radius is this share of the median distance to the k-th nearest of ``PROBES`` vectors of the block.
FIRST, PROBES = 0.97, 16
#: Vectors of a block on average, and queries that are counted side by side.
BLOCK, BATCH = 16_384, 128
#: Collisions that verify: mean less 1.0 deviations of those of a vector at distance R, with p = P(|N(0,1)| <= 1).
NEAR = 0.6827
THRESHOLD = int(np.floor(PROJECTIONS * NEAR - 1.0 * np.sqrt(PROJECTIONS * NEAR * (1 - NEAR))))


class Block:
    """Sorted projection arrays of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 5):
        self.ids, self.x = ids, x
        norms = np.sqrt((x * x).sum(axis=1))
        self.longest = norms.max()
        self.verified, self.starts = 0, {}
        lines = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1] + 1, PROJECTIONS))
        self.lines = lines[:-1]
        extra = np.sqrt(np.maximum(0, 1 - (norms / self.longest) ** 2))
        at = x @ (self.lines / self.longest) + extra[:, None] * lines[-1]
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T.astype(np.intp))
        self.sorted = np.ascontiguousarray(np.take_along_axis(at.T, self.order, axis=1))

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of about the k ids with the largest inner products for each query, the best row of each, ids other than its own."""
        n = len(self.ids)
        sizes = np.sqrt((queries * queries).sum(axis=1))
        centres = np.ascontiguousarray(((queries / sizes[:, None]) @ self.lines).T)
        low = np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, centres)], axis=1)
        high = low.copy()
        count = np.zeros((len(queries), n), np.int64)
        done = [self.ids == own for own in owns]
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in owns]
        open_ = np.arange(len(queries))
        radius = self._start(k)
        while len(open_):
            a = np.stack([np.searchsorted(s, c - radius) for s, c in zip(self.sorted, centres[:, open_])], axis=1)
            b = np.stack([np.searchsorted(s, c + radius, "right") for s, c in zip(self.sorted, centres[:, open_])], axis=1)
            left, first = [], radius == self._start(k)
            for q, a_q, b_q in zip(open_.tolist(), a, b):
                if first and (b_q - a_q).sum() > n * PROJECTIONS / 2:  # fewer lie outside the windows: count those
                    count[q] = PROJECTIONS - self._counted(np.zeros(PROJECTIONS, np.int64), a_q, b_q, np.full(PROJECTIONS, n))
                else:
                    count[q] += self._counted(a_q, low[q], high[q], b_q)
                low[q], high[q] = a_q, b_q
                rows, scores = self._verify(queries[q], np.flatnonzero((count[q] >= THRESHOLD) & ~done[q]), done[q], *found[q], k)
                found[q] = rows, scores
                near = len(rows) >= k and 2 - 2 * scores[k - 1] / (self.longest * sizes[q]) <= radius * radius
                if not near and not done[q].all():
                    left.append(q)
            open_ = np.array(left, dtype=np.int64)
            radius *= GROWTH
        return found

    def _counted(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How often each vector stands in the parts a:b and c:d of the arrays."""
        parts = [o[s:e] for o, s, e in zip(self.order, a.tolist(), b.tolist())] + [o[s:e] for o, s, e in zip(self.order, c.tolist(), d.tolist())]
        return np.bincount(np.concatenate(parts), minlength=len(self.ids))

    def _start(self, k: int) -> float:
        """A radius a little below that at which a search for a vector of the block is over; later ones grow from there."""
        if k not in self.starts:
            probes = self.x[:: max(1, len(self.x) // PROBES)][:PROBES]
            near = 2 - 2 * (probes @ self.x.T) / (self.longest * np.sqrt((probes * probes).sum(axis=1)))[:, None]
            kth = np.partition(near, min(k, near.shape[1] - 1), axis=1)[:, min(k, near.shape[1] - 1)]
            self.starts[k] = max(1e-3, FIRST * float(np.sqrt(max(0.0, np.median(kth)))))
        return self.starts[k]

    def _verify(self, query: np.ndarray, new: np.ndarray, done: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k ids of ``rows`` and ``new``, the latter by their exact inner products."""
        if not len(new):
            return rows, scores
        done[new] = True
        self.verified += len(new)
        rows, scores = np.append(rows, new), np.append(scores, np.einsum("ij,j->i", self.x[new], query))
        if len(rows) > 8 * k:  # rows below the k-th best id cannot return: cut most away before the sort
            worst = self._worst(rows, scores, k)
            rows, scores = rows[scores >= worst], scores[scores >= worst]
        top = np.lexsort((self.ids[rows], -scores))
        _, first = np.unique(self.ids[rows[top]], return_index=True)  # the best row of each id
        top = top[np.sort(first)[:k]]
        return rows[top], scores[top]

    def _worst(self, rows: np.ndarray, scores: np.ndarray, k: int) -> float:
        """A score that at least k different ids reach, or the least one of all."""
        take = 2 * k
        while take < len(rows):
            worst = np.partition(scores, len(scores) - take)[len(scores) - take]
            if len(np.unique(self.ids[rows[scores >= worst]])) >= k:
                return worst
            take *= 2
        return scores.min()


def usable(df: DataFrame, vec: str, vec_id: str) -> DataFrame:
    """(vec_id, embedding as double, dim) of the rows that take part, repeated ones once."""
    e = F.col(f"`{vec}`").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))


def matrix(batch: pa.RecordBatch, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(start, stop - start)
    return np.asarray(part.column("vec_id")), np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(stop - start, -1)


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """k rows a query and block from rows sorted by (dim, d, asks): a block's vectors, then the queries that come to it."""
    key, parts, block = None, [], None
    for batch in batches:
        marks = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("dim", "d", "asks")], axis=1)
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)]):
            if i == j:
                continue
            if key != tuple(marks[i, :2]):
                key, parts, block = tuple(marks[i, :2]), [], None
            if not marks[i, 2]:
                parts.append(matrix(batch, i, j))
                continue
            if block is None and parts:
                ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.lexsort((x[:, 0], ids))
                block, parts = Block(ids[order], x[order]), []
            for s in range(i, j, BATCH) if block else ():
                owns, queries = matrix(batch, s, min(j, s + BATCH))
                found = block.search(queries, owns, k)
                at = np.concatenate([r for r, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(owns, [len(r) for r, _ in found])), pa.array(block.ids[at]), pa.array(np.concatenate([v for _, v in found]))], names=["query_id", "vec_id", "score"])


def search(df: DataFrame, is_query: Column, k: int = 20, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The k nearest rows of every row of df that ``is_query`` (a condition on vec_id) picks, against all rows.

    Gives query_id, rank from 1, vec_id and score, the inner product in double precision.
    """
    rows = usable(df, vec, vec_id)
    blocks = max(1, -(-rows.count() // BLOCK))
    data = rows.withColumn("d", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(0))
    asks = rows.where(is_query).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(1))
    dealt = data.unionByName(asks).repartition(2 * blocks, "dim", "d").sortWithinPartitions("dim", "d", "asks")
    found = dealt.mapInArrow(lambda batches: searched(batches, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
