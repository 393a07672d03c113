"""Whitening of vectors by TSQR: principal components without a covariance matrix.

Each entry c of a vector becomes the whole number x = floor(1024 * c) + 100000, so sums are exact in any
order. Sums by dimension are taken first. Rows centred by them are reduced to an R factor a partition, by QR
over one batch after another; R factors are stacked ``FAN`` at a time and reduced again, in rounds of tasks,
until one is left. Its singular values s and right vectors v give the components: e = s * s / n, the order of
falling e. The driver holds what grows with the square of the dimension alone: one R.

Defined results: a vector that is null, empty, holds a null or non-finite entry, or one of ``LARGEST`` or more
in size takes no part, nor does one whose length is not the commonest (of equally common ones the
longest). Rows with a null id, and repeated rows, take part like others. A component without variance (up to
rounding) has null whitened values, and identity_error counts the others alone. An empty table gives no
rows. Further columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sparkutil import small_batches, written

SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no exact x as a double.
LARGEST = float(1 << 42)
FAN = 32
#: Rows that are centred or projected together.
ROWS = 4096


def clean(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, lengths, flat entries as doubles) of the vectors of a batch that take part."""
    lists = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(lists.cast(pa.float64()).fill_null(float("nan")))
    ends = np.cumsum(sizes)
    bad = np.append(0, np.cumsum(~(np.abs(values) < LARGEST)))
    good = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    keep = np.zeros(len(sizes), bool)
    keep[good] = True
    return good, sizes[good], values[np.repeat(keep, sizes)]


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def matrices(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, row numbers, x-vectors) of those of length ``dim``, at most ROWS at a time."""
    for batch in batches:
        rows, sizes, values = clean(batch.column(column))
        own = sizes == dim
        x = whole(values[np.repeat(own, sizes)]).reshape(-1, dim)
        for a in range(0, len(x), ROWS):
            yield batch, rows[own][a : a + ROWS], x[a : a + ROWS]


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit numbers where these hold it, else Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if 2 * most < 1 << 63:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """(n, sums by dimension) of the vectors of the commonest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            _, sizes, values = clean(batch.column(0))
            for dim in np.unique(sizes):
                x = whole(values[np.repeat(sizes == dim, sizes)]).reshape(-1, dim)
                held = total.setdefault(int(dim), [0, 0])
                held[0] += len(x)
                # high and low halves: neither sum can pass 63 bits within a batch
                held[1] = held[1] + ((x >> 24).sum(axis=0).astype(object) * (1 << 24) + (x & 0xFFFFFF).sum(axis=0).astype(object))
        for dim, (n, s) in total.items():
            size, at = pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32())
            yield pa.RecordBatch.from_arrays([size, at, pa.array([n] * dim, pa.int64()), pa.array([str(v) for v in s])], names=["dim", "at", "n", "s"])

    found = df.select(F.col(f"`{vector}`")).mapInArrow(run, "dim int, at int, n long, s string")
    by_dim = written(found.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "sums")
    best = by_dim.where("at = 0").orderBy(F.desc("n"), F.desc("dim")).limit(1).select("dim")
    rows = sorted(by_dim.join(F.broadcast(best), "dim").collect(), key=lambda r: r["at"])
    return (int(rows[0]["n"]) if rows else 0), [int(r["s"]) for r in rows]


def reduced(parts: list[np.ndarray]) -> np.ndarray:
    """The R factor of matrices stacked."""
    return np.linalg.qr(np.concatenate(parts), mode="r")


def factor(df: DataFrame, vector: str, n: int, s: list[int]) -> np.ndarray:
    """R of all centred rows: QR by partition, then merged in a tree of tasks."""
    dim = len(s)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, rows = None, [], 0
        for _, _, x in matrices(batches, 0, dim):
            held.append(offsets(x, n, s).astype(np.float64) / n)
            rows += len(x)
            if rows >= max(ROWS, dim):
                r, held, rows = reduced([*([] if r is None else [r]), *held]), [], 0
        if held:
            r = reduced([*([] if r is None else [r]), *held])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for raw in batch.column(0):
                part = np.frombuffer(raw.as_py(), np.float64).reshape(-1, dim)
                r = part if r is None else reduced([r, part])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    factors = written(df.select(F.col(f"`{vector}`")).mapInArrow(local, "r binary"), "factors", compression="none")
    while (count := factors.count()) > 1:
        factors = written(factors.repartition(-(-count // FAN)).mapInArrow(merge, "r binary"), "factors", compression="none")
    return reduced([np.frombuffer(bytes(factors.first()["r"]), np.float64).reshape(-1, dim)])


class Whitening:
    """What fit() found: n, exact sums, unit components (rows of ``axes``), their eigenvalues and the trace."""

    def __init__(self, n: int, s: list[int], r: np.ndarray, most: int):
        whole = np.concatenate([r, np.zeros((max(0, len(s) - len(r)), len(s)))])  # fewer rows than dimensions: the rest has no variance
        _, sing, axes = np.linalg.svd(whole, full_matrices=False)
        self.n, self.sums = n, s
        self.trace = float((sing**2).sum() / n)
        self.values, self.axes = (sing**2 / n)[:most], axes[:most]
        # a component whose variance is rounding alone
        self.live = sing[:most] > sing[:1].max(initial=0.0) * 1e-13 * max(1.0, np.sqrt(len(s)))
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of x-vectors, a column a component; NaN where there is no variance."""
        root = np.where(self.live, np.sqrt(self.values), np.nan)
        return (offsets(x, self.n, self.sums).astype(np.float64) / self.n) @ self.axes.T / root


def moments(df: DataFrame, vector: str, w: Whitening) -> float:
    """The largest entry of (covariance of the whitened values - identity), measured over all rows.

    Each task centres by its own means before it multiplies; means and products merge pairwise, so no large
    square is ever taken from another.
    """
    k, dim, live = len(w.values), len(w.sums), np.flatnonzero(w.live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for _, _, x in matrices(batches, 0, dim):
            y = np.nan_to_num(w.project(x))
            own = y.mean(axis=0)
            d, m = own - mean, len(y)
            products += (y - own).T @ (y - own) + np.outer(d, d) * (n * m / (n + m))
            mean, n = mean + d * (m / (n + m)), n + m
        if n:
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(k * k, n)), pa.array(mean[i] * n), pa.array(mean[j] * n), pa.array((products + n * np.outer(mean, mean)).ravel())], names=["i", "j", "n", "a", "b", "p"])

    # overall means are zero up to rounding, so n * mean * mean adds nothing to lose digits by
    found = df.select(F.col(f"`{vector}`")).mapInArrow(run, "i int, j int, n long, a double, b double, p double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "p")])
    cov = np.eye(k)
    for r in found.collect():
        cov[r["i"], r["j"]] = r["p"] / r["n"] - r["a"] / r["n"] * (r["b"] / r["n"])
    return float(np.abs((cov - np.eye(k))[np.ix_(live, live)]).max(initial=0.0))


def fit(df: DataFrame, vector: str = "embedding", most: int = 8) -> Whitening | None:
    """The whitening of a table of vectors; None where no vector takes part."""
    n, s = sums(df, vector)
    if not n:
        return None
    w = Whitening(n, s, factor(df, vector, n, s), most)
    w.identity_error = moments(df, vector, w)
    return w


def apply(df: DataFrame, w: Whitening, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, deviation decimal, whitened array) of every row that takes part."""
    dim = len(w.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in matrices(batches, 1, dim):
            off = offsets(x, w.n, w.sums)
            if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * dim >= 1 << 63:
                off = off.astype(object)
            dev = (off * off).sum(axis=1)
            dev = pa.array(dev).cast(pa.decimal128(38, 0)) if dev.dtype != object else pa.array([str(v) for v in dev]).cast(pa.decimal128(38, 0))
            y = w.project(x)
            flat = pa.array(y.ravel(), mask=np.isnan(y).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), dev, lists], names=["vec_id", "deviation", "whitened"])

    return df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`")).mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whiten(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", most: int = 8) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    small_batches(df.sparkSession)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    w = fit(df, vector, most)
    if w is None:
        return df.sparkSession.createDataFrame([], schema)
    share = F.array(*[F.lit(float(e / w.trace) if w.trace else 0.0) for e in w.values])
    rows = apply(df, w, vector, vec_id).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
