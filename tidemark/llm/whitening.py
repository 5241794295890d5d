"""Whitening of embeddings: distributed centred covariance, own eigen-solver for the leading components, projection.

1. Every entry c becomes the integer floor(SCALE * c) + OFFSET. Each task returns the
   count, the exact sums and the centred products of its vectors; partial results are
   merged in a tree of tasks (FAN_IN to one; centred products by the rule of Chan et al.), so only
   one d x d matrix reaches the driver, whatever the number of vectors.
2. On the driver, for the d x d covariance: Householder reflections make it
   tridiagonal, Sturm counts and bisection find the leading eigenvalues, inverse
   iteration their vectors; vectors of close eigenvalues are made orthogonal to each other. Its
   cost depends on d alone.
3. Mean and components (d x k) are broadcast, and every vector is projected and divided by the root of
   the eigenvalue. A last pass gathers the covariance of the projections in the same way as (1).

Defined cases: vectors that are null or hold null or non-finite entries are left
out; so are vectors of another length than most (the longer at a tie), which have no place in the covariance;
rows that repeat count as often as they occur and each gets its rows, also without an id; components whose
eigenvalue is zero within rounding (fewer vectors than components, constant entries) do not exist, so
equal vectors, empty vectors and an empty table give an empty result. Entries too large for an integer are cut at
+-2^62. ``deviation`` is null where it is too large for a long. A vector of any length d
is held whole, and a task holds a few d x d matrices. Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SCALE = 1024.0
OFFSET = 100_000
COMPONENTS = 8
#: Partial results that one task of the merging tree takes, about.
FAN_IN = 32
#: Eigenvalues closer than this share of the matrix's norm are one cluster, whose vectors are made orthogonal.
CLUSTER = 1e-3
_MOMENTS = "n long, sums array<double>, low array<long>, products array<double>"


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET as 64-bit integers."""
    return np.clip(np.floor(SCALE * vectors), -(2.0**62), 2.0**62).astype(np.int64) + OFFSET


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Moments:
    """Count, sums and centred products of vectors; integer sums stay exact."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray):
        self.n, self.sums, self.products = n, sums, products

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        exact = x.astype(object).sum(axis=0) if x.dtype == np.int64 and np.abs(x).max(initial=0) > 2**40 else x.sum(axis=0)
        centred = x.astype(np.float64) - np.array([s / len(x) for s in exact.tolist()])
        return Moments(len(x), np.array(exact.tolist(), object), centred.T @ centred)

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        apart = np.array([float(s) for s in self.sums]) / self.n - np.array([float(s) for s in other.sums]) / other.n
        self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.sums = self.sums + other.sums
        self.n = n

    def batch(self, exact: bool) -> pa.RecordBatch:
        # Integer sums travel as high * 2^32 + low, both exact, in columns of their own types.
        sums = self.sums.tolist()
        high = [float(s >> 32) for s in sums] if exact else [float(s) for s in sums]
        low = [int(s & 0xFFFFFFFF) for s in sums] if exact else [0] * len(sums)
        arrays = [pa.array([self.n], pa.int64()), pa.array([high], pa.list_(pa.float64())), pa.array([low], pa.list_(pa.int64())), pa.array([self.products.ravel()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["n", "sums", "low", "products"])

    @staticmethod
    def read(n: int, sums: list[float], low: list[int], products: list[float], exact: bool) -> Moments:
        whole = [(int(h) << 32) + l for h, l in zip(sums, low)] if exact else sums
        return Moments(n, np.array(whole, object), np.array(products, np.float64).reshape(len(sums), len(sums)))


def _partial(values: Callable[[pa.RecordBatch], np.ndarray], exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in given:
            if batch.num_rows:
                part = Moments.of(values(batch))
                total = part if total is None else (total.merge(part), total)[1]
        if total is not None:
            yield total.batch(exact)

    return batches


def _merged(exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in given:
            for row in batch.to_pylist():
                part = Moments.read(**row, exact=exact)
                total = part if total is None else (total.merge(part), total)[1]
        if total is not None:
            yield total.batch(exact)

    return batches


def moments(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], exact: bool) -> Moments | None:
    """Moments of the vectors that ``values`` makes of each batch of ``rows``; None without rows."""
    parts = rows.rdd.getNumPartitions()
    partial = rows.mapInArrow(_partial(values, exact), _MOMENTS)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        partial = partial.repartition(parts).mapInArrow(_merged(exact), _MOMENTS)
    row = partial.first()
    return None if row is None else Moments.read(**row.asDict(), exact=exact)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, second diagonal, reflections as rows) of Q' A Q for a symmetric A, by Householder reflections."""
    a = np.array(matrix, np.float64)
    d = len(a)
    reflections = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if not norm or not np.abs(x[1:]).max(initial=0):
            continue
        v = x.copy()
        v[0] += np.copysign(norm, x[0])
        v /= np.linalg.norm(v)
        reflections[k, k + 1 :] = v
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
        a[k + 2 :, k] = a[k, k + 2 :] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def counts_below(diagonal: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: for every value of ``at``, how many eigenvalues of the tridiagonal matrix lie below it."""
    least = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    count = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for i, a in enumerate(diagonal):
        q = a - at - (second[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until no double lies between the bounds."""
    d = len(diagonal)
    radius = np.zeros(d)
    radius[:-1] += np.abs(second)
    radius[1:] += np.abs(second)
    low, high = (diagonal - radius).min(), (diagonal + radius).max()
    margin = 2 * np.finfo(np.float64).eps * max(abs(low), abs(high)) * d
    lows, highs = np.full(k, low - margin), np.full(k, high + margin)
    rank = d - 1 - np.arange(k)  # this many eigenvalues are smaller
    while True:
        middle = (lows + highs) / 2
        open_ = (middle > lows) & (middle < highs)
        if not open_.any():
            return middle
        above = counts_below(diagonal, second, middle) <= rank
        lows = np.where(open_ & above, middle, lows)
        highs = np.where(open_ & ~above, middle, highs)


def _solve(diagonal: np.ndarray, second: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges; pivots of zero become tiny."""
    d = len(diagonal)
    tiny = np.finfo(np.float64).eps * max(np.abs(diagonal).max(), np.abs(second).max(initial=0), np.finfo(np.float64).tiny)
    u = np.zeros((d, 3))
    b = b.copy()
    row = [diagonal[0] - shift, second[0] if d > 1 else 0.0, 0.0]
    for i in range(d - 1):
        under = [second[i], diagonal[i + 1] - shift, second[i + 1] if i + 2 < d else 0.0]
        if abs(under[0]) > abs(row[0]):
            row, under = under, row
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(row[0]) < tiny:
            row[0] = tiny
        factor = under[0] / row[0]
        u[i] = row
        b[i + 1] -= factor * b[i]
        row = [under[1] - factor * row[1], under[2] - factor * row[2], 0.0]
    u[d - 1] = [row[0] if abs(row[0]) >= tiny else tiny, 0.0, 0.0]
    x = np.zeros(d)
    for i in range(d - 1, -1, -1):
        x[i] = (b[i] - (u[i, 1] * x[i + 1] if i + 1 < d else 0.0) - (u[i, 2] * x[i + 2] if i + 2 < d else 0.0)) / u[i, 0]
        if abs(x[i]) > 1e200:
            x /= abs(x[i])
            b = b / 1e200
    return x


def inverse_iteration(diagonal: np.ndarray, second: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (rows) of the falling eigenvalues ``values``; within a cluster they are made orthogonal in every step."""
    d = len(diagonal)
    norm = np.abs(diagonal).max(initial=0) + 2 * np.abs(second).max(initial=0)
    random, vectors, start, shift = np.random.default_rng(11), np.zeros((len(values), d)), 0, 0.0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        # Equal eigenvalues get shifts a little apart.
        shift = value if j == start else min(value, shift - 4 * np.finfo(np.float64).eps * norm)
        z = random.standard_normal(d)
        for _ in range(6):
            z = _solve(diagonal, second, shift, z / np.linalg.norm(z))
            for _ in range(2):
                z -= vectors[start:j].T @ (vectors[start:j] @ z)
        vectors[j] = z / np.linalg.norm(z)
    return vectors


def leading_components(covariance: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows), at most k, falling, without those that are zero within rounding."""
    d = len(covariance)
    scale = np.abs(covariance).max(initial=0)
    if not scale:
        return np.zeros(0), np.zeros((0, d))
    diagonal, second, reflections = tridiagonal(covariance / scale)
    values = leading_eigenvalues(diagonal, second, min(k, d))
    values = values[values > 1e-12 * d * values[0]]
    vectors = inverse_iteration(diagonal, second, values)
    for v in reflections[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # Of the two signs, the one whose largest entry is positive.
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return values * scale, vectors


class Fit:
    """n, exact sums, mean, eigenvalues, components, and each one's share of the trace."""

    def __init__(self, total: Moments, k: int):
        self.n, self.sums = total.n, [int(s) for s in total.sums]
        self.mean = np.array([s / total.n for s in self.sums])
        covariance = total.products / total.n
        self.values, self.vectors = leading_components(covariance, k)
        self.explained = self.values / np.trace(covariance) if len(self.values) else self.values

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        apart = np.abs(x - np.round(self.mean)).max(initial=0) + 1.0
        small = float(apart) * self.n < 2**31 and (float(apart) * self.n) ** 2 * x.shape[1] < 2**62 and np.abs(x).max(initial=0) * float(self.n) < 2**62
        whole = x if small else x.astype(object)
        far = whole * self.n - np.array(self.sums, np.int64 if small else object)
        return [s if s < 2**63 else None for s in (far * far).sum(axis=1).tolist()]


def usable(embedding: Column) -> Column:
    """Whether a vector is not null and all its entries are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(embedding, finite), F.lit(False))


def whiten(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector: ``id``, n, deviation, whitened and explained (arrays, one entry per component), identity_error."""
    schema = f"`{id}` {vectors.schema[id].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    given = vectors.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    most = given.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or not most["d"]:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = given.where(F.size("vector") == most["d"])
    fit = Fit(moments(rows, lambda batch: integers(_rows(batch, "vector")), exact=True), components)
    if not len(fit.values):
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(fit)
    check = moments(rows, lambda batch: sent.value.whiten(integers(_rows(batch, "vector"))), exact=False)
    error = float(np.abs(check.products / check.n - np.eye(len(fit.values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(_rows(batch, "vector"))
            n = batch.num_rows
            columns = [
                batch.column("id"),
                pa.array([fit.n] * n, pa.int64()),
                pa.array(fit.deviations(x), pa.int64()),
                pa.array(list(fit.whiten(x)), pa.list_(pa.float64())),
                pa.array([fit.explained] * n, pa.list_(pa.float64())),
                pa.array([error] * n, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id, "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "of")
    long = wide.select("vec_id", "n", "deviation", "identity_error", each)
    return long.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")
