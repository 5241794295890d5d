"""Whitening against numpy's own eigen-solver and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8):
    """(n, deviations by row, whitened up to sign, explained) of the vectors of one length."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = (x - np.array([a / n for a in s])).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:k]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def compare(got, rows, k=8):
    n, deviations, whitened, explained = brute(rows, k)
    for i, r in enumerate(got):
        assert (r.n, r.deviation) == (n, deviations[i])
        assert r.explained == pytest.approx(explained.tolist(), rel=1e-9)
        assert r.identity_error < 1e-9
    w = np.array([r.whitened for r in got])
    signs = np.sign((w * whitened).sum(axis=0))
    np.testing.assert_allclose(w * signs, whitened, atol=1e-6)


def test_given_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id")
    given = [r.embedding for r in rows.where("embedding is not null").collect() if all(c is not None and math.isfinite(c) for c in r.embedding)]
    compare(whitening.whiten(rows).orderBy("vec_id").collect(), given)
    long = whitening.op13_whitening(spark, SF_SMALL)
    assert long.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(long.dtypes)["component"] == "int" and long.count() == 8 * len(given)
    assert [r.component for r in long.select("component").distinct().orderBy("component").collect()] == list(range(1, 9))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_merging_tree(spark, partitions):
    rng = np.random.default_rng(partitions)
    vectors = (rng.standard_normal((500, 12)) * np.linspace(1, 3, 12) + 5).astype(np.float32).tolist()
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], VECTORS).repartition(partitions, "vec_id")
    compare(whitening.whiten(rows).orderBy("vec_id").collect(), vectors)


@pytest.mark.parametrize("d", [1, 2, 3, 10, 64, 150])
def test_solver(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    a = a @ a.T
    values, vectors = whitening.leading_components(a)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    np.testing.assert_allclose(values, want, rtol=1e-11)
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    np.testing.assert_allclose(a @ vectors.T, vectors.T * values, atol=1e-10 * want[0])


@pytest.mark.parametrize("spectrum", [[5.0] * 12, [9, 9, 9, 1, 1, 1, 1, 1, 1, 1], [7, 7 - 1e-13, 7 - 1e-9, 3, 3, 2, 2, 2, 1, 1], [1e30, 1e30, 1, 1e-3], [4, 3, 0, 0, 0, 0, 0, 0, 0, 0]])
def test_clusters(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))
    a = (q * np.array(spectrum, float)) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.leading_components(a)
    kept = [v for v in sorted(spectrum, reverse=True)[:8] if v > 1e-12 * d * max(spectrum)]
    np.testing.assert_allclose(values, kept, rtol=1e-9)
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-10)
    np.testing.assert_allclose(a @ vectors.T, vectors.T * values, atol=1e-9 * max(spectrum))


def test_diagonal_matrix():
    values, vectors = whitening.leading_components(np.diag([1.0, 5.0, 3.0]))
    np.testing.assert_allclose(values, [5, 3, 1])
    np.testing.assert_allclose(np.abs(vectors), [[0, 1, 0], [0, 0, 1], [1, 0, 0]], atol=1e-12)


def test_awkward(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((40, 3)).astype(np.float32).tolist()
    bad = [None, [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0], [], [1.0], [1.0, 2.0]]
    rows = [(i, v, i % 3) for i, v in enumerate(good)] + [(3, good[3], None), (None, good[5], 1)] + [(100 + i, v, 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in ("id", "n", "vector", "whitened", "d", "count")})
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id))
    # Repeats count, and so does the row without an id.
    ordered = sorted(((i, v) for i, v, _ in rows if v is not None and len(v) == 3 and v in good), key=lambda r: (r[0] is None, r[0]))
    compare(got, [v for _, v in ordered])


def test_degenerate(spark):
    for rows in ([], [(1, [], 1)], [(1, [1.0, 2.0], 1)], [(i, [1.0, 2.0], 1) for i in range(9)], [(1, None, 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 1) for i in range(9)], VECTORS)).collect()
    assert all(len(r.whitened) == 1 and r.explained == pytest.approx([1.0]) for r in flat)
    huge = whitening.whiten(spark.createDataFrame([(i, [float(i) * 1e30, float(-i)], 1) for i in range(-4, 5)], VECTORS)).collect()
    assert len(huge) == 9 and all(r.deviation is None or r.deviation >= 0 for r in huge)
