"""Spectrum slicing and whitening against numpy and exact integers."""

import math

import numpy as np
import pytest

from bayes_ops.llm import whitening


def check(vectors, got_rows, components=8):
    """Against eigh of the same covariance; ``vectors``: (vec_id, list) that remain."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors], object)
    n, s = len(x), x.sum(0)
    z = x * n - s
    y = (z / n).astype(np.float64)
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    k = len(values)
    assert len(got_rows) == n * k
    by_id = {}
    for r in got_rows:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(max(values[r["component"] - 1], 0) / np.trace(cov), rel=1e-8, abs=1e-12)
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    w = np.array([[by_id[i][c]["whitened"] for c in range(1, k + 1)] for i, _ in vectors])
    for row, (i, _) in zip(z, vectors):
        assert by_id[i][1]["deviation"] == int((row * row).sum())
    gaps = np.abs(np.diff(np.concatenate([np.linalg.eigvalsh(cov)[::-1], [-np.inf]])))
    for c in range(k):
        if values[c] > 1e-9 * np.trace(cov) and min(gaps[c], gaps[c - 1] if c else np.inf) > 1e-6 * values[0]:
            want = y @ axes[:, c] / np.sqrt(values[c])
            assert min(np.abs(w[:, c] - want).max(), np.abs(w[:, c] + want).max()) < 1e-6
    return w


def test_whitening_matches_eigh(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    rows = whitening.whiten(df).collect()
    w = check(vectors, rows)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() <= rows[0]["identity_error"] + 1e-9


def test_whitening_is_the_same_however_it_is_partitioned(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    key = lambda r: (r["vec_id"], r["component"], r["deviation"], r["explained"])
    assert sorted(map(key, whitening.whiten(df).collect())) == sorted(map(key, whitening.whiten(df.repartition(7)).collect()))


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(40, 5)) * [3, 2, 1, 0, 1])]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0., 0., 0., 0.]),
           (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + odd], "vec_id long, embedding array<float>, component string, n int")
    rows = whitening.whiten(df.repartition(3)).collect()
    check(good, rows)
    assert {r["vec_id"] for r in rows} == {i for i, _ in good}
    assert all(r["whitened"] == 0 for r in rows if r["component"] == 5)   # one dimension never varies


def test_repeated_ids_single_vector_and_empty(spark):
    shape = "vec_id long, embedding array<float>, label int"
    twice = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 2 + [(None, [2.0, 5.0], 0)], shape)).collect()
    assert len(twice) == 6 and {r["n"] for r in twice} == {3}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], shape)).collect()
    assert [(r["component"], r["whitened"], r["deviation"]) for r in one] == [(1, 0.0, 0), (2, 0.0, 0)]
    assert whitening.whiten(spark.createDataFrame([], shape)).collect() == []


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(30, 3)) * [1e6, 1e3, 1])]
    rows = whitening.whiten(spark.createDataFrame([(i, v) for i, v in good], "vec_id long, embedding array<float>")).collect()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in good], object)
    z = x * len(x) - x.sum(0)
    far = {i: int((r * r).sum()) for (i, _), r in zip(good, z)}
    assert all(r["deviation"] == (far[r["vec_id"]] if far[r["vec_id"]] < 1 << 63 else None) for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_inertia_counts(seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    values = np.sort(rng.normal(size=20))[::-1]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    for s in (values[:-1] + values[1:]) / 2:
        assert whitening.above(v, s) == int((values > s).sum())
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_leading_with_equal_eigenvalues():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    values = np.array([9, 9, 9, 5, 4, 4, 1e-3, 1e-3 + 1e-10, 0, 0, 0, 0])
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, axes = whitening.leading(v, 8)
    assert np.allclose(got, np.sort(values)[::-1][:8], atol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(8), atol=1e-12)
    assert np.abs(v @ axes - axes * got).max() < 1e-8
