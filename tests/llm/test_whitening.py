"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from gridrisk.llm import queries, whitening


def plain(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], np.int64)
    values, q = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x, values[::-1], q[:, ::-1]


def table(spark, vectors, path):
    rows = [(None if k == 3 else k, v, "own") for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").repartition(3).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return str(path)


def some(n, d, seed=0, scale=None):
    rnd = np.random.default_rng(seed)
    return (rnd.standard_normal((n, d)) * (np.linspace(0.2, 1, d) if scale is None else scale)).astype(np.float32).tolist()


@pytest.mark.parametrize("d, scale", [(40, None), (5, None), (1, None), (60, np.r_[50.0, 3.0, np.full(58, 0.3)])])
def test_components_equal_those_of_numpy(spark, tmp_path, d, scale):
    vectors = some(300, d, scale=scale)
    x, values, q = plain(vectors)
    n, s = len(x), x.sum(0)
    rows = queries.op11_embedding_whitening(spark, table(spark, vectors, tmp_path)).collect()
    k = min(8, d)
    assert len(rows) == n * k
    deviation = {i: sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for i, row in enumerate(x)}
    white = np.full((n, k), np.nan)
    for r in rows:
        i = 3 if r["vec_id"] is None else r["vec_id"]
        assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        white[i, r["component"] - 1] = r["whitened"]
    want = (x - s / n) @ q[:, :k] / np.sqrt(values[:k])
    signs = np.sign((want * white).sum(0))
    assert np.abs(white * signs - want).max() < 1e-7


def test_odd_vectors(spark, tmp_path):
    good = some(50, 12)
    bad = [None, [], [1.0] * 11, [None] + [0.0] * 11, [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11]
    rows = queries.op11_embedding_whitening(spark, table(spark, good + bad, tmp_path / "a")).collect()
    assert {r["vec_id"] for r in rows} == {None, *range(3), *range(4, 50)} and len(rows) == 400 and {r["n"] for r in rows} == {50}
    x = whitening.integers(spark.read.parquet(table(spark, [[1e30, -1e30], [0.0, 0.0]], tmp_path / "b") + "/embeddings.parquet"))
    assert sorted(map(abs, (v - 100_000 for r in x.collect() for v in r["x"]))) == [0, 0, 2**30, 2**30]


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[0.5, 0.25]], [[0.5, 0.25]] * 9, [[], [], None]])
def test_without_variance_there_are_no_components(spark, tmp_path, vectors):
    assert queries.op11_embedding_whitening(spark, table(spark, vectors, tmp_path)).collect() == []


def test_fewer_components_than_asked_for(spark, tmp_path):
    base = np.random.default_rng(1).integers(-400, 400, (80, 3))
    vectors = (base @ np.random.default_rng(2).integers(-3, 4, (3, 40)) / 1024).astype(np.float32).tolist()
    rows = queries.op11_embedding_whitening(spark, table(spark, vectors, tmp_path)).collect()
    assert {r["component"] for r in rows} == {1, 2, 3} and max(r["identity_error"] for r in rows) < 1e-9


def test_filter_is_the_chebyshev_polynomial():
    values = np.array([9.0, 5.0, 2.0, 1.0, 0.3])
    times = lambda q: values[:, None] * q
    q = np.eye(5)
    got = whitening.filtered(times, q, times(q), 9.0, 2.0, 6)
    t = np.polynomial.chebyshev.Chebyshev.basis(6)
    assert np.allclose(np.diag(got), t(values - 1) / t(8.0))


def test_exact_deviation_beyond_small_numbers(spark, tmp_path):
    vectors = [[2.0**20, 0.0], [-(2.0**20), 0.0], [0.0, 3.0]] * 4
    x = whitening.integers(spark.read.parquet(table(spark, vectors, tmp_path) + "/embeddings.parquet"))
    w = whitening.fit(x)
    want = sum((w.n * (2**30 if k == 0 else 0) - s + w.n * 100_000) ** 2 for k, s in enumerate(w.sums))
    assert {r["deviation"] for r in whitening.transform(x, w).where("vec_id = 0").collect()} == {want if want < 2**63 else None}
