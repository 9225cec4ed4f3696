"""Whitening against plain eigenvalues and exact integers."""

import numpy as np
import pytest

from chorus.llm import whitening

SMALL = "/root/testdata/sf0.001"


def plain(vectors):
    """Brute force on all vectors: x rows, fit list, eigenvalues and vectors."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    sums, n = fit.sum(0), len(fit)
    c = fit - sums / n
    values, found = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, values[::-1], found[:, ::-1]


def check(rows, vectors, most=16):
    x, n, sums, values, found = plain(list(vectors.values()))
    at = {v: k for k, v in enumerate(vectors)}
    most = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(rows) == len(vectors) * most
    signs = {}
    for r in rows:
        own, k = x[at[r.vec_id]], r.component - 1
        assert r.n == n and r.deviation == int(((n * own - sums) ** 2).sum())
        expected = (own - sums / n) @ found[:, k] / values[k] ** 0.5
        if abs(expected) > 1e-3:
            sign = signs.setdefault(k, np.sign(expected * r.whitened))
            assert r.whitened * sign == pytest.approx(expected, rel=1e-6, abs=1e-6)
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9


def test_query_equals_plain_eigenvectors(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check(whitening.op13_qdwh_whitening(spark, SMALL).collect(), {r.vec_id: r.embedding for r in table})


def test_repeated_rows_and_few_dimensions(spark):
    rng = np.random.default_rng(1)
    base = {k: (rng.normal(size=5) * [5, 3, 2, 1, 0.5]).tolist() for k in range(300)}
    vectors = base | {1000 + k: base[7] for k in range(400)}
    docs = spark.createDataFrame([(k, v, "own") for k, v in vectors.items()],
                                 "vec_id long, embedding array<double>, x string").repartition(7)
    check(whitening.whiten(docs).collect(), vectors)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [1.0, inf]),
            (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (3, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(frame).collect()
    assert sorted((r.vec_id or 0) for r in got) == sorted([1, 2, 3, 3, 0] * 2)
    assert {r.n for r in got} == {4}
    for none in (frame.where("false"), frame.where("vec_id = 3"), frame.where("vec_id in (4, 5)")):
        assert whitening.whiten(none).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    frame = spark.createDataFrame([(1, [1e9, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])],
                                  "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    assert got[1] is None and got[2] is None


@pytest.mark.parametrize("values", [[3, 3, 3, 1], [5, 4.999999, 1e-3, 1e-3, 0], [1] * 6, [7], [2, 0, 0, -3], [1e8, 1, 1e-8]])
def test_components_of_matrices(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.components_of(v)
    size = max(map(abs, values))
    assert np.allclose(got, sorted(values, reverse=True), atol=1e-13 * size * 10)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * got) < 1e-12 * size


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    values, q = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-12
