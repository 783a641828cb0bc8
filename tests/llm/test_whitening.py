"""Whitening against a dense eigenvalue solver, in exact sums, and on odd vectors."""

import numpy as np
import pytest

from lumenfit.llm import whitening
from lumenfit.llm.queries import QUERIES


def _cases():
    r = np.random.default_rng(3)
    basis = lambda d: np.linalg.qr(r.normal(size=(d, d)))[0]
    for d in (1, 2, 5, 40):
        q = basis(d)
        yield "spread", (q * np.linspace(1, 9, d)) @ q.T
        yield "equal", 4 * np.eye(d)
        yield "two values", (q * np.repeat([7.0, 2.0], [d // 2, d - d // 2])) @ q.T
        yield "wide range", (q * np.logspace(0, -14, d)) @ q.T
        yield "diagonal", np.diag(np.arange(d, 0, -1.0))
        yield "low rank", (q[:, :1] * 5) @ q[:, :1].T
        yield "close", (q * (1 + 1e-9 * np.arange(d))) @ q.T


@pytest.mark.parametrize("name, cov", list(_cases()))
def test_components(name, cov):
    cov = (cov + cov.T) / 2
    d = len(cov)
    for most in (1, 3, d):
        values, vectors = whitening.components(cov, min(most, d))
        want = np.linalg.eigvalsh(cov)[::-1][: len(values)]
        assert len(values) == min(most, d) and np.abs(values - want).max() <= 1e-13 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
        assert np.abs(cov @ vectors - vectors * values).max() <= 1e-13 * want[0]


def test_polar_factor_is_the_sign():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(30, 30)))[0]
    values = np.r_[np.logspace(-9, 3, 15), -np.logspace(-9, 3, 15)]
    got = whitening.polar_factor((q * values) @ q.T)
    assert np.abs(got @ got - np.eye(30)).max() < 1e-12
    assert np.abs(got - (q * np.sign(values)) @ q.T).max() < 1e-3  # as exact as eigenvalues of 1e-12 of the largest allow


def _want(vectors):
    """Plain version: exact deviations, then an eigenvalue solver."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in map(float, v)] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    y = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    return n, deviation, y @ basis / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def _check(got, ids, vectors, most):
    n, deviation, white, share = _want(vectors)
    at = {i: k for k, i in enumerate(ids)}
    assert len(got) == len(ids) * most
    table = np.full((len(ids), most), np.nan)
    for r in got:
        k = at[r.vec_id]
        assert r.n == n and r.deviation == deviation[k] and r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        table[k, r.component - 1] = r.whitened
    sign = np.sign((table * white[:, :most]).sum(axis=0))
    assert np.abs(table - white[:, :most] * sign).max() < 1e-7


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = QUERIES["op11_embedding_whitening"](spark, sf_dir).collect()
    _check(got, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def _run(spark, tmp_path, rows, kind="double"):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, n int, whitened string").write.parquet(f"{path}/embeddings.parquet")
    return QUERIES["op11_embedding_whitening"](spark, path).collect()


def test_odd_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    good = [(i, [float(c) for c in r.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(40)]
    good.append((40, good[3][1]))  # an equal vector is another row
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf")] * 5, [1e300] * 5]
    rows = [(i, v, 1, "x") for i, v in good] + [(100 + k, v, 1, None) for k, v in enumerate(bad)]
    got = _run(spark, tmp_path, rows)
    _check(got, [i for i, _ in good], [v for _, v in good], 5)


def test_other_lengths_repeats_and_no_variance(spark, tmp_path):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [5.0, 5.0]), (7, [1.0]), (8, [3.0]), (9, [4.0, 4.0, 4.0])]
    got = _run(spark, tmp_path, [(i, v, 0, "") for i, v in rows])
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert {i: len(v) for i, v in by.items()} == {1: 2, 2: 4, None: 2, 7: 1, 8: 1}  # a lone vector has no components
    assert {r.n for r in by[1] + by[2] + by[None]} == {4} and {r.n for r in by[7]} == {2}
    assert {abs(round(r.whitened, 9)) for r in by[7] + by[8]} == {1.0}


def test_large_entries_are_exact(spark, tmp_path):
    values = [[2.0**40, 1.0], [-(2.0**41), 0.5], [2.0**42 + 1, 3.0]]
    got = _run(spark, tmp_path, [(i, v, 0, "") for i, v in enumerate(values)])
    deviation = _want(values)[1]
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for i, d in enumerate(deviation)}
    assert {d < 1 << 63 for d in deviation} == {True, False} and {r.n for r in got} == {3}


def test_no_vectors(spark, tmp_path):
    assert _run(spark, tmp_path, []) == []
