"""Whitening against an eigendecomposition of the same covariance, and its edge cases."""

import math

import numpy as np
import pytest

from marketgrid.llm import whitening


def brute(rows):
    """Per id: deviation, whitened (up to sign) and explained, from whole tables in one place."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * c) for c in v] for _, v in usable]
    fit = np.array(sorted({tuple(r) for r in x}), float)
    n, sums = len(fit), [sum(c) for c in zip(*sorted({tuple(r) for r in x}))]
    centred = fit - fit.mean(0)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for (i, _), r in zip(usable, x):
        deviation = sum((n * a - s) ** 2 for a, s in zip(r, sums))
        for k in range(min(4, len(values))):
            score = (np.array(r) - fit.mean(0)) @ axes[:, k] / math.sqrt(values[k])
            out.append((i, k + 1, n, deviation, abs(score), values[k] / np.trace(cov)))
    return sorted(out)


def test_against_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 9)) + 0.2 * rng.normal(size=(300, 9)) + 40
    vectors = [[float(c) for c in v] for v in base.astype(np.float32)]
    vectors += vectors[:20] * 3 + [None, [], [1.0] * 8 + [None], [float("nan")] * 9, [float("-inf")] + [0.0] * 8]
    rows = list(enumerate(vectors))
    table = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")
    got = sorted(tuple(r) for r in whitening.whiten(table.repartition(3)).collect())
    want = brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([abs(g[4]) for g in got], [w[4] for w in want], rtol=1e-7, atol=1e-8)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-10)
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-9


@pytest.mark.parametrize("seed, d, rank", [(1, 12, 12), (2, 7, 3), (3, 1, 1), (4, 33, 33)])
def test_factor_and_rotations(seed, d, rank):
    rng = np.random.default_rng(seed)
    half = rng.normal(size=(d, rank)) * 10.0 ** -np.arange(rank)[None, :].clip(0, 6)
    a = half @ half.T
    factor, order = whitening.pivoted_cholesky(a)
    assert factor.shape == (d, rank) or rank > 7
    assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-9 * np.trace(a))
    values, axes = whitening.principal(a, 1)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:len(values)], atol=1e-9 * np.trace(a))
    assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-10)


def test_equal_eigenvalues(spark):
    rows = [(k, [float(s) if j == k // 2 else 0.0 for j in range(5)]) for k in range(10) for s in [1 - 2 * (k % 2)]]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 40 and max(r.identity_error for r in got) < 1e-10
    assert {round(r.explained, 9) for r in got} == {0.2}


@pytest.mark.parametrize("rows, expected", [
    ([], 0), ([(1, None), (None, [float("nan")]), (2, [])], 0), ([(1, [1.0, 2.0]), (1, [1.0, 2.0])], 0),
    ([(None, [1.0, 2.0]), (1, [2.0, 3.0]), (1, [2.0, 3.0])], 3), ([(1, [-0.0]), (2, [-0.001]), (3, [0.5])], 3),
])
def test_few_vectors(spark, rows, expected):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == expected


def test_refused(spark):
    for rows in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0] * 2), (2, [1.0] * 4)]):
        with pytest.raises(Exception, match="different lengths"):
            whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)).collect()


def test_wide_values_are_exact(spark):
    rows = [(k, [float(2_000_000 * k), float(k)]) for k in range(3)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [(512_000_000 * k, 256 * k) for k in range(3)]
    want = {k: sum((3 * v - 3 * x[1][j]) ** 2 for j, v in enumerate(x[k])) for k in range(3)}
    assert {r.vec_id: r.deviation for r in got} == want and max(want.values()) > 1 << 53
