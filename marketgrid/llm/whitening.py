"""Whitening of embeddings: components of the covariance over the distinct quantised vectors.

One pass counts and sums the distinct vectors, a second sums the scatter of the centred ones (a matrix per task, summed
row by row on executors). The d x d scatter is factored by Cholesky with diagonal pivoting; one-sided Jacobi rotates
the columns of the triangular factor until they are orthogonal: their squared norms are the eigenvalues, the normalised
columns the components. Only sums of fixed size (the dimension) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import slices, stage

SCALE, COMPONENTS = 256, 4
#: Sweeps of Jacobi rotations at most; convergence is quadratic, so some ten suffice for any matrix.
SWEEPS = 60


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): a[order][:, order] = factor @ factor.T, the largest remaining diagonal first.

    The factor has as many columns as the matrix has rank; what is left below rounding ends it.
    """
    a = np.array(a, float)
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    rest = np.diag(a).copy()
    floor = d * np.finfo(float).eps * rest.max(initial=0)
    for k in range(d):
        best = k + int(np.argmax(rest[k:]))
        if rest[best] <= floor:
            return factor[:, :k], order
        for table in (order, rest):
            table[[k, best]] = table[[best, k]]
        factor[[k, best]] = factor[[best, k]]
        factor[k, k] = np.sqrt(rest[k])
        below = a[order[k + 1:], order[k]] - factor[k + 1:, :k] @ factor[k, :k]
        factor[k + 1:, k] = below / factor[k, k]
        rest[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns, rotated in pairs until all of them are orthogonal; a round rotates disjoint pairs at once."""
    g = np.array(factor, float)
    if g.shape[1] % 2:
        g = np.hstack([g, np.zeros((len(g), 1))])
    n = g.shape[1]
    turn = np.arange(n)
    for _ in range(SWEEPS):
        largest = 0.0
        for _ in range(n - 1):
            p, q = turn[:n // 2], turn[n // 2:][::-1]
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            norms = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), norms, out=np.zeros_like(norms), where=norms > 0)
            largest = max(largest, off.max(initial=0))
            work = off > np.finfo(float).eps
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=work)
            t = np.where(work, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * (x - t * y), c * (t * x + y)
            turn = np.concatenate([turn[:1], np.roll(turn[1:], 1)])
        if largest <= len(g) * np.finfo(float).eps:
            break
    return g


def principal(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as rows) of scatter / n; as many as its rank.

    The sign of a component is such that its largest entry is positive.
    """
    factor, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    keep = np.argsort(-norms, kind="stable")[:factor.shape[1]]
    out = np.zeros((len(keep), len(scatter)))
    out[:, order] = (turned[:, keep] / norms[keep]).T
    sign = np.sign(out[np.arange(len(out)), np.abs(out).argmax(1)])
    return norms[keep] ** 2 / n, out * sign[:, None]


def quantised(vectors: Column) -> Column:
    return F.transform(vectors, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vectors: Column) -> Column:
    """Neither null nor empty, no null and no non-finite entry."""
    bad = F.exists(vectors, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce((F.size(vectors) > 0) & ~bad, F.lit(False))


def matrix(part: pa.RecordBatch, at: int) -> np.ndarray:
    """A column of longs lists of one length as rows of a matrix."""
    column = part.column(at)
    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("the vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of fit vectors and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = matrix(part, 0)
                d = x.shape[1]
                high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                yield pa.record_batch({
                    "dim": np.arange(d, dtype=np.int32), "n": np.full(d, len(x)), "high": high, "low": low})

    rows = fit.mapInArrow(run, "dim int, n long, high long, low long").groupBy("dim").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]).collect()
    rows.sort(key=lambda r: r["dim"])
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("the vectors have different lengths")
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def summed_products(rows: DataFrame, build) -> np.ndarray:
    """The sum over all rows of y.T @ y, y being the matrix that `build` makes of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch):
                y = build(matrix(part, 0))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.tril_indices(len(total))
            yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    cells = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (cells[c].to_numpy() for c in ("i", "j", "v"))
    d = 1 + int(i.max(initial=-1))
    out = np.zeros((d, d))
    out[i, j] = out[j, i] = v
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over the dimensions of (n * x - S)^2 per row."""
    widest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if widest ** 2 * max(1, len(sums)) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A row whose vector is null, empty, or holds a null or non-finite entry takes no part. Repeated vectors count once
    in the fit, yet every row is returned; a null id is kept. Components beyond the rank of the covariance don't
    exist, so fewer than `components` may be returned (none for fewer than two distinct vectors); equal eigenvalues
    come in the order of the factor. Vectors of different lengths and a deviation beyond a long are refused
    with an error. An empty table gives an empty result; further columns are ignored.
    """
    own = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("vector")).filter(usable(F.col("vector")))
    rows = stage(own.select("vec_id", quantised(F.col("vector")).alias("x")), "quantised")
    fit = stage(rows.select("x").distinct(), "fit")
    n, sums = fit_sums(fit)
    mean = np.array([s / n for s in sums])
    scatter = summed_products(fit, lambda x: x - mean)
    values, axes = principal(scatter, n) if n > 1 else (np.empty(0), np.empty((0, len(sums))))
    values, axes = values[:components], axes[:components]
    lift = axes.T / np.sqrt(values)
    explained = values / (np.trace(scatter) / n) if len(values) else values
    again = summed_products(fit, lambda x: (x - mean) @ lift) / n if len(values) else np.empty((0, 0))
    error = float(np.abs(again - np.eye(len(again))).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for part in slices(batch):
                x = matrix(part, 1)
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(np.array(deviations(x, n, sums), np.int64), k)),
                    pa.array(((x - mean) @ lift).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")
