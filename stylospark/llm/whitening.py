"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided
Jacobi on the triangular factor.

Vectors become long x = floor(scale * c). The fit list is each distinct x once; its
size n, its sums and then its scatter around the mean are summed by Spark, a matrix
a task. The scatter has dimensions**2 numbers whatever the rows are; it alone goes
to the driver. With P' A P = L L', rotating pairs of columns of P L until all are
orthogonal leaves columns whose squared norms are the eigenvalues of A and whose
directions are its eigenvectors.

Rows whose vector is null or holds nulls or non-finite entries are left out, and so
are those shorter than the longest (the missing entries count as null); repeated
rows each have their results. A direction in which the fit list doesn't vary has no
component, so an empty table, or one vector alone, gives no rows. A null vec_id
stays null; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, durable

SCALE, COMPONENTS = 256, 4


def quantised(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry; null for a vector that takes no part."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda c: F.floor(c.cast("double") * float(scale)).cast("long") + 0))


def pivoted_cholesky(a: np.ndarray, tol: float = 1e-14) -> np.ndarray:
    """G with G G' = a for a positive semidefinite a: rows in a's order, a column for
    each pivot, the largest first; pivots under tol times the first end it."""
    d = len(a)
    order, left, g = np.arange(d), a.diagonal().astype(float).copy(), np.zeros((d, d))
    least = d * tol * left.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(left[order[k:]]))
        order[[k, p]] = order[[p, k]]
        top, rest = order[k], order[k + 1 :]
        if left[top] <= least:
            return g[:, :k]
        g[top, k] = np.sqrt(left[top])
        g[rest, k] = (a[rest, top] - g[rest, :k] @ g[top, :k]) / g[top, k]
        left[rest] -= g[rest, k] ** 2
    return g


def _rounds(r: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of r columns once, in rounds of pairs that share none."""
    ring, out = [*range(r), *([-1] if r % 2 else [])], []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if a >= 0 and b >= 0]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(g: np.ndarray, sweeps: int = 60, tol: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of g g' by rotations of
    g's columns. Raises ArithmeticError if they aren't orthogonal after `sweeps`."""
    g, rounds = g.copy(), _rounds(g.shape[1])
    for _ in range(sweeps):
        most = 0.0
        for p, q in rounds:
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            far = np.abs(xy) / np.sqrt(xx * yy)
            most = max(most, far.max(initial=0.0))
            turn = far > tol
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xx), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * (x - t * y), c * (t * x + y)
        if most <= 4 * tol * max(1, len(g)):
            break
    else:
        raise ArithmeticError(f"columns aren't orthogonal after {sweeps} sweeps: {most}")
    norm = np.sqrt((g * g).sum(0))
    by = np.argsort(-norm, kind="stable")
    return norm[by] ** 2, g[:, by] / norm[by]


def _blocks(batches, d: int):
    """Rows of a list column as an integer matrix, some thousand rows at a time."""
    for b in batches:
        x = b.column(b.schema.get_field_index("x"))
        for at in range(0, len(x), 4096):
            part = x.slice(at, 4096)
            yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _summed(fit: DataFrame, d: int, size: int, of, kind: str) -> np.ndarray:
    """Sum over the fit list of the flat arrays of(block): each task adds up its own."""
    dtype = np.int64 if kind == "long" else np.float64

    def add(batches):
        total = np.zeros(size, dtype)
        for _, x in _blocks(batches, d):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["k", "v"])

    out = np.zeros(size, dtype)
    for k, v in fit.select("x").mapInArrow(add, f"k int, v {kind}").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


class Fit:
    """n, sums, eigenvalues e (of the covariance), components u (columns), trace and
    identity_error of a fit list (column x: arrays of d longs)."""

    def __init__(self, fit: DataFrame, d: int, components: int = COMPONENTS):
        head = _summed(fit, d, d + 1, lambda x: np.concatenate(([len(x)], x.sum(0))), "long")
        self.d, self.n, self.sums = d, int(head[0]), head[1:]
        mean = self.mean = self.sums / max(1, self.n)
        upper = np.triu_indices(d)

        def scatter(x):
            y = x - mean
            return (y.T @ y)[upper]

        a = np.zeros((d, d))
        a[upper] = _summed(fit, d, len(upper[0]), scatter, "double")
        a = a + np.triu(a, 1).T
        e, u = jacobi(pivoted_cholesky(a))
        self.trace = a.trace() / max(1, self.n)
        self.e, self.u = e[:components] / max(1, self.n), u[:, :components]
        k = len(self.e)
        project, low = self.project, np.tril_indices(k)

        def squares(x):
            z = project(x)
            return (z.T @ z)[low]

        cov = _summed(fit, d, len(low[0]), squares, "double") / max(1, self.n) if k else np.zeros(0)
        self.identity_error = float(np.abs(cov - np.eye(k)[low]).max(initial=0.0))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.u / np.sqrt(self.e)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)**2 by row: exact, in Python's integers where 64 bits may
        not hold it; a result beyond 64 bits raises OverflowError."""
        most = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        if self.d * most * most >= 1 << 63:
            x = x.astype(object)
        return ((self.n * x - self.sums) ** 2).sum(1)


def usable(rows: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, and the vectors' length."""
    own = rows.select(column(rows, "vec_id", "long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("x")).where("x is not null")
    d = own.agg(F.max(F.size("x"))).first()[0] or 0
    return own.where(F.size("x") == d), d


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own, d = usable(rows, scale)
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    fit = Fit(durable(own.select("x").distinct(), "whitening-fit"), d, components)
    k, names = len(fit.e), [c.split()[0] for c in schema.split(", ")]

    def rows_of(batches):
        for b in batches:
            ids = b.column(0)
            for at, x in _blocks([b], d):
                m = len(x)
                one = lambda v: pa.array(np.full(m * k, v))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(at, at + m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), one(np.int64(fit.n)),
                    pa.array(np.repeat(fit.deviation(x), k).tolist(), pa.int64()), pa.array(fit.project(x).ravel()), pa.array(np.tile(fit.e / fit.trace, m) if k else np.zeros(0)), one(fit.identity_error),
                ], names=names)

    return own.mapInArrow(rows_of, schema)
