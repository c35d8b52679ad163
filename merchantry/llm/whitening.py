"""Whitening of embeddings (Chebyshev-filtered subspace iteration).

Entries become integers ``x = floor(scale * c) + shift``. The covariance ``V`` (divisor n, centred before
multiplying) is that of the fit list, every distinct vector once. ``V`` is never built: a pass over
the fit list centres its rows and adds up ``(x - mean)^T ((x - mean) Q)`` for a block ``Q`` of
``components + guard`` columns, a partial sum per task, added up by Spark; only blocks of that size
come to the driver. The block starts at random. In a round it is multiplied by a Chebyshev polynomial
of ``V`` (one pass per degree), small on the unwanted spectrum from 0 to the smallest Ritz value and
steep above it, made orthonormal by QR, and a Rayleigh-Ritz pass gives the next Ritz values, vectors
and residuals. Rounds end when every wanted pair is certified, its residual ``|Vq - eq|`` at most
RESIDUAL of the largest eigenvalue; a block that stops gaining is doubled, up to the full space, where
one pass is exact. Where the spectrum is steep the degree falls, so that the first component's
rounding does not cover the others.

The mean is held as whole part and remainder, so centred entries are exact to a rounding; sums and
``deviation`` are exact integers.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; a null id is
carried along; entries are clipped to +-2^52 before the shift; repeated rows each get their result but
count once in the fit list; vectors of different lengths have fits of their own; components whose
eigenvalue is at most RANK of the trace do not exist (one distinct vector, or vectors without entries,
give no rows); ``deviation`` is null beyond 64 bits; other columns don't matter; an empty table gives
no rows. Building the result runs the passes.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.session import materialize, ship_package

COMPONENTS = 16
GUARD = 32                     # block columns beyond the wanted ones
DEGREE = 10                    # of the polynomial, passes a round at most
SPREAD = 1e8                   # most that a round may raise the first component over the last wanted one
RESIDUAL = 1e-12               # of the largest eigenvalue
RANK = 1e-12                   # of the trace
GAIN = 0.5                     # a round that keeps more of the residual has the block doubled
CLIP = 2.0 ** 52


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """(vec_id, dim, x) of the rows that take part; ``x`` is an array of longs."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(CLIP)), F.lit(-CLIP))).cast("long") + shift
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", odd))
    return rows.select("vec_id", F.size("v").alias("dim"), F.transform("v", whole).alias("x"))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


class Centre(NamedTuple):
    """The mean of ``n`` vectors as whole part and remainder: ``sums = n * whole + rest``."""
    n: int
    whole: np.ndarray
    rest: np.ndarray           # Python integers from 0 to n-1

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - (self.rest / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - sums)^2."""
        off = x - self.whole
        reach = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if reach * reach * x.shape[1] < 2 ** 63:
            off = off * self.n - self.rest.astype(np.int64)
            return pa.array((off * off).sum(axis=1), pa.int64())
        exact = ((off.astype(object) * self.n - self.rest) ** 2).sum(axis=1)
        return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())


class Fit:
    """The fit list of one length with its exact sums, and the passes over it."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim

        def sums(it):
            high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
            for batch in it:
                x = _matrix(batch.column(0), dim)
                high, low, n = high + (x >> 26).sum(axis=0), low + (x & (2 ** 26 - 1)).sum(axis=0), n + len(x)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([high, low, [n]])], pa.list_(pa.int64()))], ["part"])

        total = [int(v) for v in self._add_up(sums, "bigint", "decimal(38,0)")]
        self.n = n = total[-1]
        exact = [h * 2 ** 26 + lo for h, lo in zip(total[:dim], total[dim:2 * dim])]
        self.centre = Centre(n, np.array([v // n for v in exact], np.int64), np.array([v % n for v in exact], object))

    def _add_up(self, part, type_: str, as_: str) -> list:
        rows = self.rows.mapInArrow(part, f"part array<{type_}>").select(F.posexplode("part").alias("at", "v"))
        return [r["v"] for r in sorted(rows.groupBy("at").agg(F.sum(F.col("v").cast(as_)).alias("v")).collect())]

    def _sum_over(self, of_centred, size: int) -> np.ndarray:
        """``of_centred(z)``, a flat array, added up over all batches of centred rows."""
        dim, centre = self.dim, self.centre

        def part(it):
            acc = np.zeros(size)
            for batch in it:
                acc += of_centred(centre.off(_matrix(batch.column(0), dim)))
            yield pa.RecordBatch.from_arrays([pa.array([acc], pa.list_(pa.float64()))], ["part"])
        return np.array(self._add_up(part, "double", "double"))

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        return self._sum_over(lambda z: (z.T @ (z @ q)).ravel(), q.size).reshape(q.shape) / self.n

    def trace(self) -> float:
        return float(self._sum_over(lambda z: np.array([(z * z).sum()]), 1)[0]) / self.n

    def identity_error(self, project: np.ndarray) -> float:
        """Largest entry of |covariance of z @ project - identity|."""
        k = project.shape[1]

        def moments(z):
            y = z @ project
            return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
        total = self._sum_over(moments, k * k + k) / self.n
        mean = total[k * k:]
        return float(np.abs(total[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def ritz(q: np.ndarray, vq: np.ndarray):
    """Ritz values from the largest, vectors, and V times the vectors, of an orthonormal ``q``."""
    h = q.T @ vq
    values, u = np.linalg.eigh((h + h.T) / 2)
    u = u[:, ::-1]
    return values[::-1], q @ u, vq @ u


def filtered(times, x: np.ndarray, values: np.ndarray, wanted: int, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times ``x``: at most 1 in size from 0 to the smallest of ``values``,
    scaled to 1 at the largest."""
    top = values[0]
    half = max(values[-1], RANK * top) / 2
    rate = lambda v: np.arccosh(max((v - half) / half, 1.0))
    steep = rate(top) - rate(values[wanted - 1])
    degree = int(np.clip(np.log(SPREAD) / max(steep, 1e-300), 1, degree))
    first = half / (top - half)
    sigma, before, now = first, x, (times(x) - half * x) * (first / half)
    for _ in range(degree - 1):
        then = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * then / half) - (sigma * then) * before
        sigma = then
    return now / np.maximum(np.linalg.norm(now, axis=0), 1e-300)


def principal(times, dim: int, trace: float, components: int = COMPONENTS, guard: int = GUARD,
              degree: int = DEGREE, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their unit eigenvectors (columns) of the operator ``times``."""
    rng = np.random.default_rng(seed)
    none = np.zeros(0), np.zeros((dim, 0))
    if not dim or not trace > 0:
        return none
    block = min(dim, components + guard)
    values, x, vx = ritz(q := np.linalg.qr(rng.standard_normal((dim, block)))[0], times(q))
    before = np.inf
    while True:
        wanted = min(components, int((values > RANK * trace).sum()))
        if not wanted:
            return none
        worst = np.linalg.norm(vx - x * values, axis=0)[:wanted].max()
        if block == dim or worst <= RESIDUAL * values[0]:
            break
        if worst > GAIN * before:
            block = min(dim, 2 * block)
            before = np.inf
            more = rng.standard_normal((dim, block - x.shape[1]))
            values, x, vx = ritz(q := np.linalg.qr(np.concatenate([x, more], axis=1))[0], times(q))
            continue
        before = worst
        values, x, vx = ritz(q := np.linalg.qr(filtered(times, x, values, wanted, degree))[0], times(q))
    x = x[:, :wanted]
    return values[:wanted], x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)


def _whitened(rows: DataFrame, fit: Fit, components: int, guard: int, degree: int) -> DataFrame:
    trace = fit.trace()
    values, vectors = principal(fit.times, fit.dim, trace, components, guard, degree)
    project = vectors / np.sqrt(values)
    error = fit.identity_error(project) if len(values) else 0.0
    k, dim, explained = len(values), fit.dim, values / trace if trace else values
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    centre = fit.centre

    def run(it):
        for batch in it:
            x = _matrix(batch.column(1), dim)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            n = len(at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(n, centre.n), pa.int64()), centre.deviations(x).take(at),
                pa.array((centre.off(x) @ project).ravel(), pa.float64()),
                pa.array(np.tile(explained, len(x)), pa.float64()), pa.array(np.full(n, error), pa.float64())], names)
    return rows.filter(F.col("dim") == dim).select("vec_id", "x").mapInArrow(run, _schema(rows))


def _schema(rows: DataFrame) -> str:
    return (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
            "explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
           shift: int = 1_000_000, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every remaining row and
    component from 1."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialize(quantised(vectors, id_col, vector_col, scale, shift), "quantised")
    distinct = materialize(rows.select("dim", "x").distinct(), "fit_list")
    out = spark.createDataFrame([], _schema(rows))
    for dim in sorted(r["dim"] for r in distinct.select("dim").distinct().collect() if r["dim"]):
        fit = Fit(distinct.filter(F.col("dim") == dim).select("x"), dim)
        out = out.unionByName(_whitened(rows, fit, components, guard, degree))
    return out
