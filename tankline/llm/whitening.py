"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become whole numbers, ``floor(64 c) + 1000000``. The fit list is every different vector once. Its sums and
the scatter of its centred vectors are added up by Spark, partial sums first; only d x d numbers, d being the length of
the vectors, reach the driver. There the covariance is factored as L L' with the largest remaining diagonal entry as the
next pivot, and the columns of the triangular L are rotated in pairs until all are orthogonal. Their squared norms are the
eigenvalues, the normalised columns the components; the covariance itself is not diagonalised.

Edge cases: rows whose vector is NULL or has a NULL or non-finite entry are dropped, and so are rows whose vector
has another length than most (of equally frequent lengths, the longer counts); entries beyond 4e18 / 64 count as that; a
component whose eigenvalue is no more than ``RANK`` of the largest has no rows, so a single vector gives none; copies count once
in the fit and are all returned; a deviation beyond 64 bits is NULL; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import shared_folder, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = 4e18
#: Eigenvalues up to this share of the largest count as rounding.
RANK = 1e-11

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Centre:
    """The mean of ``n`` whole-number vectors: ``whole + rest / n`` with ``0 <= rest < n``."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """The vectors less the mean; the whole parts are subtracted as whole numbers."""
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - sum)^2, exact."""
        whole = x - self.whole
        if x.shape[1] * (float(self.n) * (float(np.abs(whole).max(initial=0)) + 1)) ** 2 < 2.0**62:
            return ((self.n * whole - self.rest) ** 2).sum(axis=1).tolist()
        exact = (((self.n * whole.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)).tolist()
        return [v if v < 1 << 63 else None for v in exact]


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.offsets(x) @ self.directions / np.sqrt(self.values)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x`` of the rows whose vectors are complete."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    clipped = lambda c: F.greatest(F.least(SCALE * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    x = F.transform("embedding", lambda c: F.floor(clipped(c)).cast("long") + SHIFT)
    return vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & finite).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(fit: DataFrame, d: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of r r' over the rows r that ``rows_of`` makes of the fit list. Each task sends the upper half of its own sum."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            r = rows_of(_matrix(batch.column(0), d))
            total = r.T @ r if total is None else total + r.T @ r
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    sums = fit.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (sums.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((i.max() + 1, i.max() + 1))
    out[i, j] = out[j, i] = v
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``factor`` (lower trapezoidal) and ``order`` with ``a[order][:, order] = factor @ factor.T`` up to rounding."""
    d = len(a)
    order, rest, factor = np.arange(d), a.diagonal().copy(), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(rest[order[k:]]))
        order[[k, p]], factor[[k, p]] = order[[p, k]], factor[[p, k]]
        if rest[order[k]] <= least:
            return factor[:, :k], order
        factor[k, k] = np.sqrt(rest[order[k]])
        below = order[k + 1 :]
        factor[k + 1 :, k] = (a[below, order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        rest[below] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of m columns, in rounds of pairs that share no column."""
    ring = list(range(m)) + [-1] * (m % 2)
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if -1 not in (a, b)]
        yield tuple(np.array(pairs, int).reshape(-1, 2).T)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times a rotation that makes its columns orthogonal, the longest first."""
    g = factor.copy()
    for _ in range(sweeps):
        worst = 0.0
        for p, q in _rounds(g.shape[1]):
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            size = np.sqrt(a * b)
            turn = np.abs(c) > np.finfo(float).eps * size
            worst = max(worst, float((np.abs(c) / np.where(size > 0, size, 1)).max(initial=0.0)))
            ratio = (b - a) / np.where(turn, 2 * c, 1)
            t = np.where(turn, np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(1, ratio)), 0.0)
            cos = 1 / np.hypot(1, t)
            g[:, p], g[:, q] = cos * (g[:, p] - t * g[:, q]), cos * (g[:, q] + t * g[:, p])
        if worst <= 4 * np.finfo(float).eps:
            break
    return g[:, np.argsort(-(g**2).sum(0), kind="stable")]


def decompose(covariance: np.ndarray, most: int = COMPONENTS, rank: float = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; a column's largest entry is positive."""
    factor, order = pivoted_cholesky(covariance)
    g = np.empty_like(factor)
    g[order] = jacobi(factor)
    values = (g**2).sum(0)
    g, values = g[:, :most], values[:most]
    held = values > rank * values.max(initial=0.0)
    directions = g[:, held] / np.sqrt(values[held])
    largest = directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])]
    return values[held], directions * np.where(largest < 0, -1.0, 1.0)


def fit_whitening(fit: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """``fit`` holds every different vector once, as ``x``."""
    n = fit.count()
    sums = {r["pos"]: int(r["s"]) for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).collect()}
    centre = Centre(n, np.array([sums[i] // n for i in range(d)], np.int64), np.array([sums[i] % n for i in range(d)], np.int64))
    covariance = _products(fit, d, centre.offsets) / n
    values, directions = decompose(covariance, most)
    return Whitening(centre, values, directions, float(np.trace(covariance)))


def identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """The largest difference between the covariance of the whitened fit list and the identity."""
    return float(np.abs(_products(fit, d, model.project) / model.centre.n - np.eye(len(model.values))).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row per complete vector and component (from 1)."""
    folder, spark = shared_folder(vectors.sparkSession), vectors.sparkSession
    points = stored(whole_numbers(vectors), folder, "points")
    lengths = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths["d"] == 0:
        return spark.createDataFrame([], RESULT)
    d = lengths["d"]
    points = points.filter(F.size("x") == d)
    fit = stored(points.select("x").distinct(), folder, "fit")
    model = fit_whitening(fit, d, most)
    k = len(model.values)
    if k == 0:
        return spark.createDataFrame([], RESULT)
    error, explained = identity_error(fit, d, model), model.values / model.trace

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column("x"), d), batch.num_rows
            repeated = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").cast(pa.int64()).take(repeated),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.centre.n)),
                    pa.array(model.centre.deviations(x), pa.int64()).take(repeated),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return points.select("vec_id", "x").mapInArrow(run, RESULT)
