"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charpoly
from .common import staged

#: Steps of an entry, and what is added to them.
STEPS, OFFSET = 64, 1_000_000

#: Steps beyond which an entry counts as this far out, so that squares of all rows fit 38 digits.
WIDEST = 1 << 40

COMPONENTS = 16

#: Rows whose products a float64 sum holds exactly: 2^12 of 2^20 x 2^20 stay below 2^53.
ROWS = 1 << 12

_HALF = 20

OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _steps(vector: Column) -> Column:
    """floor(64 c) of each entry as long; null where the vector is null or empty, or an entry is null or not finite."""
    sound = F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False)) & (F.size(vector) > 0)
    return F.when(sound, F.transform(vector, lambda c: F.floor(F.greatest(F.lit(float(-WIDEST)), F.least(F.lit(float(WIDEST)), c.cast("double") * STEPS)))))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _scatter(y: np.ndarray) -> np.ndarray:
    """Exact sum of y y^T over the rows, as Python integers. |y| is at most WIDEST."""
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for at in range(0, len(y), ROWS):
        part = y[at : at + ROWS]
        if np.abs(part).max() < 1 << _HALF:
            f = part.astype(np.float64)
            total += (f.T @ f).astype(np.int64).astype(object)
        else:
            high, low = (part >> _HALF).astype(np.float64), (part & (1 << _HALF) - 1).astype(np.float64)
            cross = (high.T @ low).astype(np.int64).astype(object)
            total += ((high.T @ high).astype(np.int64).astype(object) << 2 * _HALF) + (cross + cross.T << _HALF) + (low.T @ low).astype(np.int64).astype(object)
    return total


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, n sum y y^T - S S^T) of the vectors y of d longs, exact. A task gives one row for each pair of dimensions; the driver gets their sums, d (d + 3) / 2 + 1 numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            y = _matrix(batch.column(0), d)
            if len(y):
                count += len(y)
                sums += y.sum(axis=0).astype(object)
                squares += _scatter(y)
        i, j = np.triu_indices(d)
        at = np.concatenate([[-1], np.arange(d), i]), np.concatenate([[-1], np.full(d, -1), j])
        values = [count, *sums, *squares[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["i", "j", "v"])

    parts = fit.mapInArrow(partial, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    v = {(r["i"], r["j"]): int(r["v"]) for r in parts}
    n, sums = v[-1, -1], [v[i, -1] for i in range(d)]
    return n, sums, [[n * v[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def _centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n y - S: int64 where all that follows fits in it, else Python integers."""
    widest = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
    if widest**2 * y.shape[1] < 1 << 63:
        return y * n - np.array(sums, dtype=np.int64)
    return y.astype(object) * n - np.array(sums, dtype=object)


def identity_error(fit: DataFrame, n: int, sums: list[int], turn: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity. A task gives one row for each pair of components."""
    d, k = turn.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _centred(_matrix(batch.column(0), d), n, sums).astype(np.float64) @ turn
            total += w.sum(axis=0)
            squares += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(k), i]), pa.int32()), pa.array(np.concatenate([np.full(k, -1), j]), pa.int32()), pa.array(np.concatenate([total, squares[i, j]]))], ["i", "j", "v"])

    v = {(r["i"], r["j"]): r["v"] / n for r in fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max(abs(v[i, j] - v[i, -1] * v[j, -1] - (i == j)) for i in range(k) for j in range(i, k))


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector's coordinates on up to `most` whitened components.

    An entry c counts as x = floor(64 c) + 1000000. The model is that of the distinct x vectors, n of them with sums S: their
    scatter matrix is an exact integer matrix, its characteristic polynomial is found modulo primes and by Chinese remainders, its
    greatest roots are isolated by exact sign changes, and a component is the null vector at its root. deviation is the sum of
    (n x - S)^2 over the dimensions; explained is the root's share of the trace.

    The distinct vectors are written once. A task's sums are d^2 / 2 numbers, whatever its rows; the driver gets the sums of all.
    Time grows with the fourth power of the width: meant for some hundreds of dimensions.

    Null vectors and vectors with null or non-finite entries: no rows. The dimension is the length that most distinct vectors
    have, the longer of equals; other lengths: no rows. Entries of more than 2^40 steps: as 2^40. Components with root 0: none, so
    that fewer than two distinct vectors give no rows. A deviation of 2^63 or more: null. Roots that repeat: any orthonormal
    components of them. Repeated rows and null ids: rows each. Empty table: no rows. Extra columns, whatever their names: left out.
    """
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    own = rows.select(F.col(id_col).alias("vec_id"), _steps(F.col(vector_col)).alias("y"))
    fit = staged(own.where("y is not null").select("y").distinct(), "whitening-fit")
    lengths = fit.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    nothing = spark.createDataFrame([], f"vec_id {kind}, {OUT}")
    if lengths is None:
        return nothing
    d = lengths["d"]
    fit = fit.where(F.size("y") == d)
    n, sums, matrix = scatter(fit, d)
    found = charpoly.components(spark, matrix, most)
    if not found:
        return nothing
    turn = np.array([v for _, _, v in found]).T / np.sqrt([root for root, _, _ in found])  # n x - S times this: n cancels
    explained, error = np.array([share for _, share, _ in found]), identity_error(fit, n, sums, turn)
    k = len(found)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = _centred(_matrix(batch.column(1), d), n, sums)
            size, every = len(centred), np.repeat(np.arange(len(centred)), k)
            deviation = [s if s < 1 << 63 else None for s in (centred * centred).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)), pa.array(deviation, pa.int64()).take(pa.array(every)),
                    pa.array((centred.astype(np.float64) @ turn).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.where(F.size("y") == d).mapInArrow(project, f"vec_id {kind}, {OUT}")
