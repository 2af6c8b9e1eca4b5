"""Whitened leading components of embeddings, their eigenvalues found by spectrum slicing.

Spark gathers the covariance of the distinct vectors; the matrix is as wide as a vector, whatever the number of rows.
Its leading eigenvalues are found by counting: the negative pivots of an LDLᵀ factorisation of V - sI are the
eigenvalues below s (inertia). Halving intervals by that count isolates each of them, Rayleigh quotient iteration
converges to it cubically, and two more counts just beside the result certify its number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.session import materialise

SCALE = 256
COMPONENTS = 4
#: Bunch and Parlett's bound between pivots of one and of two rows.
_ALPHA = (1 + math.sqrt(17)) / 8
_EPS = np.finfo(np.float64).eps
_LONG = 2**63 - 1


def eigenvalues_below(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of a symmetric matrix below ``shift``, by the inertia of LDLᵀ of the shifted matrix.

    Pivots are the largest entries left (one row, or two rows around an off-diagonal entry, which always have one
    negative and one positive eigenvalue), so that no pivot grows.
    """
    a = matrix - shift * np.eye(len(matrix))
    below = 0
    while len(a):
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = divmod(int(off.argmax()), len(a))
        k = int(np.abs(np.diag(a)).argmax())
        if off[p, q] == 0 and a[k, k] == 0:
            return below  # the rest is zero: eigenvalues at the shift, not below it
        if abs(a[k, k]) >= _ALPHA * off[p, q]:
            rows, pivot = [k], a[k : k + 1, k : k + 1]
            below += pivot[0, 0] < 0
        else:
            rows, pivot = [p, q], a[np.ix_([p, q], [p, q])]
            below += 1
        rest = np.setdiff1d(np.arange(len(a)), rows)
        side = a[np.ix_(rest, rows)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return int(below)


def _rayleigh(unit: np.ndarray, start: float, found: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from a shift, across the vectors found already, whose eigenvalues go to the far end."""
    size = len(unit)
    matrix = unit - found @ np.diag(np.einsum("ij,ij->j", found, unit @ found) + 2) @ found.T
    vector = np.cos(np.arange(1, size + 1) * 1.7) + 0.5  # no special direction
    shift, best, value = start, math.inf, start
    kept = vector / np.linalg.norm(vector)
    for step in range(60):
        shifted = matrix - shift * np.eye(size)
        try:
            vector = np.linalg.solve(shifted, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue
            vector = np.linalg.solve(shifted + _EPS * np.eye(size), vector)
        vector /= np.linalg.norm(vector)
        for _ in range(2):
            vector = vector - found @ (found.T @ vector)
            vector /= np.linalg.norm(vector)
        quotient = float(vector @ matrix @ vector)
        left = float(np.linalg.norm(matrix @ vector - quotient * vector))
        if left < best:
            best, kept, value = left, vector, quotient
        elif step > 4:
            break
        if step >= 2:  # the first solutions keep to the interval's middle
            shift = quotient
    return value, kept


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues in falling order, and their unit vectors as columns.

    An interval holds number k if k eigenvalues lie above its lower end and k - 1 above its upper end. Where a
    cluster is narrower than doubles can part, any orthonormal vectors of its space are right.
    """
    size = len(matrix)
    radius = np.abs(matrix).sum(axis=1) if size else np.zeros(0)
    norm = float(radius.max(initial=0.0))
    count = min(count, size)
    values, vectors = np.zeros(count), np.zeros((size, 0))
    if norm == 0:
        return values, np.eye(size)[:, :count]
    unit = matrix / norm

    def above(shift: float) -> int:
        return size - eigenvalues_below(unit, shift)

    width = 64 * _EPS
    for k in range(1, count + 1):
        low, high = -1 - 1e-6, 1 + 1e-6
        isolated = False
        while True:
            while high - low > width and not isolated:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= k else (low, middle)
                isolated = above(low) == k and above(high) == k - 1
            value, vector = _rayleigh(unit, (low + high) / 2, vectors)
            near = abs(value - (low + high) / 2) <= (high - low) / 2 + width
            if high - low <= width or near and above(value - width) >= k and above(value + width) <= k - 1:
                break
            isolated = False  # it went to a neighbour: halve on and try again
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        values[k - 1], vectors = value * norm, np.column_stack([vectors, vector])
    return values, vectors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def usable(vector: str) -> Column:
    """Neither null nor with null or non-finite entries."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def _sums(fit: DataFrame) -> tuple[int, int, list[int]]:
    """The number of vectors, their width and their exact sums per dimension."""
    one = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in one.collect()}  # one row per dimension
    return fit.count(), len(found), [found[i] for i in range(len(found))]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, taken apart so that whole parts cancel exactly."""
    whole = [s // n for s in sums]
    part = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    if max((abs(w) for w in whole), default=0) < 2**62 and np.abs(x).max(initial=0) < 2**62:
        return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - part
    return (x.astype(object) - np.array(whole, dtype=object)).astype(np.float64) - part


def _products(fit: DataFrame, n: int, sums: list[int], project: np.ndarray | None) -> np.ndarray:
    """Mean products of the centred vectors, or of what ``project`` makes of them: one matrix per task, added up by Spark."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            c = _centred(_matrix(batch.column(0), width), n, sums)
            c = c if project is None else c @ project
            total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    size = width if project is None else project.shape[1]
    out = np.zeros((size, size))
    for r in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n  # as many rows as the matrix has entries
    return out


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows of id and component with ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Vectors that are null or hold null or non-finite entries go. Entries become floor(256 x). The mean and every covariance
    (divisor n) are over the different vectors, each once, so copies have no weight. ``deviation`` is the exact sum of
    (n x - S)² as a decimal, null from 38 digits on. Vectors of several lengths are taken as ending in zeros. Repeated rows
    and null ids are rows of their own. A component whose eigenvalue is nought (fewer different vectors than components) has
    no scale: its ``whitened`` is null and it takes no part in ``identity_error``; with one different vector ``explained`` is
    null too. A table without such vectors, or with empty ones alone, gives no rows. Other columns are ignored.
    """
    rows = embeddings.filter(usable(vector)).select(F.col(id_col).alias("vec_id"), quantised(vector).alias("x"))
    fit = materialise(rows.select("x").distinct(), "whitening")
    n, width, sums = _sums(fit)
    schema = f"{id_col} {embeddings.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if n == 0 or width == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    covariance = _products(fit, n, sums, None)
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components)
    real = values > trace * width * _EPS
    scaled = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    measured = _products(fit, n, sums, scaled[:, real]) if real.any() else np.zeros((0, 0))
    error = float(np.abs(measured - np.eye(len(measured))).max()) if real.any() else None
    explained = [float(v / trace) if trace > 0 else None for v in values]
    count = len(values)
    most = max(abs(s) for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            if not len(x):
                continue
            bound = n * int(np.abs(x.astype(object)).max()) + most if n * 2.0**63 > 0 else 0
            exact = np.int64 if width * bound * bound <= _LONG else object
            off = n * x.astype(exact) - np.array(sums, dtype=exact)
            deviation = [int(d) for d in (off * off).sum(axis=1)]
            deviation = pa.array([d if d < 10**38 else None for d in deviation], pa.decimal128(38, 0))
            whitened = (_centred(x, n, sums) @ scaled).ravel()
            usable_value = np.tile(real, len(x))
            each = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0).take(each),
                "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                "n": pa.array([n] * len(each), pa.int64()),
                "deviation": deviation.take(each),
                "whitened": pa.array(whitened, mask=~usable_value),
                "explained": pa.array(explained * len(x), pa.float64()),
                "identity_error": pa.array([error] * len(each), pa.float64()),
            })

    return rows.mapInArrow(run, schema)
