"""Embedding whitening (operator 13).

Vectors become whole numbers, ``floor(256 * c)``.  The fit list is each distinct
whole-number vector once; copies meet before the shuffle.  Tasks add up their
rows' sums, then the products of their centred rows; both are summed up by Spark,
dimension by dimension, so that the driver gets one vector and one matrix, whose sizes
are the dimension's and not the table's.

The covariance matrix is made tridiagonal by Householder reflections.  Sturm counts
(how many eigenvalues lie below a number) bisect the leading eigenvalues;
inverse iteration gives their vectors, and those of eigenvalues that lie close
together are made orthogonal to each other in every step.  The reflections
bring them back.  The components go to all tasks, and each row is projected by itself.

Rows whose vector is null, empty or holds null or non-finite entries take no
part.  If lengths differ, the vectors of the most frequent length (of two equally frequent ones
the greater) take part.  Numbers beyond 64 bits are held at the largest one.
``deviation`` is null where it doesn't fit in 64 bits.  Components without
variance are left out, so that fewer distinct vectors than two give no rows.
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm._graph import with_checkpoints
from stocktake.llm._rows import stream

#: Rows of a batch that are multiplied at once.
AT_ONCE = 4096
_TOP = float(2**63)


def whole(embeddings: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    # A double below 2^63 fits in a long; floor() of a larger one doesn't.
    x = F.transform("v", lambda c: F.when(c * scale >= _TOP, F.lit(2**63 - 1)).when(c * scale < -_TOP, F.lit(-(2**63))).otherwise(F.floor(c * scale)))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).head(1)
    return rows.where(F.size("v") == (lengths[0]["dim"] if lengths else 0)).select("vec_id", x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(a, AT_ONCE)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for _, x in _blocks(batches, dim):
            # Halves of 32 bits, so that no sum overflows.
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n, np.int64)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = stream(fit.select("x"), run, "i int, n long, high long, low long").groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low"))).orderBy("i").collect()
    return (int(parts[0]["n"]), [int(r["high"]) * 2**32 + int(r["low"]) for r in parts]) if parts else (0, [])


def covariance(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """Products of the centred rows, over ``n``."""
    dim = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((dim, dim)), False
        for _, x in _blocks(batches, dim):
            centred = x.astype(np.float64) - mean
            total += centred.T @ centred
            any_rows = True
        if any_rows:
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((dim, dim))
    rows = stream(fit.select("x"), run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    for i, j, v in rows:
        out[i, j] = out[j, i] = v / n
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections, in order."""
    a = a.copy()
    size, reflections = len(a), []
    for k in range(size - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        length = np.linalg.norm(v)
        v = v / length if length > 0 else np.zeros_like(v)
        # The same reflection from both sides, as one update of rank two.
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ x)
        reflections.append(v)
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(size - 1)]), reflections


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are less than each of some numbers."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = off * off
    least = max(tiny, tiny * float(squares.max(initial=0.0)))
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - at - squares[i - 1] / q
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    reach = np.abs(np.concatenate((off, [0.0]))) + np.abs(np.concatenate(([0.0], off)))
    low, high = np.full(k, float((diagonal - reach).min())), np.full(k, float((diagonal + reach).max()))
    margin = np.finfo(float).eps * max(abs(low[0]), abs(high[0])) * 4 + np.finfo(float).tiny
    low, high = low - margin, high + margin
    rank = len(diagonal) - np.arange(1, k + 1)  # so many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        up = below(diagonal, off, middle) <= rank
        low, high = np.where(up, middle, low), np.where(up, high, middle)


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a zero pivot becomes a tiny one."""
    n = len(diagonal)
    eps = np.finfo(float).eps * max(1e-300, float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)))
    d, up, upper, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    low = off.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low_i, up[i], d_next = low[i], d[i], d[i + 1], up[i]
            upper[i], up_next = (up[i + 1], 0.0) if i + 2 < n else (0.0, 0.0)
            x[i], x[i + 1] = x[i + 1], x[i]
            f = low_i / d[i]
            d[i + 1] = d_next - f * up[i]
            if i + 2 < n:
                up[i + 1] = up_next - f * upper[i]
        else:
            if d[i] == 0:
                d[i] = eps
            f = low[i] / d[i]
            d[i + 1] -= f * up[i]
        x[i + 1] -= f * x[i]
    for i in range(n - 1, -1, -1):
        if abs(d[i]) < eps:
            d[i] = eps if d[i] >= 0 else -eps
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (upper[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
        if abs(x[i]) > 1e150:
            x = [y * 1e-150 for y in x]
    return np.array(x)


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; only those above rounding."""
    if not matrix.any():
        return np.zeros(0), np.zeros((len(matrix), 0))
    scale = float(np.abs(matrix).max())
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading(diagonal, off, min(k, len(matrix)))
    values = values[values > len(matrix) * np.finfo(float).eps * max(values[0], np.finfo(float).tiny)]
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    draw, vectors, cluster = np.random.default_rng(13), [], 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            cluster = i
        # Equal shifts would give equal vectors; they are kept apart a little.
        shift = value - (i - cluster) * 2 * np.finfo(float).eps * norm
        x = draw.standard_normal(len(diagonal))
        for _ in range(5):
            for y in vectors[cluster:]:
                x -= (y @ x) * y
            x = solve(diagonal, off, shift, x / np.linalg.norm(x))
            for _ in range(2):
                for y in vectors[cluster:]:
                    x -= (y @ x) * y
            x /= np.linalg.norm(x)
        vectors.append(x)
    out = np.array(vectors).T if vectors else np.zeros((len(matrix), 0))
    for step in range(len(reflections) - 1, -1, -1):
        v = reflections[step]
        out[step + 1 :] -= 2 * np.outer(v, v @ out[step + 1 :])
    return values * scale, out


class Whitener:
    """What is fitted: number of vectors, exact sums, eigenvalues, components as columns, and the matrix' trace."""

    def __init__(self, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.total, self.values, self.vectors, self.trace = n, total, values, vectors, trace
        self.mean = np.array([s / n for s in total]) if n else np.zeros(len(total))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - total)^2, exact; None beyond 64 bits."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.total), default=0)
        if most * most * max(1, x.shape[1]) < 2**63:
            d = x * self.n - np.array(self.total, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.total, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def fit(rows: DataFrame, k: int = 4) -> tuple[Whitener, DataFrame]:
    """The fitted whitening of ``rows`` (see :func:`whole`), and the fit list."""
    distinct = with_checkpoints(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"))
    first = distinct.head(1)
    if not first:
        return Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), distinct
    dim = len(first[0]["x"])
    n, total = sums(distinct, dim)
    matrix = covariance(distinct, n, np.array([s / n for s in total]))
    return Whitener(n, total, *components(matrix, k), float(np.trace(matrix))), distinct


def identity_error(distinct: DataFrame, model: Whitener) -> float:
    """The largest entry of the covariance of the whitened fit list minus the identity."""
    dim, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, dim):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in model.project(x).T], names=[f"w{i}" for i in range(k)])

    w = stream(distinct, run, ", ".join(f"w{i} double" for i in range(k)))
    mean = w.agg(*(F.avg(f"w{i}").alias(f"w{i}") for i in range(k))).first()
    each = [(i, j) for i in range(k) for j in range(i + 1)]
    products = w.agg(*(F.avg((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])).alias(f"p{i}_{j}") for i, j in each)).first()
    return max(abs(p - (i == j)) for (i, j), p in zip(each, products, strict=True))


def whiten(embeddings: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component."""
    rows = whole(embeddings, id_col=id_col, vec_col=vec_col)
    model, distinct = fit(rows, k)
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    dim, k = model.vectors.shape
    error = identity_error(distinct, model)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim):
            m = len(x)
            each = np.repeat(np.arange(m), k)
            columns = [
                part.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n, np.int64)),
                pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                pa.array(model.project(x).reshape(-1)),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return stream(rows, run, schema)
