"""Matrix binarisers, spectral hashing and vector quantisation: linear algebra in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a batch's vectors, which must be of one length; null components are not numbers."""
    n = np.diff(column.offsets.to_numpy())
    if (n != n[0]).any():
        raise ValueError(f"vectors of {n.min()} and of {n.max()} components in one table")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(n), -1)


def _map_vectors(df: DataFrame, vec: str, out: str, kind: str, compute) -> DataFrame:
    """df without ``vec``, with ``out`` = compute(matrix of the vectors); a null vector gives null."""
    keep = [c for c in df.columns if c != vec]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != vec] + [f"`{out}` {kind}"])

    def run(batches):
        for b in batches:
            column = b.column(len(keep))
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                found = compute(_matrix(column.take(pa.array(there))))
                place = np.full(b.num_rows, -1)
                place[there] = np.arange(len(there))
                column = found.take(pa.array(place, mask=place < 0))
            else:
                column = pa.nulls(b.num_rows, to_arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), column], names=[*keep, out])

    to_arrow = {"binary": pa.binary(), "bigint": pa.int64()}[kind]
    return df.select(*keep, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, schema)


def projection_sketch(df: DataFrame, vec: str, matrix: np.ndarray, offset: np.ndarray, out: str = "sketch") -> DataFrame:
    """bit k = (matrix . x)_k + offset_k <= 0, packed in bytes; rows beyond the matrix count as zero bits.

    The matrix and the offsets (128 or 64 rows) come from training and are parameters.
    """
    def compute(x):
        return pa.array([r.tobytes() for r in np.packbits(x @ matrix.T + offset <= 0, axis=1)], pa.binary())
    return _map_vectors(df, vec, out, "binary", compute)


def window_sketch(df: DataFrame, vec: str, bits: int = 128, w: float = 8.0, seed: int = 1, out: str = "sketch",
                  matrix: np.ndarray | None = None, offset: np.ndarray | None = None) -> DataFrame:
    """One bit per stable-distribution hash of width w: the least bit of floor((a.x + b) / w).

    The hashes are drawn from the seed, or given as the rows of ``matrix`` and ``offset``.
    """
    def compute(x):
        r = np.random.default_rng(seed)
        a, b = (r.normal(size=(bits, x.shape[1])), r.random(bits) * w) if matrix is None else (matrix, offset)
        return pa.array([v.tobytes() for v in np.packbits(np.floor((x @ a.T + b) / w).astype(int) & 1, axis=1)], pa.binary())
    return _map_vectors(df, vec, out, "binary", compute)


def principal_axes(df: DataFrame, vec: str, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) from sums over all vectors that are not null: one d x d matrix per task, d fixed by the vectors.

    An axis points to the side where its greatest component is positive.
    """
    def moments(batches):
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[float(n), *s.tolist(), *ss.ravel().tolist()]])], names=["sums"])

    rows = df.select(F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    sums = rows.mapInArrow(moments, "sums array<double>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(
        F.sum("x").alias("x")).orderBy("i").collect()
    if not sums:
        raise ValueError("no vectors")
    n, *rest = (r["x"] for r in sums)
    x = np.array(rest)
    d = int((-1 + (1 + 4 * len(x)) ** 0.5) / 2)
    mean = x[:d] / n
    axes = np.linalg.eigh(x[d:].reshape(d, d) / n - np.outer(mean, mean))[1][:, ::-1][:, :count].T
    side = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
    return mean, axes * np.sign(side)[:, None]


def spectral_hash(df: DataFrame, vec: str, mean: np.ndarray, axes: np.ndarray, modes: np.ndarray, out: str = "code") -> DataFrame:
    """bit k: the product over axes j of sin(X_j modes_kj + pi / 2) is positive, X on principal axes."""
    def compute(x):
        p = (x - mean) @ axes.T
        bits = np.prod(np.sin(p[:, None, :] * modes[None] + np.pi / 2), axis=2) > 0
        return pa.array((bits * (1 << np.arange(len(modes)))).sum(axis=1), pa.int64())
    return _map_vectors(df, vec, out, "bigint", compute)


def nearest_mean(df: DataFrame, vec: str, means: np.ndarray, out: str = "cell") -> DataFrame:
    """Vector quantisation: the number of the nearest of K means, the first of equals; a product of 4096 rows and the means at a time."""
    means = np.asarray(means, np.float64)
    norms = (means * means).sum(axis=1)

    def compute(x):
        parts = [(norms - 2 * (x[lo:lo + 4096] @ means.T)).argmin(axis=1) for lo in range(0, len(x), 4096)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return _map_vectors(df, vec, out, "bigint", compute)
