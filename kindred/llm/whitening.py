"""Embedding whitening: sums of centred products as generated SQL expressions, eigenvectors by LAPACK."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, usable_vector
from .topk import _matrix

#: Entries become floor(SCALE * c) + OFFSET; larger ones than ENTRY would leave the longs.
SCALE, OFFSET, ENTRY = 64, 1_000_000, 2.0**56
COMPONENTS = 16
#: Products that one aggregation sums: all pairs of 90 dimensions; more dimensions take several aggregations.
PAIRS_AT_ONCE = 4096
#: Eigenvalues of this share of the trace or less are rounding, not variance.
RANK_SHARE = 1e-12


def upper_triangle(dim: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dim) for j in range(i, dim)]


def column_sums(rows: DataFrame, column: str, dim: int) -> tuple[int, list]:
    """Rows, and the sum of each dimension of an array column."""
    got = rows.agg(F.count("*").alias("n"), *(F.expr(f"sum(`{column}`[{i}])").alias(f"s{i}") for i in range(dim))).first()
    return got["n"], [got[f"s{i}"] for i in range(dim)]


def covariance(rows: DataFrame, column: str, means: list[float]) -> np.ndarray:
    """The covariance of an array column, divisor its rows: entries are centred, multiplied and summed by pairs of dimensions."""
    dim, pairs = len(means), upper_triangle(len(means))
    centred = rows.select(*(F.expr(f"coalesce(`{column}`[{i}] - {float(m)!r}D, 0D)").alias(f"c{i}") for i, m in enumerate(means)))  # never null, so sums need no checks
    out = np.zeros((dim, dim))
    for lo in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[lo:lo + PAIRS_AT_ONCE]
        sums = centred.agg(F.count("*").alias("n"), *(F.expr(f"sum(c{i} * c{j})").alias(f"p{i}_{j}") for i, j in part)).first()
        for i, j in part:
            out[i, j] = out[j, i] = sums[f"p{i}_{j}"] / sums["n"]
    return out


class Whitening:
    """Components of a fit list of n vectors with sums S: unit eigenvectors as columns, their eigenvalues falling."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        values, vectors = np.linalg.eigh(covariance)
        trace = float(np.trace(covariance))
        best = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > RANK_SHARE * trace]
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.vectors, self.values = vectors[:, best], values[best]
        self.explained = self.values / trace if best else self.values

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: in longs, or in Python's integers where squares and sums could leave them."""
        x = x - self.base
        most = self.n * (int(np.abs(x).max(initial=0)) + 1)
        if x.shape[1] * most * most >= 2**63:
            return x.astype(object) * self.n - self.rest.astype(object)
        return x * self.n - self.rest

    def __call__(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def _slices(batches, column: int, rows: int = 2048):
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            yield part, _matrix(pa.chunked_array([part.column(column)]))


def _whiten(rows: DataFrame, dim: int, components: int) -> DataFrame:
    """whiten() for rows(vec_id, x) of one dimension."""
    fit_list = checkpointed(rows.select("x").distinct())
    n, sums = column_sums(fit_list, "x", dim)
    model = Whitening(n, sums, covariance(fit_list, "x", [s / n for s in sums]), components)
    k = len(model.values)

    def white(batches):
        for _, x in _slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(list(model(model.deviations(x))), pa.list_(pa.float64()))], names=["w"])

    error = 0.0
    if k:
        done = checkpointed(fit_list.mapInArrow(white, "w array<double>"))
        error = float(np.abs(covariance(done, "w", [s / n for s in column_sums(done, "w", k)[1]]) - np.eye(k)).max())

    def project(batches):
        for part, x in _slices(batches, 1):
            moved = model.deviations(x)
            w = model(moved)
            squares = [int(d) if d < 2**63 else None for d in (moved * moved).sum(1)]
            of_row = lambda a: np.repeat(a, k)
            each = lambda a: np.tile(a, len(x))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(of_row(np.arange(len(x))))), pa.array(each(np.arange(1, k + 1)), pa.int32()),
                pa.array(np.full(k * len(x), n), pa.int64()), pa.array(squares, pa.int64()).take(pa.array(of_row(np.arange(len(x))))),
                pa.array(w.ravel(), pa.float64()), pa.array(each(model.explained), pa.float64()), pa.array(np.full(k * len(x), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(
        project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Entries c become longs x = floor(64 c) + 1000000. Of the distinct vectors x (n of them, with sums S) the covariance is
    taken in one aggregation of generated expressions, one for each pair of dimensions, over centred entries;
    components are its unit eigenvectors by falling eigenvalue e. whitened is x - S / n along the component over sqrt(e),
    explained e over the trace, deviation the exact sum of (n x - S)^2 over the dimensions, identity_error the
    largest absolute entry of the covariance of whitened over the fit list, minus the identity; it is measured.

    Vectors that are null or empty, hold null or non-finite entries or entries of 2^56 or more in size, beyond which x
    is no long, give no rows. Null ids stay, repeated rows give theirs each. Components without variance (an eigenvalue
    of 10^-12 of the trace or less) are left out: with one distinct vector there are none, and no rows. A deviation beyond
    the longs is null. Vectors of different dimensions are tables of their own. Empty tables give no rows; other
    columns are ignored, whatever their names.

    The driver gets sums, never rows; equal vectors are combined before the shuffle. Work grows with the rows, and
    with the square of the dimension.
    """
    small = F.forall(vec_col, lambda v: F.abs(v.cast("double")) < ENTRY)
    x = F.transform(vec_col, lambda v: F.floor(v.cast("double") * float(SCALE)) + F.lit(OFFSET).cast("long"))
    rows = vectors.where(usable_vector(F.col(vec_col))).where(small).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    dims = [r["dim"] for r in rows.select(F.size("x").alias("dim")).distinct().orderBy("dim").collect()]
    found = [_whiten(rows.where(F.size("x") == d), d, components) for d in dims]
    if not found:
        return rows.select("vec_id", F.lit(0).alias("component"), *(F.lit(0).cast("long").alias(c) for c in ("n", "deviation")),
                           *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
