"""Exact k-nearest neighbours over cells of pivots that the triangle inequality lets a query skip."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .knn import nearest_in_bins
from .ordering import checkpointed

#: Pivots, at most, and rows of the sample that they come from, at most.
PIVOTS, SAMPLE = 64, 4096
#: Bounds are lowered by this share of the distances that they come from, so that rounding skips no cell.
SLACK = 1e-9


def far_points(sample: np.ndarray, count: int) -> np.ndarray:
    """Points of the sample, each the one farthest from those before it, as far as they differ."""
    chosen = [0]
    away = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < count and away.max(initial=0) > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each row to each pivot; a pivot at a time, so that no difference is lost to rounding."""
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(queries: DataFrame, rows: DataFrame, k: int, pivots: int = PIVOTS, sample: int = SAMPLE, told: list[tuple[int, int]] | None = None) -> DataFrame:
    """(q_id, id, dist, rank): the k nearest of each query under squared L2 among rows of another id, ties by id.

    Every row lies in the cell of its nearest pivot, and a cell knows its least and greatest distance d to it. A row of the
    cell is no nearer to a query than max(d(q, p) - greatest, least - d(q, p)), nor, for any other pivot o, than half
    of d(q, p) - d(q, o), as p is the row's nearest. A query takes cells by that bound: one at first, then twice as many a
    round, and leaves once the next bound exceeds its k-th distance so far. So the result is exact, and what a
    round meets is only what the queries still need. ``told`` gets (cells asked for, pairs of queries and cells) a round.

    Null vectors take no part; vectors have one dimension. Pivots come from a sample of ``sample`` rows at most.
    """
    double = lambda df: df.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"))
    rows, queries = double(rows), checkpointed(double(queries))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    if not some:
        return queries.limit(0).select(F.col("id").alias("q_id"), "id", F.lit(0.0).alias("dist"), F.lit(0).cast("bigint").alias("rank"))
    points = far_points(np.array([r["vec"] for r in some], np.float64), pivots)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                away = distances(_matrix(b.column(1)), points)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], names=["id", "vec", "bin", "away"])

    coded = checkpointed(rows.mapInArrow(assign, "id bigint, vec array<double>, bin int, away double"))
    low, high = np.full(len(points), np.inf), np.full(len(points), -np.inf)
    for r in coded.groupBy("bin").agg(F.min("away").alias("low"), F.max("away").alias("high")).collect():  # a row a pivot
        low[r["bin"]], high[r["bin"]] = r["low"], r["high"]
    full = np.isfinite(low)

    def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of each query by lower bound, and the bounds in that order; empty cells come last, at no end."""
        away = distances(x, points)
        bound = np.maximum(np.maximum(away - high, low - away), (away - away.min(axis=1, keepdims=True)) / 2)
        bound = np.maximum(bound - SLACK * (away + np.where(full, high, 0)), 0)
        bound[:, ~full] = np.inf
        order = np.argsort(bound, axis=1, kind="stable")
        return order, np.take_along_axis(bound, order, axis=1)

    def ask(batches):
        """Cells number ``from`` to ``to`` of each query whose bound is not beyond the k-th distance."""
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                order, bound = ordered(_matrix(part.column(1)))
                first, last, most = (part.column(c).to_numpy(zero_copy_only=False) for c in range(2, 5))
                at = np.arange(len(points))[None, :]
                q, c = np.nonzero((at >= first[:, None]) & (at < last[:, None]) & (bound * bound <= most[:, None] * (1 + SLACK)) & np.isfinite(bound))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q)), pa.array(order[q, c], pa.int32())], names=["q_id", "q_vec", "bin"])

    index = coded.select(F.lit(0).alias("tab"), "bin", "id", "vec")
    best, seen, more = None, 0, 1
    while seen < len(points):
        to = min(seen + more, len(points))
        kth = F.lit(float("inf"))
        state = queries
        if best is not None:
            bound = best.where(F.col("rank") == k).select(F.col("q_id").alias("id"), F.col("dist").alias("kth"))
            state, kth = queries.join(bound, "id", "left"), F.coalesce("kth", F.lit(float("inf")))
        asks = checkpointed(state.select("id", "vec", F.lit(seen).alias("first"), F.lit(to).alias("last"), kth.alias("most")).mapInArrow(
            ask, "q_id bigint, q_vec array<double>, bin int"))
        n = asks.count()
        if told is not None:
            told.append((to - seen, n))
        if best is not None and not n:
            break  # bounds only grow along a query's order, so nothing later is needed either
        found = nearest_in_bins(asks.select("q_id", "q_vec", F.lit(0).alias("tab"), "bin", F.lit(0).alias("probe")), index, k).select("q_id", "id", "dist")
        if best is not None:
            found = found.unionByName(best.select("q_id", "id", "dist"))
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "id")).cast("bigint")
        best = checkpointed(found.withColumn("rank", rank).where(F.col("rank") <= k))
        seen, more = to, 2 * more
    return best
