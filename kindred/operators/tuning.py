"""LSH parameters from data: moments of distances by table size and rank, laws fitted to them, and a search of the parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.lsh import Repeat, StableDistribution, Tail

from .knn import exhaustive, lsh_nearest, recall, tables
from .lsh_model import DistanceModel, PowerModel, collision, gamma_fit, tune
from .ordering import checkpointed

#: Shares of the rows that are sampled, each within the next, and queries for each, at most.
SHARES, QUERIES = (0.125, 0.25, 0.5, 1.0), 400
#: Digits of a table are kept to this base, so that a bin is one number.
BASE = 128
SCALE = 1 << 20


def place(seed: int):
    """A row's place in 0 to SCALE - 1 by its id, from a hash that SQL engines share."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(SCALE))


def moments(rows: DataFrame, k: int, shares: Sequence[float] = SHARES, queries: int = QUERIES, seed: int = 1) -> DataFrame:
    """(n, rank, queries, mean, mean_log): of the distances from a sample's queries to their ``rank``-th neighbour among n rows.

    rows(id, vec). Samples are nested: a row is in those whose share is beyond its place. The queries are the ``queries``
    rows of least place, so they lie in all samples. Distances of 0 count in no moment, as their logarithm has none.
    """
    placed = checkpointed(rows.where("vec IS NOT NULL").select("id", "vec", place(seed).alias("place")))
    asked = checkpointed(placed.orderBy("place", "id").limit(queries))
    out = None
    for share in shares:
        sample = placed.where(F.col("place") < int(share * SCALE))
        near = exhaustive(asked.select("id", "vec"), sample.select("id", "vec"), k).where("dist > 0")
        at = near.groupBy("rank").agg(F.count("*").alias("queries"), F.avg(F.sqrt("dist")).alias("mean"), F.avg(F.log(F.sqrt("dist"))).alias("mean_log"))
        at = at.select(F.lit(sample.count()).cast("bigint").alias("n"), F.col("rank").cast("bigint").alias("rank"), "queries", "mean", "mean_log")
        out = at if out is None else out.unionByName(at)
    return out


def fitted(found: Sequence) -> DistanceModel:
    """The power laws of moments(): a few rows, one for each sample and rank."""
    n, k = [float(r["n"]) for r in found], [float(r["rank"]) for r in found]
    return DistanceModel(PowerModel.fit(n, k, [r["mean"] for r in found]), PowerModel.fit(n, k, [math.exp(r["mean_log"]) for r in found]))


def pair_law(rows: DataFrame, sample: int = 1000, seed: int = 2) -> tuple[float, float]:
    """(shape, scale) of the distances between any two rows, from the pairs of ``sample`` rows at most."""
    some = rows.where("vec IS NOT NULL").orderBy(place(seed), "id").limit(sample)
    x = np.array([r["vec"] for r in some.select("vec").collect()], np.float64)
    away = np.concatenate([np.linalg.norm(x[i + 1:] - x[i], axis=1) for i in range(len(x) - 1)])
    away = away[away > 0]
    return gamma_fit(float(away.mean()), float(np.exp(np.log(away).mean())))


@dataclass(frozen=True)
class Tuned:
    """Parameters of an index, and what the model expects of it: recall of the k nearest, share of the rows that a query meets."""
    tables: int
    digits: int
    width: float
    recall: float
    met: float

    def hashes(self, dim: int, seed: int = 0) -> list[Repeat]:
        return [Repeat(tuple(Tail(StableDistribution.draw(dim, self.width, 1000 * (seed + t) + i), BASE) for i in range(self.digits)), BASE) for t in range(self.tables)]


def chosen(model: DistanceModel, pairs: tuple[float, float], n: int, k: int, target: float, tables_most: int = 20, digits_most: int = 8,
           widths: int = 24) -> Tuned | None:
    """The parameters that reach the target recall and let a query meet the smallest share of the rows, in expectation.

    Recall grows with the number of tables and the width and falls with the number of digits, so tune() bisects each; widths
    are tried from a quarter to eight times the mean distance of the k-th neighbour, in equal ratios.
    """
    draws = [model.draws(n, r, 300, r) for r in range(1, k + 1)]
    shape, scale = pairs
    others = np.random.default_rng(0).gamma(shape, scale, 1500)
    near = float(draws[-1].mean())
    width = lambda w: near / 4 * 32 ** (w / (widths - 1))
    memo: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def collisions(w: int):
        if w not in memo:
            memo[w] = tuple(np.array([collision(d, width(w)) for d in of]) for of in (np.concatenate(draws), others))
        return memo[w]

    def reached(w: int, spare: int, t: int) -> float:
        return float((1 - (1 - collisions(w)[0] ** (digits_most - spare)) ** t).mean())

    def met(w: int, spare: int, t: int) -> float:
        return float((1 - (1 - collisions(w)[1] ** (digits_most - spare)) ** t).mean())

    best = tune([(0, widths - 1), (0, digits_most - 1), (1, tables_most)], lambda *p: reached(*p) >= target, met)
    if best is None:
        return None
    w, spare, t = best
    return Tuned(t, digits_most - spare, width(w), reached(*best), met(*best))


def tuned_search(rows: DataFrame, k: int, target: float, seed: int = 0) -> tuple[Tuned, DataFrame]:
    """Parameters tuned to rows(id, vec) and the k nearest that their index finds for each row: (q_id, id, dist, rank)."""
    n = rows.count()
    found = chosen(fitted(moments(rows, k).collect()), pair_law(rows), n, k, target)
    if found is None:
        raise ValueError(f"no index of these sizes reaches a recall of {target}")
    dim = rows.select(F.size("vec")).first()[0]
    hashes = found.hashes(dim, seed)
    return found, lsh_nearest(rows, tables(rows, hashes), hashes, k)


def report(rows: DataFrame, k: int, target: float) -> DataFrame:
    """(tables, digits, width, predicted, measured, met): the tuned index, and its recall against an exhaustive search."""
    spark = rows.sparkSession
    found, near = tuned_search(rows, k, target)
    got = recall(exhaustive(rows, rows, k).select("q_id", "id"), near).agg(F.avg("recall").alias("measured"))
    told = spark.createDataFrame([(found.tables, found.digits, found.width, found.recall, found.met)], "tables int, digits int, width double, predicted double, met double")
    return told.join(F.broadcast(got), F.lit(True))  # one row
