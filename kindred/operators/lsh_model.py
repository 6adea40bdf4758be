"""Models of LSH recall and cost, their tuning, and searches that adapt to them.

After the published performance model of multi-probe LSH and a-posteriori probing. Models are small and live on the
driver; searches are DataFrames.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.lsh import StableDistribution

from .knn import best_found, digit_tables, exhaustive, nearest_in_bins, probed
from .ordering import checkpointed


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def gamma_fit(mean: float, geometric_mean: float) -> tuple[float, float]:
    """(shape, scale) of greatest likelihood: ln k - digamma(k) = ln mean - ln geometric mean."""
    gap = max(math.log(mean) - math.log(geometric_mean), 1e-9)
    low, high = 1e-6, 1e9
    for _ in range(200):
        k = math.sqrt(low * high)
        if math.log(k) - digamma(k) > gap:
            low = k
        else:
            high = k
    return low, mean / low


@dataclass(frozen=True)
class PowerModel:
    """exp(a) N^b K^c, fitted to positive values by least squares of logarithms."""
    a: float
    b: float
    c: float

    @staticmethod
    def fit(n: Sequence[float], k: Sequence[float], values: Sequence[float]) -> PowerModel:
        x = np.column_stack([np.ones(len(n)), np.log(n), np.log(k)])
        return PowerModel(*np.linalg.lstsq(x, np.log(values), rcond=None)[0].tolist())

    def __call__(self, n: float, k: float) -> float:
        return math.exp(self.a) * n**self.b * k**self.c


@dataclass(frozen=True)
class DistanceModel:
    """Distances to the k-th of n neighbours: gamma laws whose two means follow power models."""
    mean: PowerModel
    geometric: PowerModel

    def law(self, n: float, k: float) -> tuple[float, float]:
        mean = self.mean(n, k)
        return gamma_fit(mean, min(self.geometric(n, k), mean * (1 - 1e-9)))

    def draws(self, n: float, k: float, count: int = 2000, seed: int = 0) -> np.ndarray:
        shape, scale = self.law(n, k)
        return np.random.default_rng(seed).gamma(shape, scale, count)


def collision(distance: float, width: float) -> float:
    """Probability that one Gaussian hash of a bin width puts two points at a distance together."""
    if distance <= 0:
        return 1.0
    c = width / distance
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def table_recall(distance: float, width: float, digits: int, tables: int) -> float:
    return 1 - (1 - collision(distance, width) ** digits) ** tables


def model_recall(model: DistanceModel, n: float, k: int, width: float, digits: int, tables: int) -> float:
    """Mean recall of the k nearest of n points."""
    return float(np.mean([np.mean([table_recall(d, width, digits, tables) for d in model.draws(n, r, 200, r)]) for r in range(1, k + 1)]))


@dataclass(frozen=True)
class RecallTable:
    """Probability that a point is found with up to t probes, by logarithm of its distance."""
    least: float
    step: float
    values: np.ndarray  # bins x (probes + 1)

    @staticmethod
    def simulate(width: float, digits: int, probes: int, least: float, greatest: float, bins: int = 40, draws: int = 4000, seed: int = 0, tables: int = 1) -> RecallTable:
        r = np.random.default_rng(seed)
        step = math.log(greatest / least) / (bins - 1)
        at, move = r.random((draws, digits)), r.normal(size=(draws, digits))
        cost, steps = np.zeros((draws, 1)), np.zeros((draws, 1, 0), int)
        for d in range(digits):  # as in knn.perturbations
            low = at[:, d:d + 1]
            cost = np.concatenate([cost, cost + low**2, cost + (1 - low) ** 2], axis=1)
            steps = np.concatenate([np.concatenate([steps, np.full((*steps.shape[:2], 1), s)], axis=2) for s in (0, -1, 1)], axis=1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes + 1]
            cost, steps = np.take_along_axis(cost, best, 1), np.take_along_axis(steps, best[:, :, None], 1)
        out = np.zeros((bins, probes + 1))
        for b in range(bins):
            jump = np.floor(at + move * least * math.exp(step * b) / width).astype(int)
            same = (steps == jump[:, None]).all(axis=2)
            rank = np.where(same.any(axis=1), same.argmax(axis=1), probes + 1)
            out[b] = [1 - (1 - (rank <= t).mean()) ** tables for t in range(probes + 1)]
        return RecallTable(least, step, out)

    def lookup(self, distance, probes):
        """Column of the recall at a distance with a number of probes."""
        flat = F.array(*[F.lit(float(v)) for v in self.values.ravel()])
        row = F.round(F.ln(F.greatest(distance, F.lit(self.least)) / self.least) / self.step)
        row = F.least(F.greatest(row, F.lit(0.0)), F.lit(float(len(self.values) - 1))).cast("int")
        return F.get(flat, row * self.values.shape[1] + probes)


def search_to_recall(queries: DataFrame, rows: DataFrame, hashes: Sequence[Sequence], table: RecallTable, k: int, target: float,
                     told: list[int] | None = None) -> DataFrame:
    """(q_id, id, dist, rank, probes, reached): for each query the least number of probes at which the mean
    expected recall of its current k nearest reaches ``target``, or all probes of the table; reached says which.

    One probe a level: a query whose k nearest so far reach the target leaves before the next level meets any bin, so a
    level costs what the queries that are left ask for. dist is squared. A query with fewer than k rows found counts the
    missing ones as recall 0; one that finds none gives no rows. ``told`` gets the number of queries of each level.
    """
    most = table.values.shape[1] - 1
    index = checkpointed(digit_tables(rows, hashes))
    asks = checkpointed(probed(queries, hashes, most))
    left, best, done = checkpointed(asks.select("q_id").distinct()), None, []
    for level in range(most + 1):
        if told is not None:
            told.append(left.count())
        some = asks.where(F.col("probe") == level).join(left, "q_id", "left_semi")
        found = nearest_in_bins(some, index, k).select("q_id", "id", "dist")
        if best is not None:
            found = found.unionByName(best.select("q_id", "id", "dist"))
        once = found.groupBy("q_id", "id").agg(F.min("dist").alias("dist"))
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "id")).cast("bigint")
        ranked = once.withColumn("rank", rank).where(F.col("rank") <= k)
        sure = (F.sum(table.lookup(F.sqrt("dist"), F.lit(level))).over(Window.partitionBy("q_id")) / k) >= target
        best = checkpointed(ranked.withColumn("reached", sure))
        done.append(best.where("reached" if level < most else "true").withColumn("probes", F.lit(level)))
        best = best.where(~F.col("reached"))
        left = checkpointed(left.join(done[-1].select("q_id").distinct(), "q_id", "left_anti"))
        if level < most and left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("q_id", "id", "dist", "rank", "probes", "reached")


@dataclass(frozen=True)
class ProbeModel:
    """A-posteriori probing: how often a true neighbour's digit lies ``move`` steps from the query's,
    by the part of the bin in which the query falls; learned from pairs of queries and neighbours."""
    shares: np.ndarray  # parts x (2 * reach + 1)

    @staticmethod
    def train(offsets: np.ndarray, moves: np.ndarray, parts: int = 8, reach: int = 2) -> ProbeModel:
        part = np.minimum((offsets * parts).astype(int), parts - 1).ravel()
        move = moves.ravel()
        inside = np.abs(move) <= reach
        n = np.zeros((parts, 2 * reach + 1)) + 1e-3
        np.add.at(n, (part[inside], move[inside] + reach), 1)
        return ProbeModel(n / n.sum(axis=1, keepdims=True))

    def moves(self, offsets: Sequence[float], most: int, recall: float) -> list[tuple[tuple[int, ...], float]]:
        """The likeliest joint moves of all digits, until they cover ``recall`` or ``most`` are taken."""
        parts, width = self.shares.shape
        each = [self.shares[min(int(o * parts), parts - 1)] for o in offsets]
        order = [np.argsort(-p, kind="stable").tolist() for p in each]
        ranked = [[float(p[k]) for k in o] for p, o in zip(each, order)]
        start = tuple([0] * len(each))
        seen, heap, out, sure = {start}, [(-math.prod(r[0] for r in ranked), start)], [], 0.0
        while heap and len(out) < most and sure < recall:
            minus, s = heapq.heappop(heap)
            sure -= minus
            out.append((tuple(o[i] - width // 2 for o, i in zip(order, s)), -minus))
            for j, i in enumerate(s):
                t = (*s[:j], i + 1, *s[j + 1:])
                if i + 1 < width and t not in seen:
                    seen.add(t)
                    heapq.heappush(heap, (-math.prod(r[k] for r, k in zip(ranked, t)), t))
        return out


def per_table_recall(recall: float, tables: int) -> float:
    """What each of ``tables`` tables must reach for all of them together to reach ``recall``."""
    return 1 - (1 - recall) ** (1 / tables)


def _places(x: np.ndarray, hashes: Sequence[StableDistribution]) -> tuple[np.ndarray, np.ndarray]:
    """Digits of rows of x in one table, and the part of its bin in which each lies."""
    at = np.column_stack([(x @ np.array(h.a, float) + h.b) / h.w for h in hashes])
    own = np.floor(at)
    return own.astype(np.int64), at - own


def train_probes(rows: DataFrame, hashes: Sequence[Sequence[StableDistribution]], k: int, sample: int = 500, parts: int = 8, reach: int = 2) -> ProbeModel:
    """A model of the moves between a query and its k nearest, from ``sample`` rows at most, by the hash of their ids.

    These are searched exhaustively among all rows; the driver gets sample * k pairs.
    """
    some = checkpointed(rows.orderBy(F.xxhash64("id"), "id").limit(sample))
    near = exhaustive(some, rows, k).select("q_id", "id")
    pairs = near.join(some.select(F.col("id").alias("q_id"), F.col("vec").alias("q")), "q_id").join(rows.select("id", F.col("vec").alias("v")), "id").select("q", "v").collect()
    q, v = (np.array([r[c] for r in pairs], float) for c in ("q", "v"))
    offsets, moves = [], []
    for t in hashes:
        (own, at), (other, _) = _places(q, t), _places(v, t)
        offsets.append(at)
        moves.append(other - own)
    return ProbeModel.train(np.concatenate(offsets), np.concatenate(moves), parts, reach)


def digit_bounds(rows: DataFrame, hashes: Sequence[Sequence[StableDistribution]]) -> np.ndarray:
    """Least and greatest digit of every hash over all rows, (tables, digits, 2): bins beyond hold nothing."""
    flat = [h for t in hashes for h in t]
    row = rows.agg(*[f(h.hash(F.col("vec"))) for h in flat for f in (F.min, F.max)]).first()
    return np.array([x if x is not None else 0 for x in row], np.int64).reshape(len(hashes), len(hashes[0]), 2)


def apost_nearest(queries: DataFrame, rows: DataFrame, hashes: Sequence[Sequence[StableDistribution]], model: ProbeModel, k: int,
                  recall: float, most: int = 200) -> DataFrame:
    """(q_id, id, dist, probe, rank, reached): in each table the likeliest moves of the trained model are probed until
    they cover per_table_recall(recall, tables), or ``most`` are taken; reached says whether all tables got there.

    Moves to bins that no row has, by the least and greatest digits, are left out.
    """
    bounds, target = digit_bounds(rows, hashes), per_table_recall(recall, len(hashes))

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for tab, t in enumerate(hashes):
                own, offsets = _places(x, t)
                for lo in range(0, len(x), 128):  # the probes of so many queries in a table are held at a time
                    at, bins, ranks, sure = [], [], [], []
                    for n in range(lo, min(lo + 128, len(x))):
                        found = model.moves(offsets[n].tolist(), most, target)
                        to = own[n] + np.array([m for m, _ in found])
                        on = np.flatnonzero(((to >= bounds[tab, :, 0]) & (to <= bounds[tab, :, 1])).all(axis=1))
                        at.append(np.full(len(on), n))
                        bins.append(to[on])
                        ranks.append(on)
                        sure.append(np.full(len(on), sum(p for _, p in found) >= target))
                    at, flat = pa.array(np.concatenate(at)), np.concatenate(bins)
                    ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(t))
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(flat), tab), pa.int32()),
                        pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), pa.int64())), pa.array(np.concatenate(ranks), pa.int32()),
                        pa.array(np.concatenate(sure), pa.bool_())], names=["q_id", "q_vec", "tab", "bin", "probe", "sure"])

    asks = queries.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(
        probe, "q_id bigint, q_vec array<double>, tab int, bin array<bigint>, probe int, sure boolean")
    sure = asks.groupBy("q_id").agg(F.min("sure").alias("reached"))
    return best_found(nearest_in_bins(asks.drop("sure"), digit_tables(rows, hashes), k), k).join(sure, "q_id")


def tune(ranges: Sequence[tuple[int, int]], good: Callable[..., bool], cost: Callable[..., float]) -> tuple[int, ...] | None:
    """The cheapest parameters for which ``good`` holds. good is monotone in every parameter, so each is bisected
    within the choices of those before it: no value can do where the greatest ones of all later ranges don't.
    """
    best = None
    tops = [high for _, high in ranges]

    def walk(chosen: tuple[int, ...]) -> None:
        nonlocal best
        n = len(chosen)
        low, high = ranges[n]
        if not good(*chosen, *tops[n:]):
            return
        a, b = low, high
        while a < b:  # the least value that can do at all
            mid = (a + b) // 2
            a, b = (a, mid) if good(*chosen, mid, *tops[n + 1:]) else (mid + 1, b)
        if n == len(ranges) - 1:
            if best is None or cost(*chosen, a) < cost(*best):
                best = (*chosen, a)
            return
        for v in range(a, high + 1):
            walk((*chosen, v))

    walk(())
    return best
