"""Approximate nearest neighbours by inner product over an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, usable_vector
from .topk import _matrix, merged

#: Parameters of fit(): rows of the sample, at most; queries of it that set the share of rows to visit; the recall they
#: must reach; centroids of a half, at most.
FIT_ROWS, FIT_QUERIES, RECALL, CENTROIDS = 20_000, 256, 0.96, 64
#: Entries of a tile and queries of a block that meet in one task.
TILE_ROWS, BLOCK_ROWS = 8192, 8192
#: Room for the rounding of a matrix product against the sum in order of the dimensions, as a share of both norms.
SLACK = 1e-12


def centroids(points: np.ndarray, n: int, rounds: int = 15) -> np.ndarray:
    """At most ``n`` means by Lloyd's rounds from points spread over the sample; the same for the same points."""
    different = np.unique(points, axis=0)
    means = different[np.random.default_rng(0).permutation(len(different))[:n]]
    for _ in range(rounds):
        own = closest(points, means)
        sizes = np.bincount(own, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, own, points)
        means = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], means)
    return means


def closest(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nearest mean of each point, the first of equals."""
    out = np.zeros(len(points), np.int64)
    for lo in range(0, len(points), 4096):
        out[lo:lo + 4096] = np.nan_to_num((means * means).sum(1) - 2 * points[lo:lo + 4096] @ means.T, nan=np.inf).argmin(1)
    return out


class MultiIndex:
    """Codebooks of the two halves of a vector; a cell is a centroid of each. ``share``: of the rows, what a query visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, share: float = 1.0):
        self.first, self.second, self.share = first, second, share

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.first), len(self.second)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return closest(vectors[:, :half], self.first), closest(vectors[:, half:], self.second)

    def visited(self, query: np.ndarray, counts: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(order, reach): the query's cells, nearest first, until they hold ``most`` entries or all.

        A cell's nearness is the sum of the halves' inner products with its centroids. Pairs come off a heap, and a pair
        goes on it once the pairs before it in both orders are off, so what is visited of a first centroid i is the
        beginning of ``order``, reach[i] second centroids long.
        """
        half = self.first.shape[1]
        u, v = self.first @ query[:half], self.second @ query[half:]
        rows, order = np.argsort(-u, kind="stable").tolist(), np.argsort(-v, kind="stable")
        at, counts = order.tolist(), counts[:, order].tolist()
        u, v = u.tolist(), v.tolist()
        taken, seen = [0] * len(rows), 0
        heap = [(-(u[rows[0]] + v[at[0]]), 0, 0)]
        while heap and seen < most:
            _, r, c = heapq.heappop(heap)
            taken[r] = c + 1
            seen += counts[rows[r]][c]
            if c + 1 < len(at) and (r == 0 or taken[r - 1] > c + 1):
                heapq.heappush(heap, (-(u[rows[r]] + v[at[c + 1]]), r, c + 1))
            if r + 1 < len(rows) and taken[r + 1] == c:
                heapq.heappush(heap, (-(u[rows[r + 1]] + v[at[c]]), r + 1, c))
        reach = np.zeros(len(rows), np.int64)
        reach[rows] = taken
        return order, reach


def fit(sample: np.ndarray, k: int, recall: float = RECALL, most: int = CENTROIDS, queries: int = FIT_QUERIES) -> MultiIndex:
    """The index of a sample, and the least share of its rows that finds ``recall`` of its queries' k nearest.

    In all rows a query's k nearest are nearer than in a sample, and so earlier among the cells: the share serves both.
    """
    half = sample.shape[1] // 2
    n = int(min(most, max(4, 2 ** round(np.log2(max(len(sample), 1) ** 0.5 / 2 + 1)))))
    index = MultiIndex(centroids(sample[:, :half], n), centroids(sample[:, half:], n))
    i, j = index.cells(sample)
    counts = np.zeros(index.shape, np.int64)
    np.add.at(counts, (i, j), 1)
    needed = []
    for at in np.random.default_rng(1).permutation(len(sample))[:queries]:
        q = sample[at]
        scores = sample @ q
        scores[at] = -np.inf
        best = np.argsort(-scores, kind="stable")[:min(k, len(sample) - 1)]
        near = (index.first @ q[:half])[:, None] + (index.second @ q[half:])[None, :]
        cells = np.argsort(-near, axis=None, kind="stable")
        through = np.empty(cells.size, np.int64)
        through[cells] = np.cumsum(counts.ravel()[cells])
        needed.append(through[i[best] * index.shape[1] + j[best]])
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    index.share = float(needed[min(len(needed) - 1, int(recall * len(needed)))] / len(sample)) if len(needed) else 1.0
    return index


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the dimensions: the same wherever a pair is met."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def best_of_tile(queries: np.ndarray, q_ids: np.ndarray, may: np.ndarray, rows: np.ndarray, ids: np.ndarray, copies: np.ndarray,
                 cell: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, id, score) of each query's k best entries of the cells that it may visit; ties go to the smaller id."""
    order = np.lexsort((ids, cell))
    rows, ids, copies, cell = rows[order], ids[order], copies[order], cell[order]
    here, starts = np.unique(cell, return_index=True)
    ends = np.append(starts[1:], len(cell))
    norm = np.sqrt((rows * rows).sum(1)).max(initial=0)
    for lo in range(0, len(queries), 128):
        q, own = queries[lo:lo + 128], q_ids[lo:lo + 128]
        scores = np.full((len(q), len(rows)), -np.inf)
        seen = np.zeros(scores.shape, bool)
        for c, a, b in zip(here, starts, ends):
            who = np.flatnonzero(may[lo:lo + 128, c])
            if len(who):
                scores[who, a:b] = np.nan_to_num(q[who] @ rows[a:b].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                seen[who, a:b] = True
        seen &= ids[None, :] != own[:, None]
        pick = []
        for x, (row, ok) in enumerate(zip(scores, seen)):
            at = np.flatnonzero(ok)
            if len(at) > k:
                least = np.partition(row[at], len(at) - k)[len(at) - k]
                at = at[row[at] >= least - SLACK * norm * np.sqrt(q[x] @ q[x])]
            pick.append(at)
        which, at = np.repeat(np.arange(len(q)), [len(p) for p in pick]), np.concatenate(pick)
        exact = np.nan_to_num(in_order(q[which], rows[at]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        order = np.lexsort((ids[at], -exact, which))
        which, at, exact = which[order], at[order], exact[order]
        times = np.minimum(copies[at], k)
        which, at, exact = (np.repeat(z, times) for z in (which, at, exact))
        first = np.searchsorted(which, which)
        keep = np.arange(len(which)) - first < k
        yield own[which[keep]], ids[at[keep]], exact[keep]


def _tiles(sizes: np.ndarray, tile_rows: int) -> tuple[list[int], list[int], int]:
    """First tile and number of tiles of each first centroid, and the tiles in all; small ones share a tile."""
    start, pieces, tile, filled = [], [], 0, 0
    for n in sizes.tolist():
        if filled and filled + n > tile_rows:
            tile, filled = tile + 1, 0
        start.append(tile)
        pieces.append(max(1, -(-n // tile_rows)))
        if pieces[-1] > 1:
            tile, filled = tile + pieces[-1], 0
        else:
            filled += n
    return start, pieces, tile + 1


def _search(rows: DataFrame, asks: DataFrame, k: int, recall: float, fit_rows: int) -> DataFrame:
    """nearest() for rows(id, v, copies) and asks(id, v) of one dimension."""
    n = rows.count()
    some = rows if n <= fit_rows else rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(0.9 * fit_rows / n * (1 << 30)))
    index = fit(np.array([r["v"] for r in some.select("v").orderBy("v").limit(fit_rows).toLocalIterator()], np.float64), k, recall)
    wide = index.shape[1]

    def codes(batches):
        for b in batches:
            i, j = index.cells(_matrix(pa.chunked_array([b.column(1)])).astype(np.float64)) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["id", "v", "copies", "i", "j"])

    kind = rows.schema["v"].dataType.simpleString()
    coded = checkpointed(rows.select("id", "v", "copies").mapInArrow(codes, f"id long, v {kind}, copies long, i int, j int"))
    counts = np.zeros(index.shape, np.int64)
    for r in coded.groupBy("i", "j").count().collect():  # a row a cell: CENTROIDS^2 at most
        counts[r["i"], r["j"]] = r["count"]
    start, pieces, tiles = _tiles(counts.sum(1), TILE_ROWS)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("i") + 1)
    blocks = max(1, -(-asks.count() // BLOCK_ROWS))
    spans = [(a, a + p) for a, p in zip(start, pieces)]
    share = index.share

    def visits(batches):
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 64):
                at, tiles_of, orders, reaches = [], [], [], []
                for x in range(lo, min(lo + 64, b.num_rows)):
                    order, reach = index.visited(np.array(vectors[x].as_py(), np.float64), counts, share * n)
                    to = sorted({t for i in np.flatnonzero(reach) for t in range(*spans[i])})
                    at += [x] * len(to)
                    tiles_of += to
                    orders += [order] * len(to)
                    reaches += [reach] * len(to)
                yield pa.RecordBatch.from_arrays([
                    ids.take(at), vectors.take(at), pa.array(tiles_of, pa.int32()), pa.array(orders, pa.list_(pa.int32())),
                    pa.array(reaches, pa.list_(pa.int32()))], names=["id", "v", "tile", "order", "reach"])

    sent = asks.select("id", "v").mapInArrow(visits, f"id long, v {kind}, tile int, order array<int>, reach array<int>")
    left = sent.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("ask", F.lit(True))
    right = coded.withColumn("tile", (of(start) + F.pmod(F.xxhash64("id", "v"), of(pieces))).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", F.col("i") * wide + F.col("j")).drop("i", "j")
    both = left.unionByName(right.withColumn("ask", F.lit(False)), allowMissingColumns=True)

    def meet(t: pa.Table) -> pa.Table:
        ask = t.column("ask").to_numpy()
        x, ids = _matrix(t.column("v")).astype(np.float64), t.column("id").to_numpy()
        asked, entries = t.filter(pa.array(ask)), t.filter(pa.array(~ask))
        best = []
        if len(asked) and len(entries):
            order, reach = _matrix(asked.column("order")), _matrix(asked.column("reach"))
            may = np.zeros((len(asked), *index.shape), bool)
            place = np.empty_like(order)  # of each second centroid in the query's order
            np.put_along_axis(place, order, np.broadcast_to(np.arange(wide, dtype=order.dtype), order.shape), 1)
            np.less(place[:, None, :], reach[:, :, None], out=may)
            best = list(best_of_tile(x[ask], ids[ask], may.reshape(len(asked), -1), x[~ask], ids[~ask],
                                     entries.column("copies").to_numpy(), entries.column("cell").to_numpy(), k))
        q, found, score = (np.concatenate(c) for c in zip(*best)) if best else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "part": pa.array(np.full(len(q), t.column("tile")[0].as_py()), pa.int32()),
                         "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    tops = both.groupBy("tile", "block").applyInArrow(meet, "query_id long, part int, vec_id long, score double")
    return merged(tops, tiles, k)


def nearest(vectors: DataFrame, k: int = 20, query_step: int = 20, recall: float = RECALL, fit_rows: int = FIT_ROWS,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k entries of largest inner product found for each query, nearest first.

    Queries are the rows whose id is divisible by ``query_step``; candidates are all rows of another id and the same
    dimension. Score ties go to the smaller id. Both halves of the vectors are quantised apart, by centroids of a sample of
    ``fit_rows`` rows at most; every row lies in the cell of its two centroids. A query takes cells by summed nearness off a
    heap until they hold the share of all rows that found ``recall`` of the neighbours in the sample; their entries are
    ranked by the inner product of the vectors as given, in doubles, summed in the order of the dimensions.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Equal rows
    are counted and each fills a rank. A query id is answered once: given with several vectors, it asks with the least of
    them (arrays compared in order). Of equal vectors only the k + 1 smallest ids are indexed: no other can be among
    anyone's k nearest with ties to the smaller id. Products beyond the doubles are infinite; undefined sums rank last.
    Vectors of different dimensions are tables of their own, one after the other. No rows: no result. Other
    columns are ignored, whatever their names.

    Cells of one first centroid make a tile, small ones share one, those above TILE_ROWS are dealt to several by hash; a
    query goes once to each tile where it visits a cell, in blocks of BLOCK_ROWS. A task holds one tile and one block.
    """
    floats = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.where(usable_vector(F.col(vec_col)) & ~F.forall(vec_col, lambda x: x == 0) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v") if floats else F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    least = Window.partitionBy("v").orderBy("id")
    counted = rows.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("at", F.row_number().over(least)).where(F.col("at") <= k + 1)
    entries = checkpointed(counted.select("id", "v", "copies", F.size("v").alias("dim")))
    dims = [r["dim"] for r in entries.select("dim").distinct().orderBy("dim").collect()]
    asks = checkpointed(rows.where(F.col("id") % query_step == 0).groupBy("id").agg(F.min("v").alias("v")))
    found = [_search(entries.where(F.col("dim") == d), asks.where(F.size("v") == d), k, recall, fit_rows) for d in dims]
    if not found:
        return entries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
