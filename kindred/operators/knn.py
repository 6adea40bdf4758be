"""k-nearest neighbours: exhaustive, by LSH tables, by LSH forests, by multi-probing; recall."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.lsh import Lsh

from .ordering import checkpointed

#: Query rows of a block: a block of queries meets every row, so it is the part sent around.
BLOCK_ROWS = 4096


def pairs_by_block(queries: DataFrame, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q_id, q_vec, id, vec) of every query with every other row, through blocks of queries.

    Queries are dealt into blocks by hash and rows are sent to every block and part, so a
    task holds one cell of the table of pairs and no side is ever broadcast.
    """
    n = max(1, -(-queries.count() // block_rows))
    parts = max(1, -(-rows.count() // block_rows))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = queries.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), part("id", n).alias("block"), every(parts).alias("part"))
    r = rows.select("id", "vec", part("id", parts).alias("part"), every(n).alias("block"))
    return q.join(r, ["block", "part"]).where("q_id <> id").drop("block", "part")


def nearest(candidates: DataFrame, k: int | None, metric: Callable[[Column, Column], Column], within: float | None = None,
            decimals: int | None = None) -> DataFrame:
    """(q_id, id, dist, rank) of the k nearest, those nearer than ``within``, or both; ties by id."""
    dist = metric(F.col("q_vec"), F.col("vec"))
    scored = candidates.select("q_id", "id", (F.round(dist, decimals) if decimals else dist).alias("dist"))
    if within is not None:
        scored = scored.where(F.col("dist") < within)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "id")).cast("bigint")
    ranked = scored.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


#: Bytes of a block's vectors, at most, where tables are large: copies of a row grow with the number of blocks, which this keeps low.
BLOCK_BYTES = 32 << 20
#: Distances that a task holds at once, and columns whose k-th distance bounds the others.
HELD, BOUND = 1 << 20, 4096


def _blocks(n: int, dim: int, cores: int, block_rows: int) -> int:
    """Blocks of n rows: no more than the cells need to keep all cores busy, unless a block would hold too many bytes."""
    few = -(-n // max(block_rows, BLOCK_BYTES // (8 * max(1, dim))))
    return max(1, few, min(-(-n // block_rows), math.ceil(math.sqrt(3 * cores))))


def _exact(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their squared norms: in single precision where all sums are whole and below 2^24, so exact in it too."""
    norm = np.einsum("ij,ij->i", x, x)
    if len(x) and norm.max() < 2**22 and (x == np.rint(x)).all():
        return x.astype(np.float32), norm.astype(np.float32)
    return x, norm


def _near(a: tuple, b: tuple, k: int | None, within: float | None = None):
    """(rows of a, rows of b, dist) in pieces: of each of a its k nearest of b, those nearer than ``within``, or both.

    Both are (ids, vectors, norms), b by id; rows of one id are no pair. Ties by id. What lies beyond the k-th distance among the first
    columns is left out before anything is sorted.
    """
    (a_ids, x, a_norm), (b_ids, y, b_norm) = a, b
    step = max(1, min(256, HELD // max(1, len(y))))
    for lo in range(0, len(x), step) if len(y) else ():
        ids, some = a_ids[lo:lo + step], x[lo:lo + step]
        dist = a_norm[lo:lo + step, None] + b_norm
        dist -= (2 * some) @ y.T
        first, end = np.searchsorted(b_ids, ids), np.searchsorted(b_ids, ids, "right")
        for extra in range(int((end - first).max())):
            at = np.flatnonzero(end - first > extra)
            dist[at, first[at] + extra] = np.inf
        keep = dist < within if within is not None else dist < np.inf
        if k is not None and len(y) > k:
            keep &= dist <= np.partition(dist[:, :max(BOUND, 4 * k)], k - 1, axis=1)[:, k - 1:k]
        row, col = np.divmod(np.flatnonzero(keep), len(y))
        found = np.maximum(dist[row, col], 0).astype(np.float64)
        if k is not None and len(row):
            order = np.lexsort((col, found, row))
            row, col, found = row[order], col[order], found[order]
            at = np.arange(len(row))
            on = at - at[np.searchsorted(row, row)] < k
            row, col, found = row[on], col[on], found[on]
        yield row + lo, col, found


def exhaustive(queries: DataFrame, rows: DataFrame, k: int | None = None, within: float | None = None,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """nearest() under squared L2 over all pairs: (q_id, id, dist, rank), dist as double.

    The cells are those of pairs_by_block, but a cell is one matrix product in an Arrow batch and
    returns its own k best (or those within) per query only. Whole-numbered vectors are exact. Blocks grow with the tables to
    BLOCK_BYTES. Without k a query's finds travel as one list a cell, and are ranked as they are merged.
    """
    spark = queries.sparkSession
    asked, (held, dim) = queries.count(), rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    n, parts = (_blocks(c, dim, spark.sparkContext.defaultParallelism, block_rows) for c in (asked, held))
    part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    vec = F.col("vec").cast("array<double>").alias("vec")
    q = queries.select("id", vec, part(n).alias("block"), every(parts).alias("part"), F.lit(True).alias("ask"))
    r = rows.select("id", vec, every(n).alias("block"), part(parts).alias("part"), F.lit(False).alias("ask"))

    def cell(t: pa.Table) -> pa.Table:
        ask, ids = t.column("ask").to_numpy(), t.column("id").to_numpy()
        x, norm = _exact(pa.concat_arrays(t.column("vec").chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        a, b = np.flatnonzero(ask), np.flatnonzero(~ask)
        b = b[np.argsort(ids[b], kind="stable")]
        out = [(ids[a][i], ids[b][j], d) for i, j, d in _near((ids[a], x[a], norm[a]), (ids[b], x[b], norm[b]), k, within)]
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if k is None:
            first = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])) if len(cols[0]) else np.zeros(0, np.int64)
            ends = pa.array(np.append(first, len(cols[0])), pa.int32())
            return pa.table({"q_id": pa.array(cols[0][first]), "id": pa.ListArray.from_arrays(ends, pa.array(cols[1])), "dist": pa.ListArray.from_arrays(ends, pa.array(cols[2]))})
        return pa.table(dict(zip(("q_id", "id", "dist"), map(pa.array, cols))))

    cells = q.unionByName(r).groupBy("block", "part")
    if k is None:
        lists = cells.applyInArrow(cell, "q_id bigint, id array<bigint>, dist array<double>")
        return lists.repartition("q_id").sortWithinPartitions("q_id").mapInArrow(_merged, "q_id bigint, id bigint, dist double, rank bigint")
    best = cells.applyInArrow(cell, "q_id bigint, id bigint, dist double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "id")).cast("bigint")
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _merged(batches):
    """Rows (q_id, id, dist, rank) from lists of finds that come by q_id."""
    def ranked(q, ids, dist):
        order = np.lexsort((ids, dist))
        for lo in range(0, len(order), 1 << 20):
            at = order[lo:lo + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(ids[at]), pa.array(dist[at]), pa.array(np.arange(lo, lo + len(at)) + 1)], names=["q_id", "id", "dist", "rank"])

    last, held, out, n = None, [], [], 0

    def closed():
        return ranked(last, np.concatenate([i for i, _ in held]), np.concatenate([d for _, d in held]))

    for b in batches:
        for at, q in enumerate(b.column(0).to_pylist()):
            if held and q != last:
                out += closed()
                n += out[-1].num_rows
                held = []
                if n >= 1 << 16:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, n = [], 0
            last = q
            held.append((b.column(1)[at].values.to_numpy(), b.column(2)[at].values.to_numpy()))
    if held:
        out += closed()
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def tables(rows: DataFrame, hashes: Sequence[Lsh]) -> DataFrame:
    """The LSH index: (tab, bin, id, vec), one row per table; append to insert."""
    return rows.select("id", "vec", F.posexplode(F.array(*[h.hash(F.col("vec")) for h in hashes])).alias("tab", "bin"))


def save_index(index: DataFrame, path: str) -> None:
    """Non-empty bins only, a folder per table, so that a search of some tables reads no others."""
    index.repartition("tab", "bin").sortWithinPartitions("bin").write.partitionBy("tab").mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("tab", "bin", "id", "vec")


def _groups(batches):
    """Tables of whole groups of equal (key, i, j) from sorted batches, with the first row of each."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c) for c in ("key", "i", "j")]
        codes = [columns[0].dictionary_encode().indices.to_numpy(), columns[1].to_numpy(), columns[2].to_numpy()]
        first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))
        if held and last == [c[0].as_py() for c in columns]:
            first = first[1:]
        last = [c[-1].as_py() for c in columns]
        if not len(first):
            held.append(b)
            continue
        before, cut = sum(h.num_rows for h in held), first[-1]
        if before + cut:
            starts = first[:-1] + before
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks(), np.concatenate([[0], starts]) if before else starts
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64)


def nearest_in_bins(asks: DataFrame, index: DataFrame, k: int, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(q_id, id, dist, probe): of every bin that a query asks for its k nearest rows by squared L2, ties by id.

    ``asks(q_id, q_vec, tab, bin, probe)`` meets ``index(tab, bin, id, vec)``; the k nearest of the union of bins are
    among these. A bin is one matrix product in an Arrow batch, so pairs are never rows. Large bins are dealt in pieces,
    each piece of queries to each piece of rows: of ``block_rows``, or where there is more than enough for all cores, of up to
    ``block_bytes`` of vectors, so that few copies of a row travel. Null vectors take no part.
    """
    cores = asks.sparkSession.sparkContext.defaultParallelism
    key = F.concat_ws(":", F.col("tab").cast("string"), F.col("bin").cast("string")).alias("key")
    q = asks.where("q_vec IS NOT NULL").select(key, F.col("q_id").alias("id"), F.col("q_vec").cast("array<double>").alias("vec"), "probe", F.lit(True).alias("ask"))
    r = index.where("vec IS NOT NULL").select(key, "id", F.col("vec").cast("array<double>").alias("vec"), F.lit(0).alias("probe"), F.lit(False).alias("ask"))

    def pieces(df, name):
        counted = df.groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))
        whole = counted.agg(F.sum("n").alias("total"), F.max("dim").alias("dim"))  # one row
        most = F.greatest(F.lit(block_rows), F.least(F.ceil(F.col("total") / (4 * cores)), F.ceil(F.lit(block_bytes) / (8 * F.greatest(F.col("dim"), F.lit(1))))))
        return counted.drop("dim").join(F.broadcast(whole.select(most.alias("most"))), F.lit(True)).where("n > most").select("key", F.ceil(F.col("n") / F.col("most")).cast("int").alias(name))

    hot = F.broadcast(pieces(q, "of_q").join(pieces(r, "of_r"), "key", "full"))  # a row of it stands for more than block_rows rows
    of_q, of_r = F.coalesce("of_q", F.lit(1)), F.coalesce("of_r", F.lit(1))
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    own = lambda m: F.pmod(F.xxhash64("id"), m).cast("int")
    both = q.join(hot, "key", "left").withColumn("i", own(of_q)).withColumn("j", every(of_r)).unionByName(
        r.join(hot, "key", "left").withColumn("j", own(of_r)).withColumn("i", every(of_q))).drop("of_q", "of_r")

    def run(batches):
        for t, first in _groups(batches):
            ids, ask, probe = (t.column(c).to_numpy() for c in ("id", "ask", "probe"))
            x, norm = _exact(t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            out = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(ids)]):
                mid = lo + int((~ask[lo:hi]).sum())  # rows come before queries, each by id
                for row, col, dist in _near((ids[mid:hi], x[mid:hi], norm[mid:hi]), (ids[lo:mid], x[lo:mid], norm[lo:mid]), k):
                    out.append((ids[mid:hi][row], ids[lo:mid][col], dist, probe[mid:hi][row]))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), pa.array(cols[3], pa.int32())], names=["q_id", "id", "dist", "probe"])

    dealt = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "ask", "id")
    return dealt.mapInArrow(run, "q_id bigint, id bigint, dist double, probe int")


def best_found(found: DataFrame, k: int) -> DataFrame:
    """(q_id, id, dist, probe, rank): the k nearest of what several bins gave, each row once, at its first probe."""
    once = found.repartition("q_id").groupBy("q_id", "id").agg(F.min("dist").alias("dist"), F.min("probe").alias("probe"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "id")).cast("bigint")
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def lsh_nearest(queries: DataFrame, index: DataFrame, hashes: Sequence[Lsh], k: int) -> DataFrame:
    """(q_id, id, dist, rank): the k nearest among rows that share a bin with the query in some table of the index."""
    asks = tables(queries, hashes).select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), "tab", "bin", F.lit(0).alias("probe"))
    return best_found(nearest_in_bins(asks, index, k), k).drop("probe")


def forest_nearest(queries: DataFrame, rows: DataFrame, trees: Sequence[Sequence[Lsh]], most: int, k: int) -> DataFrame:
    """(q_id, id, dist, rank): the k nearest below the nodes where a forest search stops.

    Hashes are one bit each; a tree's node at depth d is the prefix of d of them. For each query the least depth whose
    nodes hold fewer than ``most`` rows over all trees is found, and the depth before it taken. Rows go only to nodes
    that some query asks for. Depth 0 is the whole table: such queries are searched exhaustively.
    """
    depth = len(trees[0])
    bits = F.array(*[F.concat(*[h.hash(F.col("vec")).cast("string") for h in hashes]) for hashes in trees])
    nodes = lambda df, *keep: df.select(*keep, F.posexplode(bits).alias("tab", "bits")).select(
        *keep, "tab", "bits", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("depth")).select(
        *keep, "tab", "depth", F.expr("substring(bits, 1, depth)").alias("bin"))
    sizes = nodes(rows, "id").groupBy("tab", "bin").agg(F.count("*").alias("n"))
    q = nodes(queries.select(F.col("id").alias("q_id"), "vec"), "q_id")
    total = q.join(sizes, ["tab", "bin"], "left").groupBy("q_id", "depth").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    if rows.count() * len(trees) < most:
        return exhaustive(queries, rows, k).select("q_id", "id", "dist", "rank")
    stop = checkpointed(total.groupBy("q_id").agg((F.coalesce(F.min(F.when(F.col("n") < most, F.col("depth"))), F.lit(depth + 1)) - 1).alias("depth")))
    asked = checkpointed(q.join(stop, ["q_id", "depth"]).select("q_id", "tab", "bin"))
    index = nodes(rows, "id", "vec").join(asked.select("tab", "bin").distinct(), ["tab", "bin"], "left_semi")
    asks = asked.join(queries.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), "q_id").withColumn("probe", F.lit(0))
    found = nearest_in_bins(asks, index.select("tab", "bin", "id", "vec"), k)
    top = stop.where("depth = 0").select(F.col("q_id").alias("id"))
    if not top.isEmpty():
        whole = exhaustive(queries.join(top, "id", "left_semi"), rows, k)
        found = found.unionByName(whole.select("q_id", "id", "dist", F.lit(0).alias("probe")))
    return best_found(found, k).drop("probe")


def perturbations(delta: Column, digits: int, probes: int) -> Column:
    """Steps of no move and then of the ``probes`` joint moves of least cost, for digits at ``delta`` in their bins.

    A digit moves by one step or not at all, at the squared distance to the bin edge that it crosses; costs
    add up. Digits are joined one by one and only the best so far go on, which loses none of the best.
    """
    best = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("moves"), F.array().cast("array<int>").alias("steps")))
    for i in range(digits):
        d = F.get(delta, F.lit(i))
        to = ((0, F.lit(0.0)), (-1, d * d), (1, (1 - d) * (1 - d)))
        best = F.flatten(F.transform(best, lambda c: F.array(*[F.struct(  # noqa: B023
            (c["cost"] + cost).alias("cost"), (c["moves"] + abs(step)).alias("moves"), F.concat(c["steps"], F.array(F.lit(step))).alias("steps")) for step, cost in to])))  # noqa: B023
        best = F.slice(F.array_sort(best), 1, probes + 1)
    return F.transform(best, lambda c: c["steps"])


@dataclass(frozen=True)
class Modulo:
    """A table's digits times whole factors, summed, modulo the number of its bins: a bin as one small number."""
    factors: tuple[int, ...]
    bins: int

    def __call__(self, digits: Column) -> Column:
        terms = F.zip_with(digits, F.array(*[F.lit(f).cast("bigint") for f in self.factors]), lambda d, f: d * f)
        return F.pmod(F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(self.bins).cast("bigint"))


def probed(queries: DataFrame, hashes: Sequence[Sequence], probes: int, modulo: Modulo | None = None) -> DataFrame:
    """asks of nearest_in_bins(): in each table a query's own bin, as probe 0, and its ``probes`` likeliest others.

    ``hashes`` are tables of one stable-distribution hash per digit. Probes are those of perturbations(), at most
    3^digits - 1. With ``modulo`` they are moves of the digits all the same, and bins what it makes of them.
    """
    vec = F.col("vec")
    place = F.array(*[F.struct(F.array(*[h.hash(vec) for h in t]).alias("own"), F.array(*[h.delta(vec) for h in t]).alias("delta")) for t in hashes])
    q = queries.select(F.col("id").alias("q_id"), vec.alias("q_vec"), F.posexplode(place).alias("tab", "at"))
    q = q.select("q_id", "q_vec", "tab", F.col("at.own").alias("own"), F.posexplode(
        perturbations(F.col("at.delta"), len(hashes[0]), probes)).alias("probe", "steps"))
    to = F.zip_with("own", "steps", lambda h, s: h + s)
    return q.select("q_id", "q_vec", "tab", "probe", (modulo(to) if modulo else to).alias("bin"))


def digit_tables(rows: DataFrame, hashes: Sequence[Sequence], modulo: Modulo | None = None) -> DataFrame:
    """(tab, bin, id, vec) with the digits of a table, or what ``modulo`` makes of them, as its bin."""
    own = F.array(*[F.array(*[h.hash(F.col("vec")) for h in t]) for t in hashes])
    placed = rows.select("id", "vec", F.posexplode(own).alias("tab", "bin"))
    return placed.withColumn("bin", modulo(F.col("bin"))) if modulo else placed


def probe_nearest(queries: DataFrame, rows: DataFrame, hashes: Sequence[Sequence], probes: int, k: int, modulo: Modulo | None = None) -> DataFrame:
    """(q_id, id, dist, probe, rank): multi-probing in every table; probe is the first that finds the row."""
    return best_found(nearest_in_bins(probed(queries, hashes, probes, modulo), digit_tables(rows, hashes, modulo), k), k)


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(q_id, recall): the share of each query's true neighbours that were found."""
    hit = found.select("q_id", "id").distinct().withColumn("hit", F.lit(1))
    return truth.join(hit, ["q_id", "id"], "left").groupBy("q_id").agg(
        (F.count("hit") / F.count("*")).alias("recall"))
