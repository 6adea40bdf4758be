"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import usable_vector

#: Rows of a tile: candidates of a shard, queries of a block.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: Per-query lists that one merge takes together.
FAN_IN = 16
EXACT = 2.0**53


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best_of_tile(queries: np.ndarray, q_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray,
                 copies: np.ndarray, k: int):
    """(query_id, id, score) of each query's k best of the tile; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    shard, ids, copies = shard[order], ids[order], copies[order]
    exact = shard.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) < EXACT
    kind = np.float64 if exact else np.int64  # beyond 2^53 doubles would round
    shard = shard.astype(kind)
    for lo in range(0, len(queries), 256):
        scores = (queries[lo:lo + 256].astype(kind) @ shard.T).astype(np.int64)
        for q, row in zip(q_ids[lo:lo + 256], scores):
            others = ids != q
            at = np.flatnonzero(others)
            if len(at) > k:
                least = np.partition(row[at], len(at) - k)[len(at) - k]
                at = at[row[at] >= least]
            at = at[np.lexsort((ids[at], -row[at]))][:k]
            at = np.repeat(at, np.minimum(copies[at], k))[:k]
            yield np.full(len(at), q), ids[at], row[at]


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, scale: int = 256,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner product.

    Components become floor(scale * x), x as double. Queries are the rows whose id is divisible
    by ``query_step``; candidates are all rows of another id and the same dimension. Score ties go
    to the smaller id. Vectors that are null, empty or hold null or non-finite components take no
    part, nor do null ids; equal rows are counted before the search and each fills a rank. A query id
    is answered once: given with several vectors, it asks with the least of them (arrays compared in
    order), and all stay candidates of other queries. No queries or candidates: no rows. Other columns
    are ignored, whatever their names.

    Queries in blocks meet candidates in shards: rows are dealt to shards and blocks by hash,
    and each (shard, block) cell is one matrix product with its own selection, so a cell's
    memory is fixed. Per-query lists are merged in a tree, FAN_IN lists at a time.
    """
    x = F.transform(F.col(vec_col), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = vectors.where(usable_vector(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), x.alias("x"))
    rows = rows.groupBy("id", "x").agg(F.count("*").alias("copies")).withColumn("dim", F.size("x"))
    asks = rows.where(F.col("id") % query_step == 0).groupBy("id").agg(F.min("x").alias("x")).select(
        "id", "x", F.lit(1).cast("long").alias("copies"), F.size("x").alias("dim"))
    n, n_asks = vectors.count(), vectors.where(F.col(id_col) % query_step == 0).count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_asks // BLOCK_ROWS))
    deal = lambda parts: F.pmod(F.xxhash64("id", "x"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = rows.withColumn("shard", deal(shards)).withColumn("block", every(blocks))
    left = asks.withColumn("block", deal(blocks)).withColumn("shard", every(shards))
    cell = ["dim", "shard", "block"]

    def product(cell: pa.Table) -> pa.Table:
        ask = cell.column("ask").to_numpy()
        x, ids, copies = _matrix(cell.column("x")), cell.column("id").to_numpy(), cell.column("copies").to_numpy()
        best = list(best_of_tile(x[ask], ids[ask], x[~ask], ids[~ask], copies[~ask], k))
        cols = [np.concatenate(c) for c in zip(*best)] if best else [np.zeros(0, np.int64)] * 3
        part = np.full(len(cols[0]), cell.column("shard")[0].as_py())
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "part": pa.array(part, pa.int32()),
                         "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    both = left.withColumn("ask", F.lit(True)).unionByName(right.withColumn("ask", F.lit(False)))
    tops = both.groupBy(*cell).applyInArrow(product, "query_id long, part int, vec_id long, score long")
    return merged(tops, shards, k)


def merged(tops: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of a query's lists ``tops(query_id, part, vec_id, score)``.

    Lists of parts 0 to ``parts`` - 1 are merged in a tree, FAN_IN at a time; higher scores go first, ties to the smaller id.
    """
    item = F.struct((-F.col("score")).alias("minus"), F.col("vec_id"))
    while True:
        parts = -(-parts // FAN_IN)
        tops = tops.groupBy("query_id", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(
            F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("best"))
        tops = tops.select("query_id", "part", F.posexplode("best").alias("at", "b"))
        if parts <= 1:
            return tops.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id",
                               (-F.col("b.minus")).alias("score"))
        tops = tops.select("query_id", "part", "b.vec_id", (-F.col("b.minus")).alias("score"))
