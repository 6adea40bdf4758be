"""Exact Hamming joins of sketches by block partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.bits import BLOCKS, flips, hamming, popcount


def block_rows(sketches: DataFrame, blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """One row per block of a sketch, with ``block`` and ``block_key``: the inverted lists."""
    return sketches.select("*", F.posexplode(F.array(*blocks)).alias("block", "block_key"))


def hamming_join(query: DataFrame, db: DataFrame, threshold: int, bits: int = 16,
                 blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """All (query sketch, db sketch) pairs within ``threshold`` differing bits, each once.

    Two sketches within T bits have a block of k that differs in T // k bits or fewer, so query
    blocks are probed with that many flips and meet db blocks in an equi-join on
    (block, key); the distance is refined in the join condition. A pair is kept only at its
    first agreeing block, so no distinct over the candidates is needed. Columns of the query
    side get the prefix ``q_``; ``distance`` is added. No pair is lost, whatever the skew of keys;
    the sort-merge join lets adaptive execution split hot ones.
    """
    near = threshold // len(blocks)
    q = query.select([F.col(c).alias(f"q_{c}") for c in query.columns])
    probes = q.select("*", F.posexplode(F.array(*[f"q_{b}" for b in blocks])).alias("block", "q_key"))
    probes = probes.withColumn("block_key", F.explode(flips(F.col("q_key"), bits, near)) if near else F.col("q_key")).drop("q_key")
    d = block_rows(db, blocks)
    mine, theirs = [F.col(f"q_{b}") for b in blocks], [F.col(b) for b in blocks]
    first = F.lit(True)
    for k in range(len(blocks) - 1):
        earlier = popcount(mine[k].bitwiseXOR(theirs[k])) <= near
        first = first & ~((F.col("block") > k) & earlier)
    distance = hamming(mine, theirs)
    return probes.join(d, ["block", "block_key"]).where((distance <= threshold) & first).withColumn(
        "distance", distance).drop("block", "block_key")
