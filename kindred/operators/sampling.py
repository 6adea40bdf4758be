"""Filters and samples of descriptors, attribute projection, expiry."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ENTROPY, FLOOR = 4.4, 5
LISTED = 1000


def sample_by_entropy(df: DataFrame, image: str, entropy: str, tie: str, least: float = MIN_ENTROPY, floor: int = FLOOR) -> DataFrame:
    """Of each image the descriptors above ``least``, but the best ``floor`` at any rate.

    The best are taken apart, so that each task sends only its own best of an image on; those above ``least`` are the first
    of their image, so their rank among themselves is their rank.
    """
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc(entropy), tie)).cast("bigint")
    best = df.withColumn("rank", rank).where(F.col("rank") <= floor)
    return best.unionByName(df.where(F.col(entropy) > least).withColumn("rank", rank).where(F.col("rank") > floor))


def top_by_size(df: DataFrame, image: str, size: Column, tie: str, count: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(image).orderBy(size.desc(), tie))
    return df.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= count)


def random_sample(df: DataFrame, image: str, ident: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` descriptors of each image in a seeded random order (md5 of 'seed:id') that a rerun repeats."""
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string"))), ident))
    return df.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= count)


def first_of(df: DataFrame, count: int, name: str, by: Sequence[str], *order: Column) -> DataFrame:
    """The first ``count`` rows of each group, with their number from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col(name) <= count)


def sample_ids(df: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` distinct keys, or all if there are fewer, first in a seeded order (md5 of 'seed:key') that a rerun repeats."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(mixed, key).limit(count)


def without_listed(df: DataFrame, listed: DataFrame, key: str, vec: str, listed_vec: str, within: float) -> DataFrame:
    """Rows with no listed vector at a squared L2 distance below ``within``, whatever the length of the list.

    The list is broadcast in full while it has LISTED rows or fewer; a longer one is dealt in pieces of that
    many, and every piece meets every part of the rows as one matrix product (knn.exhaustive).
    """
    from .knn import exhaustive
    if listed.count() <= LISTED:
        far = F.aggregate(F.zip_with(vec, listed_vec, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return df.join(F.broadcast(listed.select(F.col(listed_vec))), far < within, "left_anti")  # LISTED rows at most
    named = listed.select((-1 - F.monotonically_increasing_id()).alias("id"), F.col(listed_vec).alias("vec"))
    near = exhaustive(df.select(F.col(key).alias("id"), F.col(vec).alias("vec")), named, 1, within).select(F.col("q_id").alias(key))
    return df.join(near, key, "left_anti")


def project_attributes(df: DataFrame, key: str, flags: Iterable[str]) -> DataFrame:
    """The key and the flagged attributes; the rest is never read."""
    return df.select(key, *flags)


def rebase(df: DataFrame, key: str, by: int) -> DataFrame:
    return df.withColumn(key, F.col(key) + by)


def expire(df: DataFrame, key: str, before: int) -> DataFrame:
    """Rows of keys from ``before`` on, with keys counted from there."""
    return df.where(F.col(key) >= before).withColumn(key, F.col(key) - before)


def greedy_dedup(sketches: DataFrame, record: str, order: Sequence[str], blocks: Sequence[str], threshold: int) -> DataFrame:
    """Rows of a record that are further than ``threshold`` bits from every row kept before, in ``order``.

    What is kept depends on the order, so a record is folded in one place; a record is one image or
    request, whose sketches are few. A row is compared with all kept ones at once.
    """
    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        x = np.column_stack([t.column(c).to_numpy() for c in blocks]).view(np.uint64)
        kept = np.zeros_like(x)
        at: list[int] = []
        for i, row in enumerate(x):
            if not (np.bitwise_count(kept[:len(at)] ^ row).sum(axis=1, dtype=np.int64) <= threshold).any():
                kept[len(at)] = row
                at.append(i)
        return t.take(pa.array(at, pa.int64()))

    return sketches.groupBy(record).applyInArrow(fold, sketches.schema)
