"""What several operators here need: checkpoints, sizing, local forests, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.ordering import checkpointed, shared_folder

#: Stands for a null id inside an operator: it sorts before every other id.
NO_ID = -(2**63)
BATCH_SETTING, SLICE_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Bytes of words and of what is made of them that a cache holds before it is emptied; what Python adds to each comes
#: on top, which the caches' own bounds of entries limit.
HELD_BYTES = 48 << 20
#: Bits of a sieve: 2 MB, whatever the input.
SIEVE_BITS = 1 << 24


def written(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """df as a compressed table in the shared folder, and what removes it when it is read no more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def remove() -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), remove


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run inside get Arrow batches of SLICE_BYTES at most; the session's own setting comes back after them."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(SLICE_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


#: What operators hold in a worker from one task to the next: functions with a cache.
HELD: list[Callable] = []


def held_by_worker(make: Callable) -> Callable:
    """make with its last result held in the worker until a task of another operator starts there."""
    cached = lru_cache(1)(make)
    HELD.append(cached)
    return cached


def text_slices(batches: Iterable[pa.RecordBatch], keep: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about SLICE_BYTES, one row at least.

    Spark bounds a batch by rows, or by a setting that is the session's own business (small_batches() sets
    it for jobs that an operator runs itself). What a task makes of a slice, lists of texts or
    words and new columns, is bounded in any session. What other operators than ``keep`` hold in this worker goes.
    """
    for cached in HELD:
        if cached is not keep:
            cached.cache_clear()
    for b in batches:
        parts = max(1, -(-b.nbytes // SLICE_BYTES))
        step = max(1, -(-b.num_rows // parts))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)
        del b
        pa.default_memory_pool().release_unused()


class Sieve:
    """A bitmap of fixed size that holds every number put in, and few others while it is not full."""

    def __init__(self, keys: DataFrame, column: str):
        bit = F.pmod(column, F.lit(SIEVE_BITS))
        words = keys.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("bits")).toArrow()
        self.words = np.zeros(SIEVE_BITS // 64, np.uint64)
        self.words[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers % SIEVE_BITS
        return (self.words[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def usable_vector(vec):
    """A vector that is not null or empty and has no null or non-finite component."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


class Forest:
    """Union-find over 0..n-1 whose unions take whole arrays of edges; a root is its tree's least node."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(u, v)``; component is the least node reachable.

    Alternating large-star and small-star contraction: each round two aggregations and
    two joins over the edges, which shrink to stars in a logarithmic number of rounds.
    Hubs meet one aggregate row in a sort-merge join, so adaptive execution can split them.
    """
    def stars(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    e = checkpointed(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = stars(e)
    while state[0]:  # until a round changes nothing
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = checkpointed(small.select("s.u", "s.v").where("u <> v").distinct())
        before, state = state, stars(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
