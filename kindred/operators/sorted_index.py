"""A sorted index of sketches on disk: one order per block, in files of disjoint key ranges that scans prune."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.bits import BLOCKS, hamming

from .ordering import rotated


def save(points: DataFrame, path: str, blocks: Sequence[str] = BLOCKS) -> None:
    """For each block the points in the order that begins with it, below ``path``/<block>.

    Rows are dealt by range and sorted, so a file, and each row group in it, covers a narrow range of keys; their
    statistics are what a sample file of every n-th key would be.
    """
    for k, block in enumerate(blocks):
        order = rotated(list(blocks), k)
        points.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", 8 << 20).mode("overwrite").parquet(f"{path}/{block}")


def save_generation(points: DataFrame, path: str, generation: int, key: str, by: int = 0, blocks: Sequence[str] = BLOCKS) -> None:
    """save() as one generation of an index, its keys moved by ``by``; other generations stay as they are."""
    save(points.withColumn(key, F.col(key) + by), f"{path}/generation={generation}", blocks)


def generations(spark: SparkSession, path: str, block: str) -> DataFrame:
    """Points of all generations, with the number of each, in the order that begins with ``block``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().startswith("generation="))
    return spark.read.option("basePath", path).parquet(*(f"{path}/{n}/{block}" for n in names))


def between(spark: SparkSession, path: str, block: str, low: int, high: int) -> DataFrame:
    """Points whose key in ``block`` is from low to high; other files and row groups are not read."""
    return spark.read.parquet(f"{path}/{block}").where(F.col(block).between(low, high))


def search(queries: DataFrame, path: str, threshold: int, blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """Pairs of queries and points within ``threshold`` bits, fewer than there are blocks, so that one block agrees.

    Of each order only the range of the queries' keys is scanned. A pair comes from its first
    agreeing block. Columns of the query side get the prefix ``q_``.
    """
    if threshold >= len(blocks):
        raise ValueError("a pair might agree in no block")
    q = queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns])
    found = []
    for k, block in enumerate(blocks):
        low, high = queries.agg(F.min(block), F.max(block)).first()
        if low is None:
            low, high = 0, -1
        mine, theirs = [F.col(f"q_{b}") for b in blocks], [F.col(b) for b in blocks]
        distance = hamming(mine, theirs)
        first = F.lit(True)
        for b in blocks[:k]:
            first = first & (F.col(f"q_{b}") != F.col(b))
        part = between(queries.sparkSession, path, block, low, high)
        found.append(q.join(part, q[f"q_{block}"] == part[block]).where((distance <= threshold) & first).withColumn("distance", distance))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def reload(spark: SparkSession, path: str, blocks: Sequence[str] = BLOCKS) -> bool:
    """Forgets what the session holds of the index's files, and tells whether all of its orders are there to be read."""
    spark.catalog.refreshByPath(path)
    at = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{b}") for b in blocks]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return all(p.getFileSystem(conf).exists(p) for p in at)
