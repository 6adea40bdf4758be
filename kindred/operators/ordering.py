"""Global positions without a single-task sort, and the sampling and merging built on them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from ``spark.checkpoint.dir``.

    One of our own is made only where the session names none and all tasks run in this process (tests);
    a cluster without one is an error, as no local folder is shared there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kindred-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *order: Column) -> DataFrame:
    """df dealt to all cores if it is read from fewer files than there are cores and is no more than a split a core.

    A small table is often one row group, which only one task can read; what follows a scan would run there
    alone. Larger tables are left as they are. ``order`` fixes the rows' order within a partition, so that a
    task that runs again meets them in the same one.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not 0 < len(df.inputFiles()) < cores or size > cores * split:
        return df
    return df.repartition(cores).sortWithinPartitions(*order) if order else df.repartition(cores)


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """df with the 0-based place of each row in the total order.

    Rows are dealt by range, ranked within their range, and shifted by the row counts of earlier
    ranges (one row a partition). The order must be total for the result to be unique.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged)  # bounds are sampled, so the ranges are fixed once
    counts = ranged.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(
        name, (F.col("_start") + F.col("_place") - 1).cast("bigint")).drop("_range", "_start", "_place")


def every_nth(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Rows 0, n, 2n, ... of the order."""
    return positions(df, *order).where(F.col("position") % n == 0)


def rotated(blocks: list[str], start: int) -> list[Column]:
    """The order of sketches whose first compared block is ``start``."""
    return [F.col(b) for b in blocks[start:] + blocks[:start]]


def split_evenly(df: DataFrame, parts: int, *order: Column) -> DataFrame:
    """Contiguous parts of equal size: part = position * parts / rows."""
    placed = positions(df, *order)
    rows = placed.count()
    return placed.withColumn("part", F.expr(f"position * {parts} div {max(rows, 1)}").cast("bigint"))
