"""Duplicate groups of fingerprints and counting over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups(df: DataFrame, fingerprint: str, member: str, least: int = 1) -> DataFrame:
    """(fingerprint, n, first) of groups with ``least`` members or more."""
    return df.groupBy(fingerprint).agg(F.count("*").alias("n"), F.min(member).alias("first")).where(F.col("n") >= least)


def membership(df: DataFrame, fingerprint: str, member: str, least: int = 1) -> DataFrame:
    """(fingerprint, member, n, first): every member with its group, never all pairs."""
    return df.select(fingerprint, member).join(groups(df, fingerprint, member, least), fingerprint)


def group_lines(df: DataFrame, fingerprint: str, member: str, path: str) -> DataFrame:
    """Text lines of the groups report, in order: a head 'fingerprint<tab>n', then the paths."""
    held = membership(df, fingerprint, member, 2).join(df.select(member, path), member)
    heads = groups(df, fingerprint, member, 2).select(
        fingerprint, F.lit(-1).cast("bigint").alias(member), F.concat_ws("\t", fingerprint, "n").alias("line"))
    return heads.unionByName(held.select(fingerprint, member, F.col(path).alias("line")))


def first_seen(df: DataFrame, fingerprint: str, member: str) -> DataFrame:
    """Whether an earlier member has the same fingerprint; one aggregate row per fingerprint is joined back."""
    first = df.groupBy(fingerprint).agg(F.min(member).alias("_first"))
    return df.join(first, fingerprint).withColumn("seen", F.col(member) > F.col("_first")).drop("_first")


def statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, sum, sum of squares, min, max, mean and sample deviation (0 for one value)."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("least"),
        F.max(v).alias("greatest"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("deviation"))


def running_ratio(placed: DataFrame, flag: str, position: str = "position", width: int = 8192) -> DataFrame:
    """Running share of rows with ``flag`` unset, by position, in blocks of ``width`` rows and groups of as many blocks.

    Sums within a block are windows over that block, sums of a group's earlier blocks over one row a block, and
    those of earlier groups over one row for width^2 rows, so no task holds more than a fraction of the table.
    """
    fresh = F.when(F.col(flag), 0).otherwise(1)
    rows = placed.withColumn("_block", F.floor(F.col(position) / width))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_block").agg(F.sum(fresh).alias("s")).withColumn("_group", F.floor(F.col("_block") / width))
    groups_ = sums.groupBy("_group").agg(F.sum("s").alias("s")).select(
        "_group", F.coalesce(F.sum("s").over(before(Window.orderBy("_group"))), F.lit(0)).alias("_base"))
    starts = sums.withColumn("_own", F.coalesce(F.sum("s").over(before(Window.partitionBy("_group").orderBy("_block"))), F.lit(0)))
    starts = starts.join(groups_, "_group").select("_block", (F.col("_base") + F.col("_own")).alias("_start"))
    inner = F.sum(fresh).over(Window.partitionBy("_block").orderBy(position))
    return rows.withColumn("_inner", inner).join(starts, "_block").withColumn(
        "distinct_so_far", (F.col("_start") + F.col("_inner")).cast("bigint")).drop("_block", "_inner", "_start")
