"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

SEED = 17


def _bits32(hex_col):
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = SEED, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source",
                    rows_per_bucket: int = 16384) -> DataFrame:
    """Deal documents into ``shards`` shards whose row counts differ by one at most.

    Rows of a source are shuffled by a seeded hash of the id and ranked; the fractional rank
    (rank - 1 + phase) / rows of the source, with a phase per source in (0, 1) from the seed,
    spreads every source evenly over [0, 1). The rows sorted by it are cut into equal runs, so
    each shard holds every source in proportion.

    No rank is taken over a whole source or table in one task: rows fall into buckets by the
    leading bits of the sort key, counts per bucket give offsets, and only rows of one bucket
    (about ``rows_per_bucket``) are ranked together, so a hot source is split like any other.

    Result: doc_id, size (UTF-8 bytes + 8), text_crc32, law ('rows'), shard, slot (gapless
    from 0), grown_shard (null under this law), source. Null text counts as empty; null source
    is a source of its own; repeated ids are ordered by checksum and size; texts of any length are read
    whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("stratum", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))) \
     .withColumn("mix", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = checkpointed(rows)
    n = rows.count()
    buckets = max(16, -(-n // rows_per_bucket))

    rows = rows.withColumn("b1", F.shiftright(_bits32(F.col("mix")) * F.lit(buckets), 32))
    before = Window.partitionBy("stratum").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("stratum", "b1").count().select(
        "stratum", "b1", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("off1"),
        F.sum("count").over(Window.partitionBy("stratum")).alias("n1"))
    within = Window.partitionBy("stratum", "b1").orderBy("mix", "doc_id", "text_crc32", "size")
    phase = (_bits32(F.md5(F.concat(F.lit(f"{seed}:"), "stratum"))).cast("double") + 0.5) / F.lit(4294967296.0)
    rows = rows.withColumn("r1", F.row_number().over(within)).join(offsets, ["stratum", "b1"])
    rows = rows.withColumn("frac", ((F.col("off1") + F.col("r1") - 1).cast("double") + phase) / F.col("n1").cast("double"))

    rows = rows.withColumn("b2", F.floor(F.col("frac") * F.lit(float(buckets))))
    before = Window.orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    offsets = rows.groupBy("b2").count().select("b2", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("off2"))
    within = Window.partitionBy("b2").orderBy("frac", "stratum", "mix", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("r2", F.row_number().over(within)).join(offsets, "b2")
    rows = rows.withColumn("at", (F.col("off2") + F.col("r2") - 1).cast("bigint"))
    shard = F.expr(f"(at * {shards}) div {max(n, 1)}")
    return rows.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source")
