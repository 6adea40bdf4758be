"""The keyed relations of an image store as DataFrames: inserts, deletes, id allocation, generations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.bits import BLOCKS

from .hamming_join import block_rows
from .ordering import checkpointed, positions

SKETCHES_PER_IMAGE = 256


def sketch_id(image_id, ordinal):
    """(image id << 8) + ordinal; longs, so neither part is limited to 32 bits together."""
    return F.shiftleft(image_id.cast("bigint"), 8) + ordinal


@dataclass(frozen=True)
class Store:
    """images(image_id, pid, fingerprint, siftnum), sketches(sketch_id, b0..b3) and free(image_id), the ids to use again.

    Postings, the images of a pid and those of a fingerprint are views of these, so no change can leave them behind.
    """
    images: DataFrame
    sketches: DataFrame
    free: DataFrame
    next_id: int

    def postings(self) -> DataFrame:
        """(block, block_key, sketch_id): the inverted lists."""
        return block_rows(self.sketches).select("block", "block_key", "sketch_id")

    def of_pid(self) -> DataFrame:
        return self.images.select("pid", "image_id")

    def of_fingerprint(self) -> DataFrame:
        return self.images.select("fingerprint", "image_id")

    def attributes(self) -> DataFrame:
        return self.images.select("image_id", "pid", "fingerprint", "siftnum")


def allocate_ids(requests: DataFrame, free: DataFrame, start: int, *order) -> DataFrame:
    """requests with ``image_id``: recycled ids of ``free(image_id)`` first, in order, then from ``start`` on."""
    asked = positions(requests, *order)
    pool = positions(free, F.col("image_id"))
    n_free = pool.count()
    held = asked.join(pool.select("position", F.col("image_id").alias("recycled")), "position", "left")
    return held.withColumn("image_id", F.coalesce(
        "recycled", F.col("position") - n_free + start).cast("bigint")).drop("recycled", "position")


def additions(store: Store, records: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """What insert() adds: images, sketches, how many new ids it takes, and (request, image_id, reply)."""
    named = F.coalesce(F.col("pid"), F.lit("")) != ""
    placed = checkpointed(allocate_ids(records.where(named), store.free, store.next_id, F.col("request")))
    counted = sketches.groupBy("request").agg(F.count("*").alias("siftnum"))
    images = placed.join(counted, "request", "left").select(
        "image_id", "pid", "fingerprint", F.coalesce("siftnum", F.lit(0)).alias("siftnum"))
    marks = sketches.join(placed.select("request", "image_id"), "request").select(sketch_id(F.col("image_id"), F.col("ord")).alias("sketch_id"), *BLOCKS)
    replies = placed.select("request", "image_id", F.lit("REPLY_OK").alias("reply")).unionByName(records.where(~named).select(
        "request", F.lit(None).cast("bigint").alias("image_id"), F.lit("REPLY_INVALID_PID").alias("reply")))
    return images, marks, max(placed.count() - store.free.count(), 0), replies


def insert(store: Store, records: DataFrame, sketches: DataFrame) -> tuple[Store, DataFrame]:
    """The store with records(request, pid, fingerprint) and their sketches(request, ord, b0..b3), and (request, image_id, reply).

    A record without a pid is refused. The others get ids in the order of requests, recycled ones first;
    equal pids may be inserted again. siftnum is the number of a record's sketches.
    """
    images, marks, used, replies = additions(store, records, sketches)
    return replace(store, images=store.images.unionByName(images), sketches=store.sketches.unionByName(marks),
                   free=store.free.join(images.select("image_id"), "image_id", "left_anti"), next_id=store.next_id + used), replies


def delete_by_pid(store: Store, pids: DataFrame) -> tuple[Store, DataFrame]:
    """The store without any image of ``pids(pid)``, whose ids are free again, and (pid, reply)."""
    gone = store.images.join(pids.select("pid").distinct(), "pid", "left_semi").select("image_id")
    known = store.images.select("pid").distinct().withColumn("known", F.lit(True))
    replies = pids.join(known, "pid", "left").select("pid", F.when(F.col("known"), "REPLY_OK").otherwise("REPLY_INVALID_PID").alias("reply"))
    of_image = F.shiftright("sketch_id", 8)
    return replace(store, images=store.images.join(gone, "image_id", "left_anti"),
                   sketches=store.sketches.join(gone, of_image == gone["image_id"], "left_anti"),
                   free=store.free.unionByName(gone)), replies


def existence(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """asked with ``code``: 1 if held has the key, 0 if not, -1 if none is given."""
    known = held.select(key).distinct().withColumn("_known", F.lit(1))
    return asked.join(known, key, "left").withColumn(
        "code", F.when(F.col(key).isNull(), -1).otherwise(F.coalesce("_known", F.lit(0)))).drop("_known")


def upsert_attributes(images: DataFrame, changes: DataFrame, key: str = "image_id") -> DataFrame:
    """Flagged (non-null) fields of ``changes`` replace those of images; unknown keys are added."""
    fields = [c for c in images.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields if c in changes.columns])
    return images.join(new, key, "full").select(key, *[
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in fields])


def rotate(generations: DataFrame, column: str = "generation") -> DataFrame:
    """The current generation (0) becomes the previous one (1); what was previous goes."""
    return generations.where(F.col(column) == 0).withColumn(column, F.lit(1).cast(generations.schema[column].dataType))


def settings_put(settings: DataFrame, key: str, value: str) -> DataFrame:
    row = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return settings.where(F.col("key") != key).unionByName(row)
