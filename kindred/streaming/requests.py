"""Request streams: parsing, first-seen dedup, counters, time windows, routing of operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from kindred.operators.ordering import shared_folder

COMMAND_BYTES, URL_BYTES, RECORD_SKETCHES = 512, 400, 200


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder, some per trigger; a path to one file streams that file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def parse_commands(df: DataFrame, text: str = "command") -> DataFrame:
    """op, url and pid of 'op url [pid]' commands ('delete pid'), and whether the command is well formed."""
    t = F.split(F.trim(F.col(text)), r"\s+")
    op = F.get(t, F.lit(0))
    word = lambda i: F.coalesce(F.get(t, F.lit(i)), F.lit(""))
    is_delete = op == "delete"
    return df.withColumn("op", op).withColumn("url", F.when(is_delete, "").otherwise(word(1))).withColumn(
        "pid", F.when(is_delete, word(1)).otherwise(word(2))).withColumn(
        "valid", (F.octet_length(text) < COMMAND_BYTES) & op.isin("query", "insert", "delete") & (F.size(t) > 1))


def valid_records(url, sketches):
    """A record is taken if its url has at most 400 bytes and it holds at most 200 sketches."""
    return (F.octet_length(url) <= URL_BYTES) & (sketches <= RECORD_SKETCHES)


def first_seen(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def counters(stream: DataFrame, *by: str) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, ts: str, *by: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; late rows within ``delay`` still count."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))


def route(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str, op: str = "op") -> StreamingQuery:
    """Hands each micro-batch to the handler of its operation; unknown operations are ignored."""
    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for name, handle in handlers.items():
                handle(batch.where(F.col(op) == name))
        finally:
            batch.unpersist()
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Runs a bounded stream to its end and gives what it has put out, for reports and tests.

    In append mode results go to Parquet files. In update mode a micro-batch writes only the rows that it has changed, and
    the last of each of ``keys`` counts; state behind the watermark can go. Both, and the stream's state, lie in the
    session's shared folder below ``name``, so nothing passes through the driver, a micro-batch that runs again replaces its
    own files, and a lost executor costs no more than its micro-batch.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/{name}"
    out = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        out.format("parquet").start(f"{at}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out/batch=-1")  # so that there is something to read

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    out.foreachBatch(put).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    told = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/out")
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*stream.columns)


# replies and admin commands of the servers, over the same rows
def framed(df: DataFrame, text: str = "message") -> DataFrame:
    """command and ``complete`` from messages of ten digits of length and then so many bytes.

    A message whose head is no number, or that ends early, is not complete; bytes beyond the length are left out.
    """
    head = F.substring(text, 1, 10)
    size = F.when(head.rlike("^[0-9]{10}$"), head.cast("bigint"))
    body = F.substring(F.encode(F.col(text), "UTF-8"), 11, 2**31 - 1)
    return df.withColumn("command", F.decode(F.substring(body, F.lit(1), F.coalesce(size, F.lit(0)).cast("int")), "UTF-8")).withColumn(
        "complete", F.coalesce((F.octet_length(body) >= size) & (size < COMMAND_BYTES), F.lit(False)))


#: Admin commands take no url: help, info and reset none at all, the others a value.
ADMIN = {"help": 0, "info": 0, "reset": 0, "setimgpath": 1, "setindexserv": 1}


def admin_settings(commands: DataFrame, order: str, text: str = "command") -> DataFrame:
    """(key, value): the last value given to each setting, in ``order``, since the last reset."""
    t = F.split(F.trim(F.col(text)), r"\s+")
    op = F.get(t, F.lit(0))
    rows = commands.select(F.col(order).alias("at"), op.alias("op"), F.get(t, F.lit(1)).alias("value"))
    reset = rows.where("op = 'reset'").agg(F.max("at").alias("reset"))
    given = rows.where(op_takes_value()).where("value IS NOT NULL").join(F.broadcast(reset), F.lit(True)).where("reset IS NULL OR at > reset")  # one row
    return given.groupBy(F.substring("op", 4, 100).alias("key")).agg(F.max_by("value", "at").alias("value"))


def op_takes_value():
    return F.col("op").isin(*[name for name, values in ADMIN.items() if values])


def cardinalities(df: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, rows, keys): entries and distinct keys of each index generation."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))


def with_elapsed(log: DataFrame, began: str, ended: str) -> DataFrame:
    """log with ``elapsed``, the seconds between two timestamps, to the microsecond."""
    return log.withColumn("elapsed", (F.unix_micros(ended) - F.unix_micros(began)) / 1e6)
