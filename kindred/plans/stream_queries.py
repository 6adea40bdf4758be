"""Queries that run streams of several micro-batches, with state, restarts and what they tell of themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kindred.functions.lsh import literal
from kindred.operators.ordering import shared_folder
from kindred.sources import points
from kindred.sources.url_queue import url_stream
from kindred.streaming import observe, requests, stateful

from .registry import query, table
from .relation_queries import COMMAND, commands, request_rows

#: Micro-batches, at least, and rows of one, about.
PARTS, PART_ROWS = 5, 1_000_000
TYPES = ("click", "error", "purchase", "signup", "view")


def _place(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _in_files(spark, df, order: str) -> str:
    """df in one file a micro-batch, earlier rows in earlier files.

    The rows are dealt to their parts once; then each part is read by itself and written after the one before it.
    """
    at = f"{_place(spark)}/in"
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    if not n:
        df.write.parquet(at)
        return at
    parts = max(PARTS, -(-n // PART_ROWS))
    borders = [low + (high + 1 - low) * k // parts for k in range(parts)]
    part = F.size(F.filter(literal(borders), lambda x: x <= F.col(order))) - 1
    df.where(F.col(order).isNotNull()).withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(f"{at}-parts")
    for k in range(parts):
        here = f"{at}-parts/_part={k}"
        if _there(spark, here):
            spark.read.schema(df.schema).parquet(here).coalesce(1).write.mode("append").parquet(at)
    return at


def _there(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT user_id, arg_min(event_id, ts) AS event_id, arg_min(event_type, ts) AS event_type FROM events GROUP BY user_id")
def stream_first_rows(spark, sf_dir):
    """The first row of each user in a stream of five files or more; state is carried from one micro-batch to the next."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    stream = _stream(spark, _in_files(spark, e, "event_id"), e.schema)
    with stateful.keyed_state(spark):
        first = stateful.first_seen(stream, "user_id", "ts", 1000 * 86_400, "1000 days")
        return requests.drain(first, "first_rows_" + uuid.uuid4().hex).select("user_id", "event_id", "event_type")


@query("WITH r AS (SELECT event_id, 'u' || user_id AS pid, event_id % 7 = 0 AS gone FROM events), d AS (SELECT pid, max(event_id) AS last FROM r WHERE gone GROUP BY pid) "
       "SELECT pid, count(*) AS inserted, count(CASE WHEN event_id < last THEN 1 END) AS freed, count(*) - count(CASE WHEN event_id < last THEN 1 END) AS held, 0::BIGINT AS shared FROM r LEFT JOIN d USING (pid) WHERE NOT gone GROUP BY pid")
def stream_allocator(spark, sf_dir):
    """Ids given out and used again over five micro-batches: what each pid took, gave back and holds, and held ids that another holds too."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.when(F.col("event_id") % 7 == 0, "delete").otherwise("insert").alias("op"),
                                              F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pid"))
    stream = _stream(spark, _in_files(spark, e, "at"), e.schema)
    with stateful.keyed_state(spark):
        told = requests.drain(stateful.allocated(stream, 1000), "ids_" + uuid.uuid4().hex)
    given, freed = F.count(F.when(F.col("op") == "insert", 1)), F.count(F.when((F.col("op") == "delete") & F.col("image_id").isNotNull(), 1))
    ids = told.where("image_id IS NOT NULL").groupBy("pid", "image_id").agg((given - freed).alias("n"))
    shared = ids.where("n > 0").groupBy("image_id").agg(F.count("*").alias("pids")).where("pids > 1")
    held = ids.join(shared, "image_id", "left").groupBy("pid").agg(F.sum("n").alias("held"), F.count("pids").alias("shared"))
    return told.groupBy("pid").agg(given.alias("inserted"), freed.alias("freed")).where("inserted > 0").join(held, "pid").select("pid", "inserted", "freed", "held", "shared")


@query(f"WITH c AS (SELECT event_id, string_split({COMMAND}, ' ') AS t FROM events) SELECT event_id, t[1] AS op, CASE WHEN t[1] = 'delete' THEN '' ELSE coalesce(t[2], '') END AS url, "
       "CASE WHEN t[1] = 'delete' THEN coalesce(t[2], '') ELSE coalesce(t[3], '') END AS pid, true AS valid FROM c")
def stream_requests(spark, sf_dir):
    """Commands parsed from a stream of five files or more."""
    c = commands(table(spark, sf_dir, "events")).select("event_id", "command")
    stream = _stream(spark, _in_files(spark, c, "event_id"), c.schema)
    return requests.drain(requests.parse_commands(stream).select("event_id", "op", "url", "pid", "valid"), "requests_" + uuid.uuid4().hex)


@query("SELECT url FROM pages WHERE trim(url) <> ''")
def stream_url_queue(spark, sf_dir):
    """Urls from a spool folder: three runs of one bounded micro-batch, then one to the end, each going on where the last stopped."""
    at = _place(spark)
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("value")).where("trim(value) <> ''")
    rows.repartition(PARTS).write.text(f"{at}/spool")
    size = rows.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    for run in range(4):
        urls = url_stream(spark, f"{at}/spool", f"{at}/state", size // 7 + 1, size // 40 + 1)
        started = urls.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
        if run < 3:
            started.trigger(availableNow=True).start().awaitTermination()
        else:
            last = started.trigger(processingTime="0 seconds").start()
            last.processAllAvailable()
            last.stop()
    return spark.read.schema("url string, file string, byte bigint").parquet(f"{at}/out").select("url")


COUNTED = "SELECT event_type AS metric, count(*)::DOUBLE AS value FROM events GROUP BY event_type UNION ALL SELECT 'rows', count(*)::DOUBLE FROM events UNION ALL SELECT 'other', 0::DOUBLE"


@query(COUNTED)
def observed_requests(spark, sf_dir):
    """Operations of the request log, counted by the job that writes it."""
    rows = request_rows(table(spark, sf_dir, "events")).select("date", "op", "outcome", "event_id")
    told = observe.observed(rows, lambda df: points.write_log(df, _place(spark)), *observe.count_columns("op", TYPES))
    return told.where("metric <> 'seconds'")


@query(COUNTED)
def observed_stream(spark, sf_dir):
    """The same from the progress of a stream over five micro-batches."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    at = _in_files(spark, e, "event_id")

    def run(stream):
        q = stream.writeStream.queryName(name).format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        return str(q.id)

    name = "observed_" + uuid.uuid4().hex
    told = observe.logged(_stream(spark, at, e.schema), name, run, *observe.count_columns("event_type", TYPES))
    return told.where("metric <> 'seconds'")
