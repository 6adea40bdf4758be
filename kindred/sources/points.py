"""Fixed-width and length-prefixed binary files, manifests and reports; canonical storage is Parquet.

Files of little-endian rows go through the data source of kindred.sources.binary.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import images

from . import binary

MANIFEST = "key bigint, num int, fingerprint string, url string"


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All files below a folder: path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


# binary files: kindred.sources.binary cuts and commits them
def read_points(spark: SparkSession, path: str, sketch_first: bool = True, **options) -> DataFrame:
    """(sketch binary, key): rows of 16 + 4 bytes in either order; a cut last row is left out."""
    return binary.read(spark, path, "points", key_first=not sketch_first, **options)


def read_records(spark: SparkSession, path: str, width: int = 16, **options) -> DataFrame:
    """(pid, items): length and bytes of the pid, then count and items of ``width`` bytes, until the end."""
    return binary.read(spark, path, "records", width=width, **options)


def read_key_pids(spark: SparkSession, path: str, **options) -> DataFrame:
    """(key, pid): unsigned key, length and bytes of the pid."""
    return binary.read(spark, path, "key_pids", **options)


def read_bins(spark: SparkSession, path: str, **options) -> DataFrame:
    """(key, count): two unsigned numbers a row."""
    return binary.read(spark, path, "bins", **options)


def read_matrix(spark: SparkSession, path: str, **options) -> DataFrame:
    """(row_id, vec): three unsigned numbers (element size, rows, columns), then 32-bit floats row by row; row_id counts in each file."""
    return binary.read(spark, path, "matrix", **options)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, num, fingerprint, url), tab-separated; the fingerprint is an unsigned decimal, so a string."""
    return spark.read.csv(path, sep="\t", schema=MANIFEST)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated names of a text file."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("name")).where("name <> ''")


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, rank, id, dist) from lines 'query k (id dist)*'."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"))
    t = t.select(F.col("t")[0].cast("bigint").alias("q_id"), F.col("t")[1].cast("int").alias("k"), F.slice("t", 3, F.size("t")).alias("t"))
    at = F.explode(F.sequence(F.lit(1), "k")).alias("rank")
    return t.where("k > 0").select("q_id", "t", at).select(
        "q_id", "rank", F.get("t", F.col("rank") * 2 - 2).cast("bigint").alias("id"), F.get("t", F.col("rank") * 2 - 1).cast("double").alias("dist"))


def write_neighbours(ranked: DataFrame, path: str) -> None:
    pair = F.struct("rank", F.concat_ws("\t", F.col("id").cast("string"), F.col("dist").cast("string")).alias("p"))
    lists = ranked.groupBy("q_id").agg(F.sort_array(F.collect_list(pair)).alias("l"), F.count("*").alias("k"))
    lists.select(F.concat_ws("\t", F.col("q_id").cast("string"), F.col("k").cast("string"), F.concat_ws("\t", "l.p"))).write.text(path)


def read_raw_records(spark: SparkSession, path: str, width: int = 128, **options) -> DataFrame:
    """(url, ord, desc): length and bytes of the url, then count and descriptors of ``width`` 32-bit floats, one row each.

    A url without descriptors gives none; a cut last record is left out.
    """
    return binary.read(spark, path, "raw_records", columns=width, **options)


def read_descriptors(spark: SparkSession, path: str, width: int = 128, **options) -> DataFrame:
    """(vec): rows of ``width`` 32-bit floats without a head, as blacklists are kept."""
    return binary.read(spark, path, "vectors", columns=width, **options)


def peek_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, element_size, rows, columns) from the heads of matrix files."""
    return binary.heads(spark, path)


def pack_points(points: DataFrame, sketch: str = "sketch", key: str = "key", by: int = 0) -> DataFrame:
    """20-byte rows, keys moved by ``by``, one binary per task and batch, for export."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([binary.point_rows(b.column(0), b.column(1).to_numpy() + by)], pa.binary())], names=["rows"])
    return points.select(sketch, F.col(key).cast("bigint")).mapInArrow(run, "rows binary")


def _sized(data: bytes, kind: str) -> bytes:
    return struct.pack(kind, len(data)) + data


def write_points(points: DataFrame, path: str, by: int = 0, **options) -> DataFrame:
    """Files of points(sketch, key), keys moved by ``by``."""
    return binary.write(points.select("sketch", F.col("key").cast("bigint").alias("key")), path, "points", by=by, **options)


def write_records(records: DataFrame, path: str, **options) -> DataFrame:
    """Files of records(pid, items), items of equal width."""
    return binary.write(records.select("pid", "items"), path, "records", **options)


def write_raw_records(records: DataFrame, path: str, **options) -> DataFrame:
    """Files of records(url, descs), descs an array of arrays of 32-bit floats."""
    return binary.write(records.select("url", "descs"), path, "raw_records", **options)


def write_key_pids(pairs: DataFrame, path: str, by: int = 0, **options) -> DataFrame:
    """Files of pairs(key, pid), keys moved by ``by``."""
    return binary.write(pairs.select(F.col("key").cast("bigint").alias("key"), "pid"), path, "key_pids", by=by, **options)


def write_bins(bins: DataFrame, path: str, **options) -> DataFrame:
    return binary.write(bins.select(F.col("key").cast("bigint").alias("key"), F.col("count").cast("bigint").alias("count")), path, "bins", **options)


def write_matrix(vectors: DataFrame, path: str, **options) -> DataFrame:
    """Matrix files of vectors(vec), each with its own head; a task starts another where one is full."""
    return binary.write(vectors.select("vec"), path, "matrix", **options)


def write_matrix_file(vectors: DataFrame, path: str) -> int:
    """One matrix file of all vectors(vec), written in parallel; see binary.write_matrix_file()."""
    return binary.write_matrix_file(vectors.select("vec"), path)


def lines(df: DataFrame, *columns: str) -> DataFrame:
    """(line): columns joined by tabs, as bins, id pairs, manifests and counts are printed."""
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("line"))


def write_lines(df: DataFrame, path: str, *columns: str) -> None:
    """lines() as text files: fingerprint counts, bins and id pairs in print."""
    lines(df, *columns).write.text(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """key, sketch count, unsigned fingerprint and path of each image."""
    rows.select("key", "num", "fingerprint", "url").write.csv(path, sep="\t")


def write_index_conf(conf: DataFrame, path: str) -> None:
    """min_key, max_key and n on one line."""
    lines(conf, "min_key", "max_key", "n").coalesce(1).write.text(path)


def write_text_log(log: DataFrame, path: str, ts: str, message: str) -> None:
    """Lines of time and message, appended."""
    log.select(F.concat_ws("\t", F.date_format(ts, "EEE MMM dd HH:mm:ss yyyy"), message)).write.mode("append").text(path)


def write_by_fingerprint(images: DataFrame, path: str) -> None:
    """Images in one folder per fingerprint; nothing is copied by a shell."""
    images.write.partitionBy("fingerprint").mode("overwrite").parquet(path)


# records as they go over the wire
PASS, URL_BYTES, RECORD_SKETCHES = b"record", 400, 200


def pack_wire(records: DataFrame) -> DataFrame:
    """(wire): the word 'record', fingerprint, url and sketches with their lengths, of records(fingerprint, url, items)."""
    def run(batches):
        for b in batches:
            out = [PASS + struct.pack("<Q", (f or 0) % 2**64) + _sized((u or "").encode(), "<I") + struct.pack("<I", len(i or ())) + b"".join(i or ())
                   for f, u, i in zip(*(b.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(out, pa.binary())], names=[*b.schema.names[3:], "wire"])
    rest = [c for c in records.columns if c not in ("fingerprint", "url", "items")]
    schema = "".join(f"`{c}` {records.schema[c].dataType.simpleString()}, " for c in rest) + "wire binary"
    return records.select("fingerprint", "url", "items", *rest).mapInArrow(run, schema)


def _parse_wire(data: bytes | None, width: int = 16):
    if not data or data[:6] != PASS or len(data) < 18:
        return None
    fingerprint, n = struct.unpack_from("<QI", data, 6)
    if n > URL_BYTES or len(data) < 22 + n:
        return None
    k, = struct.unpack_from("<I", data, 18 + n)
    if k > RECORD_SKETCHES or len(data) < 22 + n + k * width:
        return None
    at = 22 + n
    signed = fingerprint - 2**64 if fingerprint >> 63 else fingerprint
    return signed, data[18:18 + n].decode("utf-8", "replace"), [data[at + i * width:at + (i + 1) * width] for i in range(k)]


def parse_wire(rows: DataFrame, wire: str = "wire") -> DataFrame:
    """rows with valid, fingerprint (as a signed long), url and items; a bad word, length or end makes a record invalid.

    A url may have 400 bytes and a record 200 sketches.
    """
    rest = [c for c in rows.columns if c != wire]

    def run(batches):
        for b in batches:
            got = [_parse_wire(w) for w in b.column(len(rest)).to_pylist()]
            part = lambda k: [g and g[k] for g in got]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*b.columns[:len(rest)], pa.array([g is not None for g in got]), pa.array(part(0), pa.int64()), pa.array(part(1), pa.string()),
                                              pa.array(part(2), pa.list_(pa.binary()))], names=[*rest, "valid", "fingerprint", "url", "items"])
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in rest) + "valid boolean, fingerprint bigint, url string, items array<binary>"
    return rows.select(*rest, wire).mapInArrow(run, schema)


def short_number(x):
    """A number between 0 and 1 with six significant digits and no zeros at the end, as C++ streams print it."""
    digits = F.when(x >= 0.1, F.format_string("%.6f", x)).when(x >= 0.01, F.format_string("%.7f", x)).otherwise(F.format_string("%.8f", x))
    return F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")


def wire_replies(queries: DataFrame, ranked: DataFrame, code: int = 0) -> DataFrame:
    """(query_id, wire): 32 bits of the reply code, 32 bits of length, then lines of pid, tab and score by rank."""
    one = F.concat_ws("\t", "pid", short_number(F.col("score")))
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", one.alias("l")))).alias("h"))
    text = F.concat_ws("", F.transform(F.coalesce("h.l", F.array().cast("array<string>")), lambda x: F.concat(x, F.lit("\n"))))
    word = lambda n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))
    return queries.join(lists, "query_id", "left").select("query_id", text.alias("t")).select(
        "query_id", F.concat(word(F.lit(code)), word(F.octet_length("t")), F.encode("t", "UTF-8")).alias("wire"))


def write_log(log: DataFrame, path: str) -> None:
    """The request log, by date, operation and outcome."""
    log.write.partitionBy("date", "op", "outcome").mode("append").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, width, height, channels, data) of decodable files, first frame, by Spark's image source."""
    df = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return df.select(F.xxhash64("image.origin").alias("image_id"), F.col("image.origin").alias("path"), "image.width",
                     "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def read_frames(spark: SparkSession, path: str, most: int = images.MOST_FRAMES) -> DataFrame:
    """Frames of the GIF and PNG files below a folder, at most ``most`` of a file; see images.frames()."""
    return images.frames(files(spark, path), most)


def is_gif(content):
    return F.substring(content, 1, 3) == F.lit(b"GIF")
