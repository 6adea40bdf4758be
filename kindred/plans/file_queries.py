"""Queries that write the library's file formats into the shared folder and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kindred.operators.knn import exhaustive
from kindred.operators.ordering import shared_folder
from kindred.sources import binary, points

from . import sketch_queries as sketches
from .registry import query, table
from .vector_queries import PAIRS, RANK, whole_vectors


def _place(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _word(block):
    """Four little-endian bytes of a block of 16 bits."""
    part = lambda n: F.lpad(F.hex(n), 2, "0")
    return F.concat(part(F.col(block) % 256), part(F.floor(F.col(block) / 256)), F.lit("0000"))


SKETCH_HEX = " || ".join(f"format('{{:02x}}{{:02x}}0000', b{k} % 256, b{k} // 256)" for k in range(4))


def _points(spark, sf_dir):
    return sketches.planted(spark, sf_dir).select(F.unhex(F.concat(*map(_word, sketches.BLOCKS))).alias("sketch"), F.col("image_id").alias("key"))


@query("WITH " + sketches.PLANTED + f" SELECT {SKETCH_HEX} AS sketch, image_id + 7 AS key FROM pl")
def point_files(spark, sf_dir):
    """20-byte rows, keys moved on the way out."""
    points.write_points(_points(spark, sf_dir), at := _place(spark), 7)
    return points.read_points(spark, at).select(F.lower(F.hex("sketch")).alias("sketch"), "key")


CONVERSATIONS = "c AS (SELECT conv_id::VARCHAR AS pid, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, md5(coalesce(text, '')) AS item FROM conversations)"


def _conversations(spark, sf_dir):
    one = F.struct("turn", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("item"))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("pid")).agg(F.sort_array(F.collect_list(one)).alias("l")).select("pid", F.col("l.item").alias("items"))


@query(f"WITH {CONVERSATIONS} SELECT pid, ord, item FROM c")
def record_files(spark, sf_dir):
    """A conversation as a record, its turns as sketches."""
    points.write_records(_conversations(spark, sf_dir), at := _place(spark))
    return points.read_records(spark, at).select("pid", F.posexplode("items").alias("ord", "item")).select(
        "pid", F.col("ord").cast("bigint").alias("ord"), F.lower(F.hex("item")).alias("item"))


@query("SELECT 'label' || label AS url, list_sum(list_transform(range(64), lambda i: (i + 1) * round(embedding[i + 1]::DOUBLE * 1000)))::BIGINT AS digest FROM embeddings")
def raw_record_files(spark, sf_dir):
    """Descriptors of 64 floats by label; a digest of each after the way through the file.

    A label's descriptors lie in records of one url, each of the vectors of 1,024 neighbouring ids, so no record grows with the table.
    """
    url = F.concat(F.lit("label"), F.col("label").cast("string")).alias("url")
    rows = table(spark, sf_dir, "embeddings").groupBy(url, F.floor(F.col("vec_id") / 1024).alias("part")).agg(F.collect_list("embedding").alias("descs"))
    points.write_raw_records(rows, at := _place(spark))
    return points.read_raw_records(spark, at, 64).select("url", _digest("desc"))


@query("SELECT c_custkey + 1000 AS key, c_name AS pid FROM customer")
def keypid_files(spark, sf_dir):
    points.write_key_pids(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("pid")), at := _place(spark), 1000)
    return points.read_key_pids(spark, at)


@query("SELECT p_size::BIGINT AS key, count(*) AS count, p_size || chr(9) || count(*) AS line FROM part GROUP BY p_size")
def bin_files(spark, sf_dir):
    """Bins written, read and printed."""
    points.write_bins(table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("key")).count(), at := _place(spark))
    return points.read_bins(spark, at).withColumn("line", F.concat_ws("\t", F.col("key").cast("string"), F.col("count").cast("string")))


@query("SELECT page_id AS key, (length(html) % 40)::INT AS num, ('0x' || substr(md5(url), 1, 15))::BIGINT::VARCHAR AS fingerprint, 'p' || page_id AS url FROM pages")
def manifest_files(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), (F.length("html") % 40).alias("num"), F.conv(F.substring(F.md5("url"), 1, 15), 16, 10).alias("fingerprint"),
                                                F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"))
    points.write_manifest(rows, at := _place(spark))
    return points.read_manifest(spark, at)


@query("SELECT count(*) AS files, sum(rows)::BIGINT AS rows, max(columns)::BIGINT AS columns FROM (SELECT 1 AS f, count(*) AS rows, max(len(embedding)) AS columns FROM embeddings)")
def matrix_heads(spark, sf_dir):
    """The sizes that a matrix file's head tells, without its rows."""
    points.write_matrix_file(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec")), at := f"{_place(spark)}/matrix")
    return points.peek_matrix(spark, at).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max(F.when(F.col("rows") > 0, F.col("columns"))).alias("columns"))


DIGEST = "list_sum(list_transform(range(64), lambda i: (i + 1) * round(embedding[i + 1]::DOUBLE * 1000)))::BIGINT AS digest"


def _digest(vec: str):
    return F.aggregate(F.transform(vec, lambda x, i: (i + 1) * F.round(x.cast("double") * 1000)), F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("digest")


@query(f"SELECT {DIGEST} FROM embeddings")
def matrix_rows(spark, sf_dir):
    """All rows back from matrices of several files, each read in spans of some 30 rows."""
    points.write_matrix(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec")).repartition(3), at := _place(spark))
    return points.read_matrix(spark, at, span_bytes=8000).select(_digest("vec"))


@query("WITH " + sketches.PLANTED + f" SELECT {SKETCH_HEX} AS sketch, image_id AS key FROM pl WHERE image_id BETWEEN 20000000 AND 49999999")
def point_source(spark, sf_dir):
    """A key range of points in files that lie by key: some files are left out, the others cut in spans and looked up."""
    rows = _points(spark, sf_dir).repartitionByRange(4, "key").sortWithinPartitions("key")
    size = points.write_points(rows, at := _place(spark)).agg(F.sum("bytes")).first()[0]
    kept = points.read_points(spark, at, span_bytes=size // 7 + 1).where(F.col("key").between(20_000_000, 49_999_999))
    return kept.select(F.lower(F.hex("sketch")).alias("sketch"), "key")


@query(f"WITH {CONVERSATIONS}, p AS (SELECT pid, ord, item, pid::BIGINT % 3 AS part FROM c) SELECT pid, ord, item FROM p WHERE part > 0 UNION ALL SELECT pid, ord, item FROM p WHERE part = 2")
def record_sink(spark, sf_dir):
    """Records written, replaced by others, and appended to; then found by their borders and read in spans."""
    rows, part = _conversations(spark, sf_dir), F.col("pid").cast("bigint") % 3
    points.write_records(rows.where(part == 0), at := _place(spark))
    points.write_records(rows.where(part > 0), at, mode="overwrite")
    points.write_records(rows.where(part == 2), at)
    binary.index_records(spark, at, "records", every=2000)
    return points.read_records(spark, at, span_bytes=2000).select("pid", F.posexplode("items").alias("ord", "item")).select(
        "pid", F.col("ord").cast("bigint").alias("ord"), F.lower(F.hex("item")).alias("item"))


@query("SELECT c_name AS name FROM customer UNION ALL SELECT 'n' || c_nationkey FROM customer")
def name_list(spark, sf_dir):
    """Names in a text file, two on a line with white space between."""
    both = F.concat(F.col("c_name"), F.lit("  "), F.lit("n"), F.col("c_nationkey").cast("string"))
    table(spark, sf_dir, "customer").select(both.alias("value")).write.text(at := _place(spark))
    return points.read_names(spark, at)


@query("SELECT c_nationkey::VARCHAR AS folder, c_name AS name FROM customer")
def listed_files(spark, sf_dir):
    """Files of a tree of folders, with where each lies and the lines of its content."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), F.col("c_name").alias("value"))
    rows.write.partitionBy("nation").text(at := _place(spark))
    found = points.files(spark, at, "*.txt").select(F.regexp_extract("path", "nation=n([0-9]+)", 1).alias("folder"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("name"))
    return found.where("name <> ''")


@query(f"WITH {PAIRS}{RANK} SELECT q_id, rank::INT AS rank, id, dist::DOUBLE AS dist FROM k WHERE rank <= 3")
def neighbour_files(spark, sf_dir):
    """A benchmark of nearest neighbours, written a query a line and read again."""
    w = whole_vectors(spark, sf_dir)
    points.write_neighbours(exhaustive(w, w, 3), at := _place(spark))
    return points.read_neighbours(spark, at)


@query("SELECT strftime(ts, '%a %b %d %H:%M:%S %Y') || chr(9) || event_type || ' ' || event_id AS line FROM events")
def text_log(spark, sf_dir):
    """Time and message of each event, appended to a log of lines."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("message"), "event_id")
    at = _place(spark)
    for part in (0, 1):
        points.write_text_log(e.where(F.col("event_id") % 2 == part), at, "ts", "message")
    return spark.read.text(at).withColumnRenamed("value", "line")


@query("SELECT doc_id AS image_id, 'f' || substr(md5(coalesce(text, '')), 1, 2) AS fingerprint FROM documents")
def fingerprint_folders(spark, sf_dir):
    """Images in a folder for each of 256 short fingerprints."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("f"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 2)).alias("fingerprint"))
    points.write_by_fingerprint(rows.repartition("fingerprint"), at := _place(spark))
    return spark.read.parquet(at).select("image_id", "fingerprint")


WIRE = ("w AS (SELECT page_id, repeat(url, 1 + page_id % 12) AS url, page_id * 7 % 260 AS n, ('0x' || substr(md5(url), 1, 15))::BIGINT AS fingerprint FROM pages)")


@query(f"WITH {WIRE}, v AS (SELECT *, page_id % 11 <> 0 AND strlen(url) <= 400 AND n <= 200 AS valid FROM w) SELECT page_id, valid, CASE WHEN valid THEN fingerprint END AS fingerprint, CASE WHEN valid THEN url END AS url, CASE WHEN valid THEN n END AS n FROM v")
def wire_records(spark, sf_dir):
    """Records sent and received; some with a bad word in front, a long url or too many sketches."""
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.conv(F.substring(F.md5("url"), 1, 15), 16, 10).cast("bigint").alias("fingerprint"),
                                                F.expr("repeat(url, cast(1 + page_id % 12 as int))").alias("url"), F.expr("array_repeat(unhex(md5(url)), cast(page_id * 7 % 260 as int))").alias("items"))
    sent = points.pack_wire(rows).withColumn("wire", F.when(i % 11 == 0, F.concat(F.encode(F.lit("rekord"), "UTF-8"), F.expr("substring(wire, 7)"))).otherwise(F.col("wire")))
    return points.parse_wire(sent).select("page_id", "valid", "fingerprint", "url", F.when(F.col("valid"), F.size("items").cast("bigint")).alias("n"))


SCORE = "regexp_replace(regexp_replace(CASE WHEN score >= 0.1 THEN format('{:.6f}', score) WHEN score >= 0.01 THEN format('{:.7f}', score) ELSE format('{:.8f}', score) END, '0+$', ''), '\\.$', '')"


@query(sketches.RANKED + f", l AS (SELECT query_id, string_agg(pid || chr(9) || {SCORE} || chr(10), '' ORDER BY rank) AS t FROM r GROUP BY query_id), q AS (SELECT DISTINCT image_id AS query_id FROM sk), "
       "o AS (SELECT query_id, coalesce(t, '') AS t FROM q LEFT JOIN l USING (query_id)), n AS (SELECT *, strlen(t) AS n FROM o) "
       "SELECT query_id, format('00000000{:02x}{:02x}{:02x}{:02x}', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216) || lower(hex(encode(t))) AS wire FROM n")
def wire_replies(spark, sf_dir):
    """The binary form of a search's answers."""
    asked = sketches.sketches(spark, sf_dir).select(F.col("image_id").alias("query_id")).distinct()
    return points.wire_replies(asked, sketches.image_search(spark, sf_dir)).select("query_id", F.lower(F.hex("wire")).alias("wire"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, event_type AS op, CASE WHEN value >= 10 THEN 'success' ELSE 'failure' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def log_files(spark, sf_dir):
    """The request log written by date, operation and outcome, and counted from its folders."""
    from .relation_queries import request_rows
    points.write_log(request_rows(table(spark, sf_dir, "events")).select("date", "op", "outcome", "event_id"), at := _place(spark))
    return spark.read.option("basePath", at).parquet(at).groupBy(F.col("date").cast("string").alias("date"), "op", "outcome").agg(F.count("*").alias("n"))
