"""Queries on the driver's plain tables: keys, groups, urls, logs, store mutations, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import dedup, ordering, sampling, store
from kindred.operators.versions import VersionedStore
from kindred.streaming import requests

from .registry import query, table

#: documents as images: the pid is source and language, the fingerprint 64 bits of the text's md5.
DOCS = ("d AS (SELECT doc_id AS image_id, coalesce(source, '') || '/' || coalesce(lang, '') AS pid, substr(md5(coalesce(text, '')), 1, 16) AS fingerprint, "
        "n_chars AS size, text FROM documents)")


def docs(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").alias("image_id"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))).alias("pid"),
                    F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16).alias("fingerprint"), F.col("n_chars").alias("size"))


@query("SELECT c_custkey AS key, c_name AS pid FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def scan_keypid(spark, sf_dir):
    """Two id files one after the other, the keys of the second moved."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("pid"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("pid"))
    return a.unionByName(sampling.rebase(b, "key", 1_000_000))


@query("SELECT page_id, url, strlen(url) <= 400 AND length(html) // 100 <= 200 AS valid FROM pages")
def validate_records(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", requests.valid_records(F.col("url"), F.floor(F.length("html") / 100)).alias("valid"))


COMMAND = "CASE WHEN event_id % 3 = 0 THEN 'delete p' || user_id WHEN event_id % 3 = 1 THEN 'query http://a/' || event_type ELSE 'insert http://a/' || event_type || ' p' || user_id END"


def commands(df):
    e = F.col("event_id") % 3
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    return df.withColumn("command", F.when(e == 0, F.concat(F.lit("delete p"), user)).when(
        e == 1, F.concat(F.lit("query http://a/"), kind)).otherwise(F.concat(F.lit("insert http://a/"), kind, F.lit(" p"), user)))


@query(f"WITH c AS (SELECT event_id, string_split({COMMAND}, ' ') AS t FROM events) SELECT event_id, t[1] AS op, CASE WHEN t[1] = 'delete' THEN '' ELSE coalesce(t[2], '') END AS url, "
       "CASE WHEN t[1] = 'delete' THEN coalesce(t[2], '') ELSE coalesce(t[3], '') END AS pid, true AS valid FROM c")
def parse_commands(spark, sf_dir):
    return requests.parse_commands(commands(table(spark, sf_dir, "events"))).select("event_id", "op", "url", "pid", "valid")


LOG = "log AS (SELECT strftime(ts, '%Y-%m-%d') AS date, event_type AS op, CASE WHEN value >= 10 THEN 'success' ELSE 'failure' END AS outcome, ts, event_id, value FROM events)"


def request_rows(df):
    return df.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).withColumn("op", F.col("event_type")).withColumn(
        "outcome", F.when(F.col("value") >= 10, "success").otherwise("failure"))


@query(f"WITH {LOG} SELECT date, op, outcome, event_id, value FROM log")
def request_log(spark, sf_dir):
    return request_rows(table(spark, sf_dir, "events")).select("date", "op", "outcome", "event_id", "value")


@query(f"WITH {LOG} SELECT op, outcome, count(*) AS n FROM log GROUP BY ALL")
def server_stats(spark, sf_dir):
    return requests.counters(request_rows(table(spark, sf_dir, "events")), "op", "outcome")


@query("SELECT o_orderkey + 100000 AS key, o_custkey FROM orders")
def rebase_keys(spark, sf_dir):
    return sampling.rebase(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey"), "key", 100_000)


@query("SELECT o_orderkey - 700 AS key, o_custkey FROM orders WHERE o_orderkey >= 700")
def expire_keys(spark, sf_dir):
    return sampling.expire(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey"), "key", 700)


@query("SELECT p_partkey, p_brand, p_size::BIGINT AS p_size FROM part")
def attrib_project(spark, sf_dir):
    return sampling.project_attributes(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"]).withColumn("p_size", F.col("p_size").cast("bigint"))


@query(f"WITH {DOCS} SELECT image_id, fingerprint FROM d WHERE fingerprint IN (SELECT substr(md5(text), 1, 16) FROM documents WHERE source = 'src0')")
def exists_fingerprint(spark, sf_dir):
    d = docs(spark, sf_dir)
    known = d.where(F.col("pid").startswith("src0/")).select("fingerprint").distinct()
    return d.join(known, "fingerprint", "left_semi").select("image_id", "fingerprint")


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '://[^/]*(/.*)$', 1) LIKE '/en/%'")
def url_prefix_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(F.regexp_extract("url", "://[^/]*(/.*)$", 1).startswith("/en/"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) * 8 // (SELECT count(*) FROM documents))::BIGINT AS part FROM documents")
def thread_split(spark, sf_dir):
    return ordering.split_evenly(table(spark, sf_dir, "documents").select("doc_id"), 8, F.col("doc_id")).select("doc_id", "part")


@query("SELECT o_orderkey, c_name AS pid FROM orders JOIN customer ON o_custkey = c_custkey")
def map_keys_to_pids(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_name").alias("pid"))


@query(f"WITH {DOCS}, p AS (SELECT DISTINCT pid FROM d WHERE pid LIKE '%/de') SELECT pid, image_id FROM p JOIN d USING (pid)")
def images_of_pid(spark, sf_dir):
    d = docs(spark, sf_dir)
    asked = d.where(F.col("pid").endswith("/de")).select("pid").distinct()
    return asked.join(d, "pid").select("pid", "image_id")


@query(f"WITH {DOCS}, f AS (SELECT DISTINCT fingerprint FROM d WHERE pid LIKE 'src1/%') SELECT fingerprint, image_id FROM f JOIN d USING (fingerprint)")
def fingerprint_lookup(spark, sf_dir):
    d = docs(spark, sf_dir)
    asked = d.where(F.col("pid").startswith("src1/")).select("fingerprint").distinct()
    return asked.join(d, "fingerprint").select("fingerprint", "image_id")


@query("WITH l AS (SELECT doc_id, max(quality)::BIGINT AS quality, max(toxic)::BIGINT AS toxic FROM labels GROUP BY doc_id) SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, coalesce(source, '') AS pid FROM documents LEFT JOIN l USING (doc_id)")
def attrib_lookup(spark, sf_dir):
    long = lambda c: F.max(c).cast("bigint").alias(c)
    held = table(spark, sf_dir, "labels").groupBy("doc_id").agg(long("quality"), long("toxic"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(held, "doc_id", "left").select(
        "doc_id", F.coalesce("quality", F.lit(0)).cast("bigint").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("bigint").alias("toxic"), F.coalesce("source", F.lit("")).alias("pid"))


GROUPS = f"{DOCS}, g AS (SELECT fingerprint, count(*) AS n, min(image_id) AS first FROM d GROUP BY fingerprint)"


@query(f"WITH {GROUPS} SELECT fingerprint, image_id, n, first FROM d JOIN g USING (fingerprint) WHERE n > 1")
def expand_duplicates(spark, sf_dir):
    """Each key with the group that shares its fingerprint: membership instead of all pairs."""
    return dedup.membership(docs(spark, sf_dir), "fingerprint", "image_id", 2)


@query(f"WITH {GROUPS} SELECT fingerprint, -1::BIGINT AS image_id, fingerprint || chr(9) || n AS line FROM g WHERE n > 1 UNION ALL SELECT fingerprint, image_id, pid FROM d JOIN g USING (fingerprint) WHERE n > 1")
def dup_groups(spark, sf_dir):
    return dedup.group_lines(docs(spark, sf_dir), "fingerprint", "image_id", "pid")


@query(f"WITH {GROUPS} SELECT fingerprint, n, first FROM g")
def fp_groups(spark, sf_dir):
    return dedup.groups(docs(spark, sf_dir), "fingerprint", "image_id")


@query(f"WITH {GROUPS} SELECT fingerprint, n FROM g")
def fp_counts(spark, sf_dir):
    return dedup.groups(docs(spark, sf_dir), "fingerprint", "image_id").select("fingerprint", "n")


@query(f"WITH {GROUPS} SELECT image_id, fingerprint, image_id > first AS seen FROM d JOIN g USING (fingerprint)")
def first_seen(spark, sf_dir):
    return dedup.first_seen(docs(spark, sf_dir), "fingerprint", "image_id").select("image_id", "fingerprint", "seen")


@query(f"WITH {GROUPS} SELECT image_id, CAST(sum(CASE WHEN image_id = first THEN 1 ELSE 0 END) OVER o AS BIGINT) AS distinct_so_far, (sum(CASE WHEN image_id = first THEN 1 ELSE 0 END) OVER o)::DOUBLE / row_number() OVER o AS ratio FROM d JOIN g USING (fingerprint) WINDOW o AS (ORDER BY image_id)")
def running_distinct_ratio(spark, sf_dir):
    seen = dedup.first_seen(docs(spark, sf_dir), "fingerprint", "image_id").select("image_id", "seen")
    r = dedup.running_ratio(ordering.positions(seen, F.col("image_id")), "seen")
    return r.select("image_id", "distinct_so_far", (F.col("distinct_so_far") / (F.col("position") + 1)).alias("ratio"))


@query("SELECT p_brand, count(p_size) AS n, sum(p_size)::BIGINT AS total, sum(p_size * p_size)::BIGINT AS squares, min(p_size)::BIGINT AS least, max(p_size)::BIGINT AS greatest, round(avg(p_size), 6) AS mean, "
       "round(coalesce(stddev_samp(p_size), 0), 6) AS deviation FROM part GROUP BY p_brand")
def stat_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("bigint"))
    return dedup.statistics(rows, "p_size", "p_brand").withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query(f"WITH {DOCS}, f AS (SELECT image_id, fingerprint FROM d) SELECT image_id, fingerprint, row_number() OVER (ORDER BY fingerprint, image_id) - 1 AS position FROM f")
def sort_manifest(spark, sf_dir):
    """By fingerprint as unsigned number, then key; fingerprints are longs with the sign bit flipped for the order."""
    from kindred.functions.bits import unsigned_order
    signed = F.conv("fingerprint", 16, -10).cast("bigint")
    placed = ordering.positions(docs(spark, sf_dir).select("image_id", "fingerprint", signed.alias("signed")), unsigned_order(F.col("signed")), F.col("image_id"))
    return placed.select("image_id", "fingerprint", "position")


@query(f"WITH {DOCS}, f AS (SELECT image_id, pid FROM d) SELECT image_id, pid, row_number() OVER (ORDER BY pid, image_id) - 1 AS position FROM f")
def sort_pids(spark, sf_dir):
    return ordering.positions(docs(spark, sf_dir).select("image_id", "pid"), F.col("pid"), F.col("image_id"))


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN split_part(split_part(regexp_extract(url, '/([^/]*)$', 1), '.', 1), '?', 1) ELSE '' END AS pid FROM pages")
def pid_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.pid_from_url(F.col("url")).alias("pid"))


@query("WITH l AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS t FROM pages) SELECT page_id, CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) WHEN contains(t, '&') THEN regexp_extract(t, '^(.*)&', 1) ELSE t END AS pid FROM l")
def pid_from_url_v1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.pid_from_url_v1(F.col("url")).alias("pid"))


@query("SELECT event_id, strftime(ts, '%H') || '/' || (minute(ts) // 5) AS path FROM events")
def time_bucket_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.time_path(F.col("ts")).alias("path"))


NAMES = ", ".join(f"'{n}'" for n in text.STATUS)


@query(f"SELECT event_id, coalesce([{NAMES}][(user_id % 10)::INT + 1], '') AS status FROM events")
def status_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.status_name((F.col("user_id") % 10).cast("int")).alias("status"))


SIDE = "CASE WHEN greatest(w, h) <= 120 OR greatest(w, h) // least(w, h) >= 100 THEN {x} WHEN greatest(w, h) // least(w, h) > 4 THEN CASE WHEN {long} THEN greatest(w, h) // least(w, h) * 100 ELSE 100 END ELSE CASE WHEN {long} THEN 120 ELSE least(w, h) * 120 // greatest(w, h) END END::BIGINT"


@query("WITH s AS (SELECT p_partkey, p_size::BIGINT * 13 AS w, p_partkey % 997 + 5 AS h FROM part) SELECT p_partkey, "
       f"({SIDE.format(x='w', long='w >= h')}) AS width, ({SIDE.format(x='h', long='w < h')}) AS height FROM s".replace("END::BIGINT", "END"))
def resize_dims(spark, sf_dir):
    w, h = text.resized(F.col("p_size").cast("bigint") * 13, F.col("p_partkey") % 997 + 5)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))


# mutations: requests are the events, ids of parts are free again
FREE = "fr AS (SELECT p_partkey + 10000000 AS image_id, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part), m AS (SELECT count(*) AS n FROM fr)"
START = 20_000_001


def free_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 10_000_000).alias("image_id"))


@query(f"WITH a AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events), {FREE} "
       f"SELECT event_id, user_id, coalesce(image_id, a.position - n + {START}) AS image_id FROM a LEFT JOIN fr USING (position), m")
def allocate_ids(spark, sf_dir):
    return store.allocate_ids(table(spark, sf_dir, "events").select("event_id", "user_id"), free_ids(spark, sf_dir), START, F.col("event_id"))


def _word(seed, k):
    return F.conv(F.substring(F.md5(seed), 4 * k + 1, 4), 16, 10).cast("bigint").alias(f"b{k}")


_WORDS = ", ".join(f"('0x' || substr(md5(seed), {4 * k + 1}, 4))::BIGINT AS b{k}" for k in range(4))
HELD = (f"{DOCS}, im AS (SELECT image_id, pid, fingerprint, image_id % 3 + 1 AS siftnum FROM d), "
        f"sk AS (SELECT (image_id << 8) + ord AS sketch_id, {_WORDS} FROM (SELECT image_id, ord, fingerprint || ':' || ord AS seed FROM (SELECT image_id, fingerprint, unnest(range(siftnum)) AS ord FROM im))), {FREE}")


def held_store(spark, sf_dir):
    """documents as images, each with one to three sketches made from its fingerprint."""
    images = docs(spark, sf_dir).select("image_id", "pid", "fingerprint", (F.col("image_id") % 3 + 1).alias("siftnum"))
    marks = images.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("siftnum") - 1)))
    seed = F.concat_ws(":", "fingerprint", F.col("ord").cast("string"))
    marks = marks.select(store.sketch_id(F.col("image_id"), F.col("ord")).alias("sketch_id"), *[_word(seed, k) for k in range(4)])
    return store.Store(images, marks, free_ids(spark, sf_dir), START)


def saved_store(spark, sf_dir):
    """held_store() on disk, as changes find it."""
    kept = VersionedStore(spark, f"{ordering.shared_folder(spark)}/store-{uuid.uuid4().hex}")
    kept.create(held_store(spark, sf_dir))
    return kept


ADDED = (f"{HELD}, rq AS (SELECT event_id AS request, CASE WHEN user_id % 4 <> 0 THEN 'u' || user_id ELSE '' END AS pid, substr(md5(props), 1, 16) AS fingerprint FROM events), "
         f"ok AS (SELECT *, row_number() OVER (ORDER BY request) - 1 AS position FROM rq WHERE pid <> ''), "
         f"pl AS (SELECT request, pid, fingerprint, coalesce(image_id, ok.position - n + {START}) AS image_id FROM ok LEFT JOIN fr USING (position), m), "
         f"ns AS (SELECT (image_id << 8) + ord AS sketch_id, {_WORDS} FROM (SELECT image_id, ord, request || '/' || ord AS seed FROM (SELECT image_id, request, unnest(range(2)) AS ord FROM pl)))")


def _inserted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("event_id").alias("request"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise("").alias("pid"),
                       F.substring(F.md5("props"), 1, 16).alias("fingerprint"))
    marks = records.select("request", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("ord"))
    seed = F.concat_ws("/", F.col("request").cast("string"), F.col("ord").cast("string"))
    kept = saved_store(spark, sf_dir)
    replies = kept.insert(records, marks.select("request", "ord", *[_word(seed, k) for k in range(4)]))
    return VersionedStore(spark, kept.path).load(), replies


@query(f"WITH {ADDED} SELECT image_id, pid, fingerprint, siftnum FROM im UNION ALL SELECT image_id, pid, fingerprint, 2 FROM pl")
def insert_images(spark, sf_dir):
    return _inserted(spark, sf_dir)[0].attributes()


@query(f"WITH {ADDED}, al AS (SELECT * FROM sk UNION ALL SELECT * FROM ns) SELECT unnest([0, 1, 2, 3])::INT AS block, unnest([b0, b1, b2, b3]) AS block_key, sketch_id FROM al")
def insert_postings(spark, sf_dir):
    return _inserted(spark, sf_dir)[0].postings()


@query(f"WITH {ADDED} SELECT fingerprint, image_id FROM im UNION ALL SELECT fingerprint, image_id FROM pl")
def insert_fingerprints(spark, sf_dir):
    return _inserted(spark, sf_dir)[0].of_fingerprint()


@query(f"WITH {ADDED} SELECT image_id FROM fr WHERE image_id NOT IN (SELECT image_id FROM pl)")
def insert_free_ids(spark, sf_dir):
    return _inserted(spark, sf_dir)[0].free


@query(f"WITH {ADDED} SELECT request, image_id, 'REPLY_OK' AS reply FROM pl UNION ALL SELECT request, NULL, 'REPLY_INVALID_PID' FROM rq WHERE pid = ''")
def insert_replies(spark, sf_dir):
    return _inserted(spark, sf_dir)[1]


GONE = f"{HELD}, go AS (SELECT image_id FROM im WHERE pid LIKE 'src2/%')"


def _deleted(spark, sf_dir):
    kept = saved_store(spark, sf_dir)
    asked = kept.load().images.where(F.col("pid").startswith("src2/")).select("pid").distinct()
    replies = kept.delete_by_pid(asked.unionByName(spark.createDataFrame([("no such pid",)], "pid string")))
    return VersionedStore(spark, kept.path).load(), replies


@query(f"WITH {GONE} SELECT image_id, pid, fingerprint, siftnum FROM im WHERE pid NOT LIKE 'src2/%'")
def delete_by_pid(spark, sf_dir):
    return _deleted(spark, sf_dir)[0].attributes()


@query(f"WITH {GONE}, le AS (SELECT * FROM sk WHERE sketch_id >> 8 NOT IN (SELECT image_id FROM go)) SELECT unnest([0, 1, 2, 3])::INT AS block, unnest([b0, b1, b2, b3]) AS block_key, sketch_id FROM le")
def delete_postings(spark, sf_dir):
    return _deleted(spark, sf_dir)[0].postings()


@query(f"WITH {GONE} SELECT fingerprint, image_id FROM im WHERE pid NOT LIKE 'src2/%'")
def delete_fingerprints(spark, sf_dir):
    return _deleted(spark, sf_dir)[0].of_fingerprint()


@query(f"WITH {GONE} SELECT image_id FROM fr UNION ALL SELECT image_id FROM go")
def delete_free_ids(spark, sf_dir):
    return _deleted(spark, sf_dir)[0].free


@query(f"WITH {GONE} SELECT DISTINCT pid, 'REPLY_OK' AS reply FROM im WHERE pid LIKE 'src2/%' UNION ALL SELECT 'no such pid', 'REPLY_INVALID_PID'")
def delete_replies(spark, sf_dir):
    return _deleted(spark, sf_dir)[1]


@query(f"WITH {HELD}, rq AS (SELECT event_id % 3 AS round, 'u' || user_id AS pid, substr(md5(props), 1, 16) AS fingerprint FROM events), "
       "al AS (SELECT pid, fingerprint, siftnum, -1 AS round FROM im UNION ALL SELECT pid, fingerprint, 1, round FROM rq), "
       "go AS (SELECT 'u' || c_custkey AS pid, c_custkey % 3 AS after FROM customer WHERE c_custkey % 5 = 0) "
       "SELECT pid, CASE WHEN round = -1 AND pid LIKE 'src1/%' THEN upper(fingerprint) ELSE fingerprint END AS fingerprint, siftnum::BIGINT AS siftnum FROM al "
       "WHERE pid NOT LIKE 'src2/%' AND NOT EXISTS (SELECT 1 FROM go WHERE go.pid = al.pid AND al.round <= go.after)")
def store_history(spark, sf_dir):
    """Three rounds of inserts and deletes, a change of attributes and a compaction, each a version on disk; no ids, as these are used again."""
    kept = saved_store(spark, sf_dir)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pid"),
                                              F.substring(F.md5("props"), 1, 16).alias("fingerprint"))
    gone = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("pid"), (F.col("c_custkey") % 3).alias("after"))
    kept.delete_by_pid(docs(spark, sf_dir).where("pid LIKE 'src2/%'").select("pid"))
    for turn in range(3):
        records = e.where(F.col("request") % 3 == turn)
        marks = records.select("request", F.lit(0).cast("bigint").alias("ord"), *[_word(F.col("fingerprint"), k) for k in range(4)])
        kept.insert(records, marks)
        kept.delete_by_pid(gone.where(F.col("after") == turn).select("pid"))
        if turn == 1:
            kept.upsert(kept.load().images.where("pid LIKE 'src1/%'").select("image_id", F.upper("fingerprint").alias("fingerprint")))
            kept.compact()
    return VersionedStore(spark, kept.path).load().images.select("pid", "fingerprint", "siftnum")


@query(f"WITH {DOCS}, a AS (SELECT doc_id AS k FROM labels UNION ALL SELECT -1 UNION ALL SELECT NULL) SELECT k AS image_id, CASE WHEN k IS NULL THEN -1 WHEN k IN (SELECT image_id FROM d) THEN 1 ELSE 0 END::INT AS code FROM a")
def exists_image(spark, sf_dir):
    asked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id")).unionByName(spark.createDataFrame([(-1,), (None,)], "image_id bigint"))
    return store.existence(asked, docs(spark, sf_dir), "image_id")


@query(f"WITH {DOCS}, a AS (SELECT DISTINCT lang || '/' || source AS k FROM documents UNION ALL SELECT DISTINCT source || '/' || lang FROM documents) SELECT k AS pid, CASE WHEN k IS NULL THEN -1 WHEN k IN (SELECT pid FROM d) THEN 1 ELSE 0 END::INT AS code FROM a")
def exists_pid(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    name = lambda *c: t.select(F.concat(F.col(c[0]), F.lit("/"), F.col(c[1])).alias("pid")).distinct()
    return store.existence(name("lang", "source").unionByName(name("source", "lang")), docs(spark, sf_dir), "pid")


@query(f"WITH {DOCS} SELECT image_id, 1::BIGINT AS generation FROM d WHERE image_id % 2 = 0")
def rotate_generation(spark, sf_dir):
    return store.rotate(docs(spark, sf_dir).select("image_id", (F.col("image_id") % 2).alias("generation")))


@query("WITH l AS (SELECT doc_id, max(quality)::BIGINT AS quality FROM labels GROUP BY doc_id) SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality FROM (SELECT doc_id, -1::BIGINT AS q0 FROM documents) FULL JOIN l USING (doc_id)")
def upsert_attributes(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).cast("bigint").alias("quality"))
    new = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("bigint").alias("quality"))
    return store.upsert_attributes(base, new, "doc_id")


# streams: the events table read as a stream to its end
def _events(spark, sf_dir):
    whole = table(spark, sf_dir, "events")
    stream = requests.stream_table(spark, f"{sf_dir}/events.parquet", whole.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type AS op, CASE WHEN value >= 10 THEN 'success' ELSE 'failure' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def stream_counters(spark, sf_dir):
    return requests.drain(requests.counters(request_rows(_events(spark, sf_dir)), "op", "outcome"), "counters_" + uuid.uuid4().hex, "update", ["op", "outcome"])


@query("SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    w = requests.windowed(_events(spark, sf_dir), "ts", "event_type")
    done = requests.drain(w, "windows_" + uuid.uuid4().hex, "update", ["window", "event_type"])
    return done.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    """The first row of each user within a day's watermark; the one file is one micro-batch, so that is each user once."""
    first = requests.first_seen(_events(spark, sf_dir), "user_id", "ts", "1 day")
    return requests.drain(first.select("user_id"), "first_" + uuid.uuid4().hex)


@query(f"WITH c AS (SELECT event_id, {COMMAND} AS c FROM events) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN c ELSE c END AS command, event_id % 5 <> 0 AND event_id % 7 <> 0 AS complete FROM c")
def framed_commands(spark, sf_dir):
    """Messages with their length in front, some without a number there, some cut short."""
    c = commands(table(spark, sf_dir, "events")).select("event_id", "command")
    size = F.octet_length("command")
    head = F.when(F.col("event_id") % 5 == 0, F.lit("not digits")).otherwise(F.lpad(F.when(F.col("event_id") % 7 == 0, size + 1).otherwise(size).cast("string"), 10, "0"))
    sent = c.select("event_id", F.concat(head, "command", F.when(F.col("event_id") % 7 == 0, "").otherwise("beyond")).alias("message"))
    return requests.framed(sent).select("event_id", "command", "complete")


@query("WITH c AS (SELECT event_id, CASE event_id % 97 WHEN 3 THEN 'setimgpath /img' || user_id WHEN 5 THEN 'setindexserv host' || user_id WHEN 7 THEN 'help' WHEN 11 THEN 'info' END AS c FROM events WHERE event_id % 97 IN (3, 5, 7, 11)), "
       "g AS (SELECT event_id, substr(string_split(c, ' ')[1], 4) AS key, string_split(c, ' ')[2] AS value FROM c WHERE c LIKE 'set%') SELECT key, arg_max(value, event_id) AS value FROM g GROUP BY key")
def admin_commands(spark, sf_dir):
    at, user = F.col("event_id") % 97, F.col("user_id").cast("string")
    c = table(spark, sf_dir, "events").select("event_id", F.when(at == 3, F.concat(F.lit("setimgpath /img"), user)).when(at == 5, F.concat(F.lit("setindexserv host"), user)).when(
        at == 7, "help").when(at == 11, "info").alias("command")).where("command IS NOT NULL")
    return requests.admin_settings(c, "event_id")


@query("SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS keys FROM events GROUP BY event_type")
def index_cardinality(spark, sf_dir):
    return requests.cardinalities(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY event_id)) AS micros FROM events QUALIFY micros IS NOT NULL".replace("SELECT event_id, ", "SELECT event_id, (").replace(" AS micros FROM", ") / 1e6::DOUBLE AS elapsed FROM").replace("QUALIFY micros", "QUALIFY elapsed"))
def request_elapsed(spark, sf_dir):
    """Seconds from each request to the next one by id."""
    e = ordering.positions(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ended")), F.col("event_id"))
    before = e.select((F.col("position") + 1).alias("position"), F.col("ended").alias("began"))
    return requests.with_elapsed(e.join(before, "position"), "began", "ended").select("event_id", "elapsed")


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS frame FROM conversations) SELECT conv_id, turn, role, frame FROM r WHERE frame <= 10")
def first_frames(spark, sf_dir):
    """A conversation's turns as frames; a search looks at ten of them."""
    return sampling.first_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 10, "frame", ["conv_id"], F.col("turn"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def first_points(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(50)


@query("SELECT p_brand, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM part GROUP BY p_brand".replace("sum(count(*)) OVER ()::BIGINT", "(sum(count(*)) OVER ())::BIGINT"))
def bin_total(spark, sf_dir):
    """Bins of brands, and the total of their counts."""
    bins = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(bins.agg(F.sum("n").alias("total"))), F.lit(True))  # one row


@query("WITH i AS (SELECT DISTINCT o_custkey AS id FROM orders) SELECT id FROM i ORDER BY md5('11:' || id), id LIMIT 100")
def sample_queries(spark, sf_dir):
    """A hundred distinct ids, drawn evenly by a seeded order."""
    return sampling.sample_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id", 100, 11)
