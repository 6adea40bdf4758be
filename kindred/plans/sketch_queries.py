"""Queries on sketches: joins, search, index tools. Sketches are 64 sign bits of embeddings in four blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kindred.functions import bits
from kindred.functions.bits import BLOCKS, hex_sketch, pack_bits, sign_bits
from kindred.operators import ordering, search, sorted_index, store
from kindred.operators.hamming_join import block_rows, hamming_join
from kindred.operators.sampling import greedy_dedup
from kindred.operators.text_sketch import word_sketches

from .registry import query, table

#: Planted copies lie this far from their image, by copy number, so ids never meet.
FAR = 10_000_000

SKETCHES = "sk AS (SELECT vec_id, vec_id // 5 + 1 AS image_id, vec_id % 5 AS ord, " + ", ".join(
    f"list_sum(list_transform(range(16), lambda i: CASE WHEN embedding[{16 * k} + i + 1] > 0 THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT AS b{k}"
    for k in range(4)) + " FROM embeddings)"
PLANTED = SKETCHES + ", pl AS (SELECT image_id, ord, b0, b1, b2, b3 FROM sk UNION ALL SELECT image_id + 10000000 * j, ord, " + ", ".join(
    f"xor(b{k}, coalesce(list_sum(list_transform(range(j + 2 * ord), lambda t: CASE WHEN ((vec_id * 7 + 13 * t) % 64) // 16 = {k} "
    "THEN 1::BIGINT << ((vec_id * 7 + 13 * t) % 16)::INT ELSE 0 END)), 0)::BIGINT) AS b" + str(k) for k in range(4)
) + " FROM sk, (SELECT unnest(range(1, 11)) AS j))"
HAMMING = " + ".join(f"bit_count(xor(q.b{k}, d.b{k}))::BIGINT" for k in range(4))
HITS = PLANTED + (", hit AS (SELECT q.image_id AS query_id, q.ord AS q_ord, d.image_id, d.ord, " + HAMMING +
                  " AS distance FROM sk q, pl d WHERE " + HAMMING + " <= {t})")
IMAGES = (", im AS (SELECT image_id, count(*) AS siftnum, CASE WHEN image_id % 7 = 3 THEN '' ELSE 'p' || (image_id % 1000) END AS pid "
          "FROM pl GROUP BY image_id)")
RANKED = ("WITH " + HITS.format(t=7) + IMAGES + ", v AS (SELECT query_id, image_id, count(*) AS votes FROM hit GROUP BY ALL), "
          "s AS (SELECT query_id, image_id, pid, votes, least(1.0::DOUBLE, votes::DOUBLE / siftnum) AS score FROM v JOIN im USING (image_id) "
          "WHERE siftnum >= 2 AND votes > 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank "
          "FROM s WHERE score > 0.05 AND pid <> '') ")


def sketches(spark, sf_dir):
    rows = ordering.spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id"))
    flags = sign_bits(F.col("embedding"))
    return rows.select(
        "vec_id", (F.floor(F.col("vec_id") / 5) + 1).alias("image_id"), (F.col("vec_id") % 5).alias("ord"),
        *[_never_null(pack_bits(flags, k, 16)).alias(b) for k, b in enumerate(BLOCKS)])


def _never_null(block):
    """So that joins on blocks add no filter that computes them again."""
    return F.coalesce(block, F.lit(0).cast("bigint"))


def planted(spark, sf_dir):
    """The sketches and ten copies of each, with j + 2 * ord flipped bits in copy j."""
    base = sketches(spark, sf_dir)
    copies = base.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("at", F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("j") + 2 * F.col("ord") - 1), lambda t: (F.col("vec_id") * 7 + 13 * t) % 64))
    zero = F.lit(0).cast("bigint")
    mask = lambda k: F.aggregate("at", zero, lambda s, p: s + F.when(
        F.floor(p / 16) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % 16).cast("int"))).otherwise(zero))
    copies = copies.select((F.col("image_id") + F.col("j") * FAR).alias("image_id"), "ord",
                           *[_never_null(F.col(b).bitwiseXOR(mask(k))).alias(b) for k, b in enumerate(BLOCKS)])
    return base.drop("vec_id").unionByName(copies)


def images_of(rows):
    i = F.col("image_id")
    pid = F.when(i % 7 == 3, "").otherwise(F.concat(F.lit("p"), (i % 1000).cast("string")))
    return rows.groupBy("image_id").agg(F.count("*").alias("siftnum")).withColumn("pid", pid)


def images(spark, sf_dir):
    return images_of(planted(spark, sf_dir))


def hits(spark, sf_dir, threshold):
    return hamming_join(sketches(spark, sf_dir).drop("vec_id"), planted(spark, sf_dir), threshold)


@query("WITH " + PLANTED + " SELECT image_id AS key, ord, b0, b1, b2, b3 FROM pl")
def scan_points(spark, sf_dir):
    return planted(spark, sf_dir).withColumnRenamed("image_id", "key")


@query("WITH " + PLANTED + " SELECT image_id AS key, ord, b0 FROM pl WHERE b0 BETWEEN 16384 AND 32767")
def range_scan(spark, sf_dir):
    """A key range of the sorted index on disk: the filter reaches the scan, which skips other files and row groups."""
    return sorted_index.between(spark, _saved(spark, sf_dir, ["b0"]), "b0", 16384, 32767).select(F.col("image_id").alias("key"), "ord", "b0")


def _saved(spark, sf_dir, blocks=BLOCKS):
    path = f"{ordering.shared_folder(spark)}/sorted-{uuid.uuid4().hex}"
    sorted_index.save(planted(spark, sf_dir), path, blocks)
    return path


@query("WITH " + PLANTED + " SELECT CASE WHEN image_id < 50000000 THEN 0 ELSE 1 END AS generation, CASE WHEN image_id < 50000000 THEN image_id ELSE image_id + 7 END AS key, ord, b1 FROM pl")
def index_generations(spark, sf_dir):
    """Two generations of a sorted index on disk, the keys of the second moved."""
    path, rows = f"{ordering.shared_folder(spark)}/sorted-{uuid.uuid4().hex}", planted(spark, sf_dir)
    for g, part in ((0, F.col("image_id") < 50_000_000), (1, F.col("image_id") >= 50_000_000)):
        sorted_index.save_generation(rows.where(part), path, g, "image_id", 7 * g, ["b1"])
    return sorted_index.generations(spark, path, "b1").select(F.col("generation").cast("int").alias("generation"), F.col("image_id").alias("key"), "ord", "b1")


@query("WITH " + PLANTED + " SELECT true AS whole, count(*) AS n FROM pl WHERE b0 BETWEEN 16384 AND 32767")
def reloaded_index(spark, sf_dir):
    """Whether all orders of an index are there once its files are looked up again, and the rows of a key range."""
    path = _saved(spark, sf_dir)
    whole = sorted_index.reload(spark, path)
    return sorted_index.between(spark, path, "b0", 16384, 32767).agg(F.lit(whole).alias("whole"), F.count("*").alias("n"))


@query("WITH " + PLANTED + " SELECT format('{:04x}{:04x}{:04x}{:04x}', b0, b1, b2, b3) AS sketch, image_id AS key FROM pl")
def print_points(spark, sf_dir):
    return planted(spark, sf_dir).select(hex_sketch([F.col(b) for b in BLOCKS], 16).alias("sketch"), F.col("image_id").alias("key"))


def _hit_columns(df):
    return df.select(F.col("q_image_id").alias("query_id"), "q_ord", "image_id", "ord", "distance")


@query("WITH " + HITS.format(t=3) + " SELECT query_id, q_ord, image_id, ord, distance FROM hit")
def hamming_join_t3(spark, sf_dir):
    return _hit_columns(hits(spark, sf_dir, 3))


@query("WITH " + HITS.format(t=7) + " SELECT query_id, q_ord, image_id, ord, distance FROM hit")
def hamming_join_t7(spark, sf_dir):
    return _hit_columns(hits(spark, sf_dir, 7))


@query("WITH " + HITS.format(t=3) + " SELECT DISTINCT query_id, q_ord, image_id FROM hit")
def sorted_block_search(spark, sf_dir):
    """The offline search: distinct image keys of each query sketch within 3 bits, from the sorted index on disk."""
    found = sorted_index.search(sketches(spark, sf_dir).drop("vec_id"), _saved(spark, sf_dir), 3)
    return _hit_columns(found).select("query_id", "q_ord", "image_id").distinct()


@query("WITH " + HITS.format(t=7) + " SELECT query_id, image_id, count(*) AS votes FROM hit GROUP BY ALL")
def vote_score(spark, sf_dir):
    return search.votes(hits(spark, sf_dir, 7))


@query(RANKED + "SELECT query_id, image_id, pid, votes, score, rank FROM r")
def image_search(spark, sf_dir):
    held = ordering.checkpointed(planted(spark, sf_dir))  # searched, and counted by image
    return search.image_search(sketches(spark, sf_dir).drop("vec_id"), held, images_of(held))


@query(RANKED + "SELECT query_id, image_id, pid, votes, score FROM r WHERE rank = 1")
def best_match(spark, sf_dir):
    return search.best_match(image_search(spark, sf_dir))


@query(RANKED + ", l AS (SELECT query_id, count(*) AS n, string_agg(pid || chr(9) || format('{:.4f}', score), chr(9) ORDER BY rank) AS t FROM r GROUP BY query_id), "
       "q AS (SELECT DISTINCT image_id AS query_id FROM sk), o AS (SELECT query_id, 'REPLY_OK' || chr(9) || coalesce(n, 0) || coalesce(chr(9) || t, '') || chr(9) || chr(10) AS line FROM q LEFT JOIN l USING (query_id)) "
       "SELECT query_id, lpad(strlen(line)::VARCHAR, 10, '0') || line AS reply FROM o")
def format_reply(spark, sf_dir):
    asked = sketches(spark, sf_dir).select(F.col("image_id").alias("query_id")).distinct()
    return search.reply_lines(asked, image_search(spark, sf_dir))


@query("WITH " + HITS.format(t=3) + IMAGES + ", n AS (SELECT query_id AS a, image_id AS b, count(*) AS matches, sum(distance)::BIGINT AS total FROM hit GROUP BY ALL) "
       "SELECT a, b, matches, total, (matches::DOUBLE / x.siftnum + matches::DOUBLE / y.siftnum) / 2 AS similarity FROM n JOIN im x ON a = x.image_id JOIN im y ON b = y.image_id")
def image_pair_similarity(spark, sf_dir):
    return search.pair_similarity(hits(spark, sf_dir, 3), images(spark, sf_dir))


@query("WITH " + HITS.format(t=7) + IMAGES + ", f AS (SELECT query_id, image_id, ord % 2 AS frame, count(*) AS votes FROM hit GROUP BY ALL) "
       "SELECT query_id, frame, pid, least(1.0::DOUBLE, votes::DOUBLE / siftnum) AS score FROM f JOIN im USING (image_id) WHERE votes > 1 AND pid <> ''")
def merge_frames(spark, sf_dir):
    """Results of two frames (even and odd sketches) side by side; a pid may appear once a frame."""
    found = hits(spark, sf_dir, 7)
    frames = [search.votes(found.where(F.col("ord") % 2 == f)).withColumn("frame", F.lit(f).cast("bigint")) for f in (0, 1)]
    return frames[0].unionByName(frames[1]).join(images(spark, sf_dir), "image_id").where("votes > 1 AND pid <> ''").select(
        "query_id", "frame", "pid", F.least(F.lit(1.0), F.col("votes") / F.col("siftnum")).alias("score"))


@query("WITH " + HITS.format(t=3) + " SELECT DISTINCT query_id, CASE WHEN image_id < 50000000 THEN 0 ELSE 1 END::BIGINT AS generation, image_id FROM hit")
def two_generation_search(spark, sf_dir):
    """The current and the previous index (by image id) are searched apart and their results put together."""
    q, db = sketches(spark, sf_dir).drop("vec_id"), planted(spark, sf_dir)
    parts = [hamming_join(q, db.where(cond), 3).select(F.col("q_image_id").alias("query_id"), F.lit(g).cast("bigint").alias("generation"), "image_id").distinct()
             for g, cond in ((0, "image_id < 50000000"), (1, "image_id >= 50000000"))]
    return parts[0].unionByName(parts[1])


@query("WITH " + PLANTED + " SELECT image_id AS key, ord, b2, row_number() OVER (ORDER BY b2, b3, b0, b1, image_id, ord) - 1 AS position FROM pl")
def rotated_sort(spark, sf_dir):
    placed = ordering.positions(planted(spark, sf_dir), *ordering.rotated(list(BLOCKS), 2), F.col("image_id"), F.col("ord"))
    return placed.select(F.col("image_id").alias("key"), "ord", "b2", "position")


@query("WITH " + PLANTED + " SELECT image_id AS key, ord, b0, row_number() OVER (ORDER BY b0, b1, b2, b3, image_id, ord) - 1 AS position FROM pl")
def merge_indexes(spark, sf_dir):
    """Two indexes as one sorted index: union and order, the ties by key."""
    p = planted(spark, sf_dir)
    both = p.where(F.col("image_id") < FAR).unionByName(p.where(F.col("image_id") >= FAR))
    placed = ordering.positions(both, *ordering.rotated(list(BLOCKS), 0), F.col("image_id"), F.col("ord"))
    return placed.select(F.col("image_id").alias("key"), "ord", "b0", "position")


@query("WITH " + PLANTED + ", p AS (SELECT image_id AS key, ord, b1, row_number() OVER (ORDER BY b1, b2, b3, b0, image_id, ord) - 1 AS position FROM pl) SELECT * FROM p WHERE position % 16 = 0")
def sample_every_n(spark, sf_dir):
    picked = ordering.every_nth(planted(spark, sf_dir), 16, *ordering.rotated(list(BLOCKS), 1), F.col("image_id"), F.col("ord"))
    return picked.select(F.col("image_id").alias("key"), "ord", "b1", "position")


@query("WITH " + PLANTED + " SELECT block, key, count(*) AS n FROM (SELECT unnest([0, 1, 2, 3])::BIGINT AS block, unnest([b0, b1, b2, b3]) AS key FROM pl) GROUP BY ALL")
def block_histogram(spark, sf_dir):
    rows = block_rows(planted(spark, sf_dir)).select(F.col("block").cast("bigint").alias("block"), F.col("block_key").alias("key"))
    return rows.groupBy("block", "key").agg(F.count("*").alias("n"))


@query("WITH " + PLANTED + ", h AS (SELECT b0 AS key, count(*) AS n FROM pl GROUP BY b0) SELECT key, n, row_number() OVER (ORDER BY n DESC, key) - 1 AS position FROM h")
def sort_bins(spark, sf_dir):
    h = planted(spark, sf_dir).groupBy(F.col("b0").alias("key")).agg(F.count("*").alias("n"))
    return ordering.positions(h, F.desc("n"), F.col("key"))


@query("WITH " + PLANTED + " SELECT min(image_id) AS min_key, max(image_id) AS max_key, count(*) AS n FROM pl")
def index_conf(spark, sf_dir):
    return planted(spark, sf_dir).agg(F.min("image_id").alias("min_key"), F.max("image_id").alias("max_key"), F.count("*").alias("n"))


@query("WITH " + PLANTED + IMAGES + ", s AS (SELECT (image_id << 8) + ord AS sketch_id, b0, b1, b2, b3 FROM pl) "
       "SELECT im.image_id, sketch_id, b0, b1, b2, b3 FROM (SELECT image_id, unnest(range(siftnum)) AS i FROM im) im JOIN s ON (im.image_id << 8) + i = sketch_id")
def sketches_of_image(spark, sf_dir):
    stored = planted(spark, sf_dir).select(store.sketch_id(F.col("image_id"), F.col("ord")).alias("sketch_id"), *BLOCKS)
    ids = images(spark, sf_dir).select("image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("siftnum") - 1)).alias("i"))
    return ids.select("image_id", store.sketch_id(F.col("image_id"), F.col("i")).alias("sketch_id")).join(stored, "sketch_id")


@query("WITH " + PLANTED + " SELECT q.image_id, q.ord, " + HAMMING + " AS distance FROM pl q JOIN sk d ON q.image_id % 10000000 = d.image_id AND q.ord = d.ord")
def hamming_distance(spark, sf_dir):
    a = planted(spark, sf_dir).withColumn("base", F.col("image_id") % FAR)
    b = sketches(spark, sf_dir).select(F.col("image_id").alias("base"), "ord", *[F.col(x).alias(f"d{x}") for x in BLOCKS])
    return a.join(b, ["base", "ord"]).select("image_id", "ord", bits.hamming(
        [F.col(x) for x in BLOCKS], [F.col(f"d{x}") for x in BLOCKS]).alias("distance"))


@query("WITH " + PLANTED + " SELECT q.image_id, q.ord, (" + " + ".join(
    f"list_sum(list_transform(range(16), lambda i: (xor(q.b{k}, d.b{k}) >> i::INT & 1) * ({16 * k} + i + 1)))" for k in range(4)) +
    ")::BIGINT AS distance FROM pl q JOIN sk d ON q.image_id % 10000000 = d.image_id AND q.ord = d.ord")
def weighted_hamming(spark, sf_dir):
    a = planted(spark, sf_dir).withColumn("base", F.col("image_id") % FAR)
    b = sketches(spark, sf_dir).select(F.col("image_id").alias("base"), "ord", *[F.col(x).alias(f"d{x}") for x in BLOCKS])
    return a.join(b, ["base", "ord"]).select("image_id", "ord", bits.weighted_hamming(
        [F.col(x) for x in BLOCKS], [F.col(f"d{x}") for x in BLOCKS], range(1, 65), 16).alias("distance"))


@query("WITH RECURSIVE " + PLANTED + ", o AS (SELECT image_id % 10000000 AS record, image_id, ord, b0, b1, b2, b3, row_number() OVER (PARTITION BY image_id % 10000000 ORDER BY image_id, ord) AS i FROM pl), "
       "f(record, i, kept) AS (SELECT DISTINCT record, 0::BIGINT, []::BIGINT[][] FROM o UNION ALL SELECT f.record, o.i, "
       "CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k[1], b0)) + bit_count(xor(k[2], b1)) + bit_count(xor(k[3], b2)) + bit_count(xor(k[4], b3)) <= 7)) = 0 "
       "THEN list_append(kept, [b0, b1, b2, b3, image_id, ord]) ELSE kept END FROM f JOIN o ON o.record = f.record AND o.i = f.i + 1), "
       "z AS (SELECT record, kept FROM f WHERE i = (SELECT max(i) FROM o WHERE o.record = f.record)), u AS (SELECT record, unnest(kept) AS k FROM z) "
       "SELECT record, k[5] AS image_id, k[6] AS ord FROM u")
def record_dedup(spark, sf_dir):
    """Order-dependent greedy dedup of each image's sketches and their planted copies within 7 bits."""
    rows = planted(spark, sf_dir).withColumn("record", F.col("image_id") % FAR)
    return greedy_dedup(rows, "record", ["image_id", "ord"], BLOCKS, 7).select("record", "image_id", "ord")


# documents: 128-bit SimHash of words, in four blocks of 32 bits
SIMHASH = ("tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents), "
           "w AS (SELECT doc_id, " + ", ".join(f"('0x' || substr(md5(t), {8 * k + 1}, 8))::BIGINT AS w{k}" for k in range(4)) + " FROM tok), "
           "v AS (SELECT doc_id, " + ", ".join(
               f"sum(2 * (w{k} >> {i} & 1) - 1) AS v{32 * k + i}" for k in range(4) for i in range(32)) + " FROM w GROUP BY doc_id), "
           "ds AS (SELECT doc_id, " + ", ".join("(" + " + ".join(
               f"CASE WHEN v{32 * k + i} > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) + f")::BIGINT AS b{k}" for k in range(4)) + " FROM v)")


def document_sketches(spark, sf_dir):
    docs = ordering.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id"), F.xxhash64("text"))
    return word_sketches(docs, "doc_id", "text")


@query("WITH " + SIMHASH + " SELECT doc_id, b0, b1, b2, b3 FROM ds")
def simhash(spark, sf_dir):
    return document_sketches(spark, sf_dir)


@query("WITH " + SIMHASH + ", c AS (SELECT min(doc_id) AS doc_id, b0, b1, b2, b3 FROM ds GROUP BY ALL) SELECT q.doc_id AS a, d.doc_id AS b, " + HAMMING + " AS distance FROM c q, c d WHERE q.doc_id < d.doc_id AND " + HAMMING + " <= 7 "
       "UNION ALL SELECT c.doc_id, ds.doc_id, 0 FROM ds JOIN c USING (b0, b1, b2, b3) WHERE ds.doc_id <> c.doc_id")
def document_near_pairs(spark, sf_dir):
    """Pairs within 7 of 128 bits between classes of equal sketches, each named by its least id, and at distance 0
    every other document with its class: the same join on 32-bit blocks, and no link lost."""
    ds = ordering.checkpointed(document_sketches(spark, sf_dir))
    classes = ds.groupBy(*BLOCKS).agg(F.min("doc_id").alias("a"))
    found = hamming_join(*[classes.withColumnRenamed("a", "doc_id")] * 2, 7, bits=32)
    pairs = found.where("q_doc_id < doc_id").select(F.col("q_doc_id").alias("a"), F.col("doc_id").alias("b"), "distance")
    members = ds.join(classes, list(BLOCKS)).where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(0).cast("bigint").alias("distance"))
    return pairs.unionByName(members)
