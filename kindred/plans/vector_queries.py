"""Queries on vectors: descriptor functions, binarisers, metrics, k-NN, LSH, images from vectors."""

from __future__ import annotations

import random
import uuid
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from kindred.functions import descriptors as D
from kindred.functions.bits import delta_hamming as bits_delta
from kindred.functions.bits import pack_bits, texture_bits, trimmed_mean_bits
from kindred.functions.lsh import HyperPlane, Repeat, StableDistribution, Tail, Threshold, Trivial, Xor
from kindred.operators import images, knn, linear, ordering, pruned, sampling
from kindred.operators.index_store import FlatIndex, ForestIndex
from kindred.operators.lsh_model import RecallTable, apost_nearest, search_to_recall, train_probes

from .registry import query, table

DIM = 64
V = "list_transform(embedding, lambda x: x::DOUBLE)"
DESC = "list_transform(embedding, lambda x: abs(x::DOUBLE))"
INT = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
#: Projections are whole numbers drawn from a seed, so that hashes of whole vectors are exact.
draw = lambda seed, n=DIM, m=8: tuple(random.Random(seed).choices([x for x in range(-m, m + 1) if x], k=n))
WIDTH, BASE = 2048, 64
STABLE = [[(draw(100 * t + i), random.Random(7 * t + i).randrange(WIDTH)) for i in range(2)] for t in range(12)]
TABLES = [Repeat(tuple(Tail(StableDistribution(a, b, WIDTH), BASE) for a, b in digits), BASE) for digits in STABLE]
TREES = [[HyperPlane(draw(5000 + 100 * t + i)) for i in range(8)] for t in range(3)]
#: Rows over all trees at which a forest search stops, as a share of all rows of all trees: these vectors' neighbours lie far apart.
MOST_SHARE = 0.45


def project_sql(vec: str, a) -> str:
    return f"list_sum(list_transform(list_zip({vec}, {list(a)}), lambda p: p[1] * p[2]))::BIGINT"


def fold_sql(a: str, b: str, term: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: {term}), lambda s, x: s + x)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def whole_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(
        "embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vec"))


def magnitudes(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", "label", F.transform("vec", F.abs).alias("desc"))


@query(f"SELECT vec_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS pos, unnest({V}) AS x FROM embeddings")
def scan_descriptors(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode("vec").alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint"))


ENTROPY = (f"q AS (SELECT vec_id, label, len(embedding) AS n, list_transform({DESC}, lambda v: floor(v * 255 + 0.5)::BIGINT) AS b FROM embeddings), "
           "bins AS (SELECT vec_id, label, n, unnest(list_filter(b, lambda x: x < 256)) AS bin FROM q), "
           "c AS (SELECT vec_id, label, n, bin, count(*)::DOUBLE / n AS p FROM bins GROUP BY vec_id, label, n, bin), "
           "e AS (SELECT vec_id, label, round(-sum(p * log2(p)), 6) AS entropy FROM c GROUP BY vec_id, label)")


def entropies(spark, sf_dir):
    return magnitudes(spark, sf_dir).select(F.col("id").alias("vec_id"), "label", F.round(D.entropy(F.col("desc")), 6).alias("entropy"))


@query(f"WITH {ENTROPY} SELECT vec_id, entropy FROM e")
def descriptor_entropy(spark, sf_dir):
    return entropies(spark, sf_dir).select("vec_id", "entropy")


@query(f"WITH {ENTROPY} SELECT vec_id, entropy FROM e WHERE entropy >= 2.2")
def entropy_filter(spark, sf_dir):
    return entropies(spark, sf_dir).where("entropy >= 2.2").select("vec_id", "entropy")


@query(f"WITH {ENTROPY}, r AS (SELECT label, vec_id, entropy, row_number() OVER (PARTITION BY label ORDER BY entropy DESC, vec_id) AS rank FROM e) SELECT * FROM r WHERE rank <= 5 OR entropy > 4.4")
def sample_entropy(spark, sf_dir):
    return sampling.sample_by_entropy(entropies(spark, sf_dir), "label", "entropy", "vec_id").select("label", "vec_id", "entropy", "rank")


@query(f"WITH e AS (SELECT vec_id, label, list_max({DESC}) AS size FROM embeddings), r AS (SELECT label, vec_id, size, row_number() OVER (PARTITION BY label ORDER BY size DESC, vec_id) AS rank FROM e) SELECT * FROM r WHERE rank <= 20")
def topn_by_size(spark, sf_dir):
    rows = magnitudes(spark, sf_dir).select("label", F.col("id").alias("vec_id"), F.array_max("desc").alias("size"))
    return sampling.top_by_size(rows, "label", F.col("size"), "vec_id", 20).select("label", "vec_id", "size", "rank")


@query("WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS rank FROM embeddings) SELECT * FROM r WHERE rank <= 20")
def random_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return sampling.random_sample(rows, "label", "vec_id", 20, seed=7).select("label", "vec_id", "rank")


def _flat(df, name):
    return df.select(F.col("id").alias("vec_id"), F.posexplode(name).alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), "x")


@query(f"SELECT vec_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS pos, unnest(list_transform({DESC}, lambda v: least(greatest(trunc(v * 100.0::DOUBLE) / 100.0::DOUBLE, 0), 1))) AS x FROM embeddings")
def quantize_descriptors(spark, sf_dir):
    return _flat(magnitudes(spark, sf_dir).withColumn("q", D.quantise(D.resize(F.col("desc"), 1.0))), "q")


@query(f"SELECT vec_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS pos, unnest(list_transform({V}, lambda v: greatest(v * 1.5::DOUBLE, 0))) AS x FROM embeddings")
def resize_descriptors(spark, sf_dir):
    """Components one and a half times as large, none below zero."""
    return _flat(vectors(spark, sf_dir).withColumn("q", D.resize(F.col("vec"), 1.5)), "q")


@query(f"SELECT vec_id, 0::BIGINT AS trivial, CASE WHEN embedding[4] >= 0 THEN 1 ELSE 0 END::BIGINT AS threshold, "
       "xor(CASE WHEN embedding[1] >= 0 THEN 1 ELSE 0 END, CASE WHEN embedding[2]::DOUBLE >= 0.05::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS both, "
       "least(abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE - 0.05::DOUBLE)) AS delta FROM embeddings")
def simple_hashes(spark, sf_dir):
    """The trivial hash, a threshold, and two of them joined by exclusive or, with how near that is to changing."""
    v, pair = F.col("vec"), Xor((Threshold(0, 0.0), Threshold(1, 0.05)))
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), Trivial().hash(v).alias("trivial"), Threshold(3, 0.0).hash(v).alias("threshold"),
                                         pair.hash(v).alias("both"), pair.delta(v).alias("delta"))


@query(f"WITH n AS (SELECT vec_id, {INT} AS a, lead({INT}) OVER (ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, "
       "list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN abs(p[1]) ELSE 0 END))::BIGINT AS distance FROM n WHERE b IS NOT NULL")
def delta_hamming(spark, sf_dir):
    """Bits in which the signs of a vector and the next one differ, each weighted by how far the first is from changing."""
    whole = lambda c: F.transform(c, lambda x: F.floor(256 * x))
    rows = _with_next(spark, sf_dir).select("id", whole("a").alias("a"), whole("b").alias("b"))
    flags = lambda c: F.transform(c, lambda x: x > 0)
    return rows.select(F.col("id").alias("vec_id"), bits_delta(flags("a"), flags("b"), F.transform("a", F.abs)).alias("distance"))


@query(f"SELECT vec_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS pos, unnest(list_transform({DESC}, lambda v: round(least((ln(greatest(v, 0.001::DOUBLE)) + -ln(0.001::DOUBLE)) / -ln(0.001::DOUBLE), 1), 6))) AS x FROM embeddings")
def logscale_descriptors(spark, sf_dir):
    return _flat(magnitudes(spark, sf_dir).withColumn("q", F.transform(D.log_scale(F.col("desc")), lambda v: F.round(v, 6))), "q")


@query(f"SELECT vec_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS pos, unnest(list_transform({DESC}, lambda v: least(v * 2, 1))) AS x FROM embeddings")
def double_and_cap(spark, sf_dir):
    return _flat(magnitudes(spark, sf_dir).withColumn("q", D.double_and_cap(F.col("desc"))), "q")


def _blocks_sql(condition: str) -> str:
    return ", ".join(f"list_sum(list_transform(range(16), lambda i: CASE WHEN {condition.format(k=16 * k)} THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT AS b{k}" for k in range(4))


@query(f"WITH m AS (SELECT vec_id, {V} AS v, list_reduce(list_slice(list_sort({V}), 11, 54), lambda s, x: s + x) / 44 AS mean FROM embeddings) SELECT vec_id, " + _blocks_sql("v[{k} + i + 1] > mean") + " FROM m")
def sketch_test(spark, sf_dir):
    flags = trimmed_mean_bits(F.col("vec"), DIM)
    return vectors(spark, sf_dir).withColumn("f", flags).select(F.col("id").alias("vec_id"), *[pack_bits(F.col("f"), k, 16).alias(f"b{k}") for k in range(4)])


@query("SELECT vec_id, " + _blocks_sql("embedding[{k} + i + 1] > embedding[({k} + i + 1) % 64 + 1]") + " FROM embeddings")
def sketch_texture(spark, sf_dir):
    flags = texture_bits(F.col("vec"), DIM)
    return vectors(spark, sf_dir).withColumn("f", flags).select(F.col("id").alias("vec_id"), *[pack_bits(F.col("f"), k, 16).alias(f"b{k}") for k in range(4)])


NEXT = f"n AS (SELECT vec_id, {V} AS a, lead({V}) OVER (ORDER BY vec_id) AS b FROM embeddings)"


def _with_next(spark, sf_dir):
    """Each vector with the next one in the order of ids, by position, so that no label gathers in one task."""
    placed = ordering.positions(vectors(spark, sf_dir).select("id", "vec"), F.col("id"))
    after = placed.select((F.col("position") - 1).alias("position"), F.col("vec").alias("b"))
    return placed.join(after, "position").select("id", F.col("vec").alias("a"), "b")


@query(f"WITH {NEXT} SELECT vec_id, round({fold_sql('a', 'b', 'abs(p[1] - p[2])')}, 9) AS l1, round({fold_sql('a', 'b', '(p[1] - p[2]) * (p[1] - p[2])')}, 9) AS l2_squared, "
       f"round(sqrt({fold_sql('a', 'b', '(p[1] - p[2]) * (p[1] - p[2])')}), 9) AS l2, list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) AS l_max FROM n WHERE b IS NOT NULL")
def vector_metrics(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _with_next(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(D.l1(a, b), 9).alias("l1"), F.round(D.l2_squared(a, b), 9).alias("l2_squared"),
                                            F.round(D.l2(a, b), 9).alias("l2"), D.l_max(a, b).alias("l_max"))


@query(f"WITH {NEXT} SELECT vec_id, round({fold_sql('a', 'b', 'p[1] * p[2]')}, 9) AS dot FROM n WHERE b IS NOT NULL")
def vector_dot(spark, sf_dir):
    return _with_next(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(D.dot(F.col("a"), F.col("b")), 9).alias("dot"))


PAIRS = f"w AS (SELECT vec_id AS id, {INT} AS v FROM embeddings), p AS (SELECT q.id AS q_id, r.id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM w q JOIN w r ON q.id <> r.id)"
RANK = ", k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS rank FROM p)"


def _exhaustive(spark, sf_dir, **bounds):
    w = whole_vectors(spark, sf_dir)
    return knn.exhaustive(w, w, **bounds).withColumn("dist", F.col("dist").cast("bigint"))


@query(f"WITH {PAIRS}{RANK} SELECT q_id, id, dist, rank FROM k WHERE rank <= 10")
def knn_exact(spark, sf_dir):
    return _exhaustive(spark, sf_dir, k=10)


@query(f"WITH {PAIRS}{RANK} SELECT q_id, id, dist, rank FROM k WHERE rank <= 5")
def knn_topk(spark, sf_dir):
    return _exhaustive(spark, sf_dir, k=5)


@query(f"WITH {PAIRS}{RANK} SELECT q_id, id, dist, rank FROM k WHERE rank <= 5")
def knn_pruned(spark, sf_dir):
    """The same rows as knn_topk, from the cells of pivots that a query cannot skip."""
    w = whole_vectors(spark, sf_dir)
    return _whole(pruned.nearest(w, w, 5))


@query(f"WITH {PAIRS}, p2 AS (SELECT * FROM p WHERE dist < 90000), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS rank FROM p2) SELECT q_id, id, dist, rank FROM k")
def rnn_range(spark, sf_dir):
    return _exhaustive(spark, sf_dir, within=90000)


@query(f"WITH {PAIRS}, p2 AS (SELECT * FROM p WHERE dist < 80000), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS rank FROM p2) SELECT q_id, id, dist, rank FROM k WHERE rank <= 3")
def knn_within_r(spark, sf_dir):
    return _exhaustive(spark, sf_dir, k=3, within=80000)


def _digit(a, b):
    return f"(({project_sql('v', a)} + {b}) // {WIDTH})"


def floor_div(expr, n):
    return f"floor(({expr})::DOUBLE / {n})::BIGINT"


BINS = "[" + ", ".join("(" + " * 64 + ".join(
    f"((({floor_div(project_sql('v', a) + ' + ' + str(b), WIDTH)}) % 64 + 64) % 64)" for a, b in digits) + ")" for digits in STABLE) + "]"
LSH = (f"w AS (SELECT vec_id AS id, {INT} AS v FROM embeddings), t AS (SELECT id, unnest(range({len(STABLE)})) AS tab, unnest({BINS}) AS bin FROM w), "
       "c AS (SELECT DISTINCT q.id AS q_id, r.id FROM t q JOIN t r ON q.tab = r.tab AND q.bin = r.bin AND q.id <> r.id), "
       "p AS (SELECT q_id, c.id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM c JOIN w q ON q.id = q_id JOIN w r ON r.id = c.id)")


@query(f"WITH {LSH}{RANK} SELECT q_id, id, dist, rank FROM k WHERE rank <= 5")
def lsh_knn(spark, sf_dir):
    w = whole_vectors(spark, sf_dir)
    return _whole(knn.lsh_nearest(w, knn.tables(w, TABLES), TABLES, 5))


@query(f"WITH {LSH}{RANK} SELECT q_id, id, dist, rank FROM k WHERE rank <= 5")
def lsh_index_search(spark, sf_dir):
    """The index is saved, loaded again and searched."""
    w, path = whole_vectors(spark, sf_dir), f"{ordering.shared_folder(spark)}/lsh-{uuid.uuid4().hex}"
    knn.save_index(knn.tables(w, TABLES), path)
    return _whole(knn.lsh_nearest(w, knn.load_index(spark, path), TABLES, 5))


@query(f"WITH {LSH}{RANK} SELECT q_id, id, dist, rank FROM k WHERE rank <= 5")
def lsh_index_append(spark, sf_dir):
    """An index of half the rows on disk, the others appended in two changes, and its busy parts rewritten: the same as one made at once."""
    w = whole_vectors(spark, sf_dir)
    index = FlatIndex(spark, f"{ordering.shared_folder(spark)}/lsh-{uuid.uuid4().hex}")
    index.create(TABLES)
    for part in (F.col("id") % 2 == 0, F.col("id") % 4 == 1, F.col("id") % 4 == 3):
        index.append(w.where(part))
    index.compact(2)
    return _whole(FlatIndex(spark, index.log.path).nearest(w, 5))


def _whole(found):
    return found.withColumn("dist", F.col("dist").cast("bigint"))


@query(f"WITH {PAIRS}{RANK}, l AS (WITH {LSH}{RANK} SELECT q_id, id FROM k WHERE rank <= 5) SELECT k.q_id, count(l.id)::DOUBLE / count(*) AS recall FROM k LEFT JOIN l ON k.q_id = l.q_id AND k.id = l.id WHERE k.rank <= 5 GROUP BY k.q_id")
def knn_recall(spark, sf_dir):
    return knn.recall(knn_topk(spark, sf_dir), lsh_knn(spark, sf_dir))


PLANES = "[" + ", ".join("[" + ", ".join(f"CASE WHEN {project_sql('v', h.a)} >= 0 THEN '1' ELSE '0' END" for h in tree) + "]" for tree in TREES) + "]"
FOREST = (f"w AS (SELECT vec_id AS id, {INT} AS v FROM embeddings), h AS (SELECT id, unnest(range({len(TREES)})) AS tree, unnest({PLANES}) AS bits FROM w), "
          "n AS (SELECT id, tree, depth, coalesce(array_to_string(bits[:depth], ''), '') AS prefix FROM h, (SELECT unnest(range(9)) AS depth)), "
          "z AS (SELECT tree, depth, prefix, count(*) AS size FROM n GROUP BY ALL), "
          "s AS (SELECT id AS q_id, depth, sum(size)::BIGINT AS total FROM n JOIN z USING (tree, depth, prefix) GROUP BY ALL), "
          f"st AS (SELECT q_id, greatest(coalesce(min(CASE WHEN total < (SELECT floor(count(*) * {len(TREES)} * {MOST_SHARE}::DOUBLE) FROM w) THEN depth END), 9) - 1, 0) AS depth FROM s GROUP BY q_id), "
          "c AS (SELECT DISTINCT q.id AS q_id, r.id FROM st JOIN n q ON q.id = st.q_id AND q.depth = st.depth JOIN n r ON r.tree = q.tree AND r.depth = q.depth AND r.prefix = q.prefix AND r.id <> q.id), "
          "p AS (SELECT q_id, c.id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM c JOIN w q ON q.id = q_id JOIN w r ON r.id = c.id)")


def _most(rows) -> int:
    return int(rows.count() * len(TREES) * MOST_SHARE)


@query(f"WITH {FOREST}{RANK} SELECT q_id, id, dist, rank FROM k WHERE rank <= 5")
def lsh_forest_knn(spark, sf_dir):
    w = whole_vectors(spark, sf_dir)
    return _whole(knn.forest_nearest(w, w, TREES, _most(w), 5))


def _forest(spark, w):
    """A forest on disk: half of the rows, then the others appended."""
    index = ForestIndex(spark, f"{ordering.shared_folder(spark)}/forest-{uuid.uuid4().hex}")
    index.create(TREES)
    for part in (0, 1):
        index.append(w.where(F.col("id") % 2 == part))
    return ForestIndex(spark, index.log.path)


@query(f"WITH {FOREST}{RANK} SELECT q_id, id, dist, rank FROM k WHERE rank <= 5")
def forest_index_append(spark, sf_dir):
    w = whole_vectors(spark, sf_dir)
    return _whole(_forest(spark, w).nearest(w, _most(w), 5))


@query(f"WITH w AS (SELECT vec_id AS id, {INT} AS v FROM embeddings), h AS (SELECT unnest(range({len(TREES)})) AS tab, unnest({PLANES}) AS bits FROM w), "
       "d AS (SELECT tab, depth, array_to_string(bits[:depth], '') AS prefix, array_to_string(bits, '') AS key FROM h, (SELECT unnest(range(9)) AS depth)), "
       "n AS (SELECT tab, depth, coalesce(prefix, '') AS prefix, count(*) AS n, min(key) AS low, max(key) AS high FROM d GROUP BY ALL) "
       "SELECT tab::INT AS tab, prefix, CASE WHEN low = high THEN low END AS key, n FROM n WHERE depth = 0 OR EXISTS "
       "(SELECT 1 FROM n u WHERE u.tab = n.tab AND u.depth = n.depth - 1 AND u.prefix = substr(n.prefix, 1, n.depth - 1) AND u.low <> u.high)")
def forest_nodes(spark, sf_dir):
    """Nodes of the forest with their sizes; a leaf holds one key."""
    return _forest(spark, whole_vectors(spark, sf_dir)).nodes()


@query(f"WITH v AS (SELECT vec_id, {INT} AS v FROM embeddings), l AS (SELECT unnest(generate_series(1, 8)) AS i, unnest({[list(draw(300 + i, m=40)) for i in range(8)]}) AS u) "
       "SELECT vec_id FROM v WHERE NOT EXISTS (SELECT 1 FROM l WHERE list_sum(list_transform(list_zip(v, u), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) < 100000)")
def blacklist_anti(spark, sf_dir):
    """Vectors that are not near one of a few listed ones."""
    listed = spark.createDataFrame([(i, list(draw(300 + i, m=40))) for i in range(8)], "i int, u array<bigint>")
    return sampling.without_listed(whole_vectors(spark, sf_dir), listed, "id", "vec", "u", 100000).select(F.col("id").alias("vec_id"))


KP = "kp AS (SELECT label AS image_id, vec_id AS id, embedding[1]::DOUBLE * 400 AS x, embedding[2]::DOUBLE * 400 AS y, embedding[3]::DOUBLE AS dir FROM embeddings)"


@query(f"WITH {KP} SELECT a.id AS a_id, b.id AS b_id, round(abs(a.x - b.x) + abs(a.y - b.y), 6) AS distance FROM kp a JOIN kp b ON a.image_id < b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 5 AND abs(a.dir - b.dir) < 0.05")
def keypoint_match(spark, sf_dir):
    from kindred.operators.search import keypoint_match as match
    v = F.col("vec")
    kp = vectors(spark, sf_dir).select(F.col("label").alias("image_id"), "id", (v[0] * 400).alias("x"), (v[1] * 400).alias("y"), v[2].alias("dir"))
    return match(kp, kp, 5.0).select("a_id", "b_id", F.round("distance", 6).alias("distance"))


# linear algebra over whole numbers, so that SQL gives the same bits
BINARISER = np.array([draw(2000 + i) for i in range(128)]), np.array(draw(2999, 128, 500))
WINDOWS = np.array([draw(3000 + i) for i in range(128)]), np.array([random.Random(3500 + i).randrange(WIDTH) for i in range(128)])
MEANS = np.array([draw(4000 + i, m=60) for i in range(16)])


def _hex_sql(bit: str, n: int = 128) -> str:
    """The n bits, the first of a byte highest, as hexadecimal digits."""
    return (f"array_to_string(list_transform(range({n // 8}), lambda j: format('{{:02x}}', list_sum(list_transform(range(8), "
            f"lambda i: CASE WHEN ({bit}) THEN 1::BIGINT << (7 - i)::INT ELSE 0 END))::BIGINT)), '')")


def _all_projections(matrix, offset) -> str:
    return "[" + ", ".join(f"{project_sql('v', a)} + {b}" for a, b in zip(matrix.tolist(), offset.tolist())) + "]"


def _hexed(df):
    return df.select(F.col("id").alias("vec_id"), F.lower(F.hex("sketch")).alias("sketch"))


def _sketch_sql(matrix, offset, bit, n=128):
    return f"WITH w AS (SELECT vec_id, {INT} AS v FROM embeddings), p AS (SELECT vec_id, {_all_projections(matrix, offset)} AS p FROM w) SELECT vec_id, {_hex_sql(bit, n)} AS sketch FROM p"


@query(_sketch_sql(*BINARISER, "p[8 * j + i + 1] <= 0"))
def sketch_lda(spark, sf_dir):
    return _hexed(linear.projection_sketch(whole_vectors(spark, sf_dir), "vec", *BINARISER))


@query(_sketch_sql(BINARISER[0][:64], BINARISER[1][:64], "p[8 * j + i + 1] <= 0", 64))
def sketch_lda_64(spark, sf_dir):
    """The short form: 64 rows, one word."""
    return _hexed(linear.projection_sketch(whole_vectors(spark, sf_dir), "vec", BINARISER[0][:64], BINARISER[1][:64]))


@query(_sketch_sql(*WINDOWS, f"floor(p[8 * j + i + 1]::DOUBLE / {WIDTH})::BIGINT & 1 = 1"))
def sketch_lsh(spark, sf_dir):
    return _hexed(linear.window_sketch(whole_vectors(spark, sf_dir), "vec", w=WIDTH, matrix=WINDOWS[0], offset=WINDOWS[1]))


#: Modes of a spectral hash over four axes, and whole-numbered axes and mean for the form that SQL can follow.
MODES = [[(1 + k // 4) if j == k % 4 else 0 for j in range(4)] for k in range(8)]
AXES, CENTRE = [list(draw(8000 + i)) for i in range(4)], list(draw(8100, m=40))


@query(f"WITH w AS (SELECT vec_id AS id, list_transform(list_zip({INT}, {CENTRE}), lambda p: p[1] - p[2]) AS v FROM embeddings), "
       f"p AS (SELECT id, [{', '.join(project_sql('v', a) for a in AXES)}] AS p FROM w), "
       f"b AS (SELECT id, list_transform({MODES}, lambda m: list_product(list_transform(list_zip(m, p), lambda x: sin(x[2]::DOUBLE * (x[1]::DOUBLE / 1000) + pi() / 2))) > 0) AS b FROM p) "
       "SELECT id, list_sum(list_transform(range(8), lambda k: CASE WHEN b[k + 1] THEN 1::BIGINT << k::INT ELSE 0 END))::BIGINT AS code FROM b")
def spectral_hash(spark, sf_dir):
    return linear.spectral_hash(whole_vectors(spark, sf_dir), "vec", np.array(CENTRE), np.array(AXES), np.array(MODES) / 1000)


@query()
def spectral_trained(spark, sf_dir):
    """The same with the vectors' own mean and principal axes."""
    v = vectors(spark, sf_dir).select("id", "vec")
    mean, axes = linear.principal_axes(v, "vec", 4)
    return linear.spectral_hash(v, "vec", mean, axes, np.pi * np.array(MODES, float))


@query(f"WITH w AS (SELECT vec_id AS id, {INT} AS v FROM embeddings), m AS (SELECT unnest(range(16)) AS cell, unnest({MEANS.tolist()}) AS u), "
       "d AS (SELECT id, cell, list_sum(list_transform(list_zip(v, u), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM w, m), "
       "r AS (SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY dist, cell) AS rank FROM d) SELECT id, cell FROM r WHERE rank = 1")
def vector_quantiser(spark, sf_dir):
    return linear.nearest_mean(whole_vectors(spark, sf_dir), "vec", MEANS)


#: Tables of three digits each, of whole numbers.
PROBED = [[StableDistribution(draw(7000 + 100 * t + s), random.Random(70 * t + s).randrange(WIDTH), WIDTH) for s in range(3)] for t in range(4)]
PROBES = 8


def _digits_sql(of) -> str:
    return "[" + ", ".join("[" + ", ".join(of(f"({project_sql('v', h.a)} + {h.b})") for h in t) + "]" for t in PROBED) + "]"


PROBING = (f"w AS (SELECT vec_id AS id, {INT} AS v FROM embeddings), "
           f"t AS (SELECT id, unnest(range(4)) AS tab, unnest({_digits_sql(lambda p: floor_div(p, WIDTH))}) AS own, "
           f"unnest({_digits_sql(lambda p: f'(({p} % {WIDTH} + {WIDTH}) % {WIDTH})::DOUBLE / {WIDTH}')}) AS d FROM w), "
           f"st AS (SELECT unnest({[list(s) for s in product((-1, 0, 1), repeat=3)]}) AS steps), "
           "co AS (SELECT id, tab, own, steps, list_sum(list_transform(list_zip(steps, d), lambda p: CASE WHEN p[1] = 0 THEN 0.0::DOUBLE WHEN p[1] < 0 THEN p[2] * p[2] ELSE (1 - p[2]) * (1 - p[2]) END)) AS cost, "
           "list_sum(list_transform(steps, lambda s: abs(s))) AS moves FROM t, st), "
           "pr AS (SELECT id AS q_id, tab, list_transform(list_zip(own, steps), lambda p: p[1] + p[2]) AS bin, row_number() OVER (PARTITION BY id, tab ORDER BY cost, moves, steps) - 1 AS probe FROM co), "
           f"c AS (SELECT q_id, t.id, min(probe)::INT AS probe FROM pr JOIN t ON pr.tab = t.tab AND pr.bin = t.own AND t.id <> q_id WHERE probe <= {PROBES} GROUP BY ALL), "
           "p AS (SELECT q_id, c.id, probe, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM c JOIN w q ON q.id = q_id JOIN w r ON r.id = c.id)")


@query(f"WITH {PROBING}{RANK} SELECT q_id, id, dist, probe, rank FROM k WHERE rank <= 5")
def mplsh_knn(spark, sf_dir):
    w = whole_vectors(spark, sf_dir)
    return _whole(knn.probe_nearest(w, w, PROBED, PROBES, 5))


@query(f"WITH {PROBING}, n AS (SELECT unnest([0, 3, 8]) AS probes), l AS (SELECT probes, q_id, id, row_number() OVER (PARTITION BY probes, q_id ORDER BY dist, id) AS rank FROM p JOIN n ON probe <= probes), "
       "a AS (SELECT q.id AS q_id, r.id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM w q JOIN w r ON q.id <> r.id), "
       "e AS (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS rank FROM a) "
       "SELECT probes, round(count(l.id)::DOUBLE / count(*), 9) AS recall FROM n JOIN e ON rank <= 5 LEFT JOIN l ON l.probes = n.probes AND l.q_id = e.q_id AND l.id = e.id AND l.rank <= 5 GROUP BY n.probes".replace("SELECT probes, round(count", "SELECT n.probes, round(count").replace("JOIN e ON rank <= 5", "JOIN e ON e.rank <= 5"))
def mplsh_recall(spark, sf_dir):
    """Recall of the five nearest by number of probes, all from one pass over the bins."""
    w = whole_vectors(spark, sf_dir)
    truth = ordering.checkpointed(knn.exhaustive(w, w, k=5).select("q_id", "id"))
    asks = knn.probed(w, PROBED, PROBES)
    found = ordering.checkpointed(knn.nearest_in_bins(asks, knn.digit_tables(w, PROBED), 5))
    parts = [truth.join(knn.best_found(found.where(F.col("probe") <= p), 5).select("q_id", "id", F.lit(1).alias("hit")), ["q_id", "id"], "left").agg(
        F.lit(p).alias("probes"), F.round(F.count("hit") / F.count("*"), 9).alias("recall")) for p in (0, 3, 8)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Bins of a table are kept modulo so many.
MODULO = knn.Modulo((1, 31, 961), 101)


def _modulo_sql(digits: str) -> str:
    at = " + ".join(f"{digits}[{i + 1}] * {f}" for i, f in enumerate(MODULO.factors))
    return f"((({at}) % {MODULO.bins} + {MODULO.bins}) % {MODULO.bins})"


@query(f"WITH {PROBING}{RANK} SELECT q_id, id, dist, probe, rank FROM k WHERE rank <= 5".replace("pr.bin = t.own", f"{_modulo_sql('pr.bin')} = {_modulo_sql('t.own')}"))
def mplsh_modulo(spark, sf_dir):
    """The same with a table's bins modulo a number, so that far bins meet too."""
    w = whole_vectors(spark, sf_dir)
    return _whole(knn.probe_nearest(w, w, PROBED, PROBES, 5, MODULO))


#: Widths are those of Gaussian hashes: whole numbers drawn from -8..8 without 0 have this deviation.
SPREAD = (sum(i * i for i in range(1, 9)) / 8) ** 0.5
_REACH = RecallTable.simulate(WIDTH / SPREAD, 3, PROBES, 30.0, 600.0, tables=4)
REACH = RecallTable(_REACH.least, _REACH.step, np.round(_REACH.values, 6))
TARGET = 0.6


@query(f"WITH {PROBING}, n AS (SELECT unnest(range({PROBES + 1}))::INT AS probes), "
       "l AS (SELECT probes, q_id, id, dist, row_number() OVER (PARTITION BY probes, q_id ORDER BY dist, id) AS rank FROM p JOIN n ON probe <= probes), "
       f"x AS (SELECT probes, q_id, sum({REACH.values.ravel().tolist()}[least(greatest(round(ln(greatest(sqrt(dist), {REACH.least}::DOUBLE) / {REACH.least}::DOUBLE) / {REACH.step}::DOUBLE), 0), {len(REACH.values) - 1})::INT * {PROBES + 1} + probes + 1]) / 5 AS recall FROM l WHERE rank <= 5 GROUP BY ALL), "
       f"s AS (SELECT q_id, coalesce(min(CASE WHEN recall >= {TARGET} THEN probes END), {PROBES})::INT AS probes, min(CASE WHEN recall >= {TARGET} THEN probes END) IS NOT NULL AS reached FROM x GROUP BY q_id) "
       "SELECT l.q_id, id, dist, rank, s.probes, reached FROM l JOIN s ON l.q_id = s.q_id AND l.probes = s.probes WHERE rank <= 5")
def mplsh_adaptive(spark, sf_dir):
    """Probing until the expected recall of the five nearest is TARGET; the probes that it took, and whether they reached it."""
    w = whole_vectors(spark, sf_dir)
    return _whole(search_to_recall(w, w, PROBED, REACH, 5, TARGET))


@query()
def apost_knn(spark, sf_dir):
    """A-posteriori probing: moves learned from some vectors and their neighbours, until they cover the recall."""
    w = whole_vectors(spark, sf_dir)
    model = train_probes(w, PROBED, 5)
    return _whole(apost_nearest(w, w, PROBED, model, 5, 0.9))


def pictures(spark, sf_dir):
    """Each vector as an 8 x 8 gray tile, enlarged to 96 x 96."""
    level = F.transform("vec", lambda x: F.least(F.greatest(F.floor(x * 400 + 128), F.lit(0)), F.lit(255)))
    row = lambda y: F.concat(*[F.repeat(F.lpad(F.hex(F.get("p", F.lit(8 * y + x))), 2, "0"), 12) for x in range(8)])
    data = F.unhex(F.concat(*[F.repeat(row(y), 12) for y in range(8)]))
    return vectors(spark, sf_dir).withColumn("p", level).select(F.col("id").alias("image_id"), F.lit(96).alias("width"), F.lit(96).alias("height"), F.lit(1).alias("channels"), data.alias("data"))


LEVEL = "list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 400 + 128), 0), 255)::BIGINT)"


def _tile_sql(k: int) -> str:
    """The mean of pixel column k % 8 over the old rows that new row k // 8 of 12 covers, each tile being 12 rows high."""
    y, x = divmod(k, 8)
    a, b = 8 * y // 12, (8 * y + 7) // 12
    tile = lambda r: f"p[{8 * r + x + 1}]"
    return tile(a) if a == b else f"round_even(({tile(a)} * {12 * b - 8 * y} + {tile(b)} * {8 * y + 8 - 12 * b})::DOUBLE / 8, 0)::BIGINT"


@query(f"WITH t AS (SELECT vec_id, {LEVEL} AS p FROM embeddings), r AS (SELECT vec_id, [" + ", ".join(map(_tile_sql, range(64))) + "] AS q FROM t), "
       "f AS (SELECT vec_id, list_sum(list_transform(range(64), lambda k: CASE WHEN q[k + 1] > list_sum(q) // 64 THEN 1::HUGEINT << k::INT ELSE 0 END)) AS f FROM r) "
       "SELECT vec_id AS image_id, (CASE WHEN f >= 9223372036854775808::HUGEINT THEN f - 18446744073709551616::HUGEINT ELSE f END)::BIGINT AS fingerprint FROM f")
def image_fingerprint(spark, sf_dir):
    return images.fingerprints(pictures(spark, sf_dir))


def _area_sql(width: int, height: int, rows: int) -> list[str]:
    """Pixels of the first rows of a 96 x 96 picture of 8 x 8 tiles, made ``width`` x ``height`` by means of areas, half to even."""
    out = []
    for y in range(rows):
        for x in range(width):
            terms = []
            for r in range(8):  # a tile is ``height`` units high, a new row 8 units
                cover = min(8 * (y + 1), height * (r + 1)) - max(8 * y, height * r)
                if cover > 0:
                    terms += [f"p[{8 * r + c + 1}] * {cover}" for c in range(8 * x // width, 8 * (x + 1) // width)]
            out.append(f"round_even(({' + '.join(terms)})::DOUBLE / {8 * (8 // width)}, 0)::BIGINT")
    return out


def _signed(name: str) -> str:
    return f"(CASE WHEN {name} >= 9223372036854775808::HUGEINT THEN {name} - 18446744073709551616::HUGEINT ELSE {name} END)::BIGINT AS {name}"


def _set_bits(of: str, least: str, n: int, first: int = 0) -> str:
    return f"list_sum(list_transform(range({n}), lambda k: CASE WHEN {of}[k + 1] >= {least} THEN 1::HUGEINT << (k + {first})::INT ELSE 0::HUGEINT END))::HUGEINT"


@query(f"WITH t AS (SELECT vec_id, {LEVEL} AS p FROM embeddings), "
       f"r AS (SELECT vec_id, [{', '.join(_area_sql(8, 12, 7))}] AS a, [{', '.join(_area_sql(8, 6, 5))}] AS b, [{', '.join(_area_sql(4, 5, 4))}] AS c FROM t), "
       "s AS (SELECT *, list_sum(a)::BIGINT // 56 AS mean, list_sum(b)::BIGINT AS total FROM r), "
       f"f AS (SELECT vec_id, {_set_bits('a', 'mean', 56)} + (mean::HUGEINT << 56) AS by_mean, {_set_bits('b', 'total // 40', 40, 24)} + (total % 65536)::HUGEINT AS by_sum, "
       "list_sum(list_transform(range(16), lambda k: (c[k + 1] // 16)::HUGEINT << (4 * (15 - k))::INT))::HUGEINT AS by_nibbles FROM s) "
       f"SELECT vec_id AS image_id, {', '.join(map(_signed, ('by_mean', 'by_sum', 'by_nibbles')))} FROM f")
def image_fingerprint_forms(spark, sf_dir):
    """The three older forms of a picture's fingerprint."""
    held = pictures(spark, sf_dir)
    parts = [images.fingerprints(held, kind).withColumnRenamed("fingerprint", name) for kind, name in (("mean", "by_mean"), ("sum", "by_sum"), ("nibbles", "by_nibbles"))]
    return parts[0].join(parts[1], "image_id").join(parts[2], "image_id")


def colour_pictures(spark, sf_dir):
    """Each vector as 8 x 8 coloured pixels: blue, green and red are its levels in three orders."""
    level = F.transform("vec", lambda x: F.least(F.greatest(F.floor(x * 400 + 128), F.lit(0)), F.lit(255)))
    byte = lambda at: F.lpad(F.hex(F.get("p", at)), 2, "0")
    data = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.concat(byte(k), byte(63 - k), byte((k * 7 + 3) % 64))))
    return vectors(spark, sf_dir).withColumn("p", level).select(
        F.col("id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(3).alias("channels"), F.unhex(data).alias("data"))


@query(f"WITH t AS (SELECT vec_id, {LEVEL} AS p FROM embeddings), x AS (SELECT vec_id, p, unnest(range(64)) AS k FROM t), "
       "c AS (SELECT vec_id, p[k + 1] AS b, p[64 - k] AS g, p[(k * 7 + 3) % 64 + 1] AS r FROM x), "
       "m AS (SELECT *, greatest(b, g, r) AS top, least(b, g, r) AS low FROM c), "
       "h AS (SELECT vec_id, top, low, CASE WHEN top = r THEN (g - b)::DOUBLE / greatest(top - low, 1) WHEN top = g THEN 2 + (b - r)::DOUBLE / greatest(top - low, 1) ELSE 4 + (r - g)::DOUBLE / greatest(top - low, 1) END * 30 AS h FROM m), "
       "v AS (SELECT vec_id, floor((CASE WHEN top = low THEN 0 WHEN h < 0 THEN h + 180 ELSE h END) * 6 / 180)::BIGINT AS hb, floor((CASE WHEN top > 0 THEN (top - low)::DOUBLE / top * 255 ELSE 0 END) * 6 / 255)::BIGINT AS sb FROM h), "
       "n AS (SELECT vec_id, hb * 6 + sb AS bin, count(*) AS n FROM v WHERE hb < 6 AND sb < 6 GROUP BY ALL), z AS (SELECT vec_id, sum(n) AS total FROM n GROUP BY vec_id), "
       "e AS (SELECT vec_id, unnest(range(36)) AS bin FROM embeddings) "
       "SELECT e.vec_id AS image_id, e.bin::INT AS bin, coalesce(n, 0)::DOUBLE / greatest(coalesce(total, 0), 1) AS share FROM e LEFT JOIN n ON e.vec_id = n.vec_id AND e.bin = n.bin LEFT JOIN z ON e.vec_id = z.vec_id")
def hs_histogram(spark, sf_dir):
    return images.colour_histograms(colour_pictures(spark, sf_dir)).select("image_id", F.posexplode("histogram").alias("bin", "share"))


@query()
def sift_descriptors(spark, sf_dir):
    return images.features(pictures(spark, sf_dir)).groupBy("image_id").agg(F.count("*").alias("n"), F.avg("size").alias("mean_size"))

