"""Queries on sparse vectors, random histograms and parameters tuned to the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions.lsh import HyperPlane, RepeatHash, Sparse, StableDistribution
from kindred.operators import histograms, tuning

from .registry import query, table
from .vector_queries import INT, PAIRS, WIDTH, draw, floor_div, project_sql, vectors, whole_vectors

#: Words of a document go to so many places of a sparse vector by their hash.
PLACES = 1024
SPARSE = [Sparse(StableDistribution(draw(20_000 + i, PLACES), 17 * i, 64)) for i in range(3)] + [Sparse(HyperPlane(draw(21_000 + i, PLACES))) for i in range(3)]


def _sparse_sql(h: Sparse) -> str:
    at = f"list_sum(list_transform(v, lambda e: e.value * {list(h.of.a)}[e.index + 1]))"
    return f"CASE WHEN {at} >= 0 THEN 1 ELSE 0 END::BIGINT" if isinstance(h.of, HyperPlane) else floor_div(f"{at} + {h.of.b}", h.of.w)


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word FROM documents), "
       f"c AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 6))::BIGINT % {PLACES} AS index, count(*)::BIGINT AS value FROM w GROUP BY ALL), "
       "s AS (SELECT doc_id, list({'index': index, 'value': value}) AS v FROM c GROUP BY doc_id) "
       "SELECT doc_id, " + ", ".join(f"{_sparse_sql(h)} AS h{i}" for i, h in enumerate(SPARSE)) + " FROM s")
def sparse_hashes(spark, sf_dir):
    """Word counts of documents as sparse vectors, through stable-distribution and hyperplane hashes."""
    words = F.explode(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).alias("word")
    place = (F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("bigint") % PLACES).alias("index")
    counts = table(spark, sf_dir, "documents").select("doc_id", words).groupBy("doc_id", place).agg(F.count("*").alias("value"))
    held = counts.groupBy("doc_id").agg(F.collect_list(F.struct("index", "value")).alias("v"))  # PLACES entries at most
    return held.select("doc_id", *[h.hash(F.col("v")).alias(f"h{i}") for i, h in enumerate(SPARSE)])


#: Three sets of four hashes, each of three digits mixed into 32 bins.
BINS = 32
HISTOGRAM = histograms.RandomHistogram(tuple(tuple(
    RepeatHash(tuple(StableDistribution(draw(30_000 + 100 * n + 10 * m + i), 0, WIDTH) for i in range(3)), (2654435761, 40503, 2246822519), BINS) for m in range(4)) for n in range(3)), BINS)


def _bin_sql(h: RepeatHash, n: int) -> str:
    digits = " + ".join(f"((({floor_div(project_sql('v', d.a) + ' + 0', WIDTH)}) * {f} % 4294967296 + 4294967296) % 4294967296)" for d, f in zip(h.of, h.factors))
    return f"(({digits}) % 4294967296) % {BINS} + {n * BINS}"


VOTES = (f"w AS (SELECT label, vec_id % 3 + 1 AS weight, {INT} AS v FROM embeddings), "
         "t AS (SELECT label, weight, unnest([" + ", ".join(_bin_sql(h, n) for n, hashes in enumerate(HISTOGRAM.sets) for h in hashes) + "])::INT AS bin FROM w), "
         "h AS (SELECT label, bin, sum(weight)::BIGINT AS weight FROM t GROUP BY ALL)")


def _histograms(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vec"))
    return histograms.histograms(rows, ["label"], "vec", F.col("vec_id") % 3 + 1, HISTOGRAM)


@query(f"WITH {VOTES} SELECT label, bin, weight FROM h")
def random_histogram(spark, sf_dir):
    """Weighted votes of each label's vectors over the bins of three sets of four hashes."""
    return _histograms(spark, sf_dir)


@query(f"WITH {VOTES}, s AS (SELECT label, sum(weight) AS total FROM h GROUP BY label), "
       "p AS (SELECT a.label AS a, b.label AS b, sum(least(a.weight, b.weight)) AS shared FROM h a JOIN h b ON a.bin = b.bin AND a.label < b.label GROUP BY ALL) "
       "SELECT a, b, (x.total + y.total - 2 * shared)::BIGINT AS l1, shared::BIGINT AS shared FROM p JOIN s x ON x.label = a JOIN s y ON y.label = b")
def histogram_distances(spark, sf_dir):
    """How far apart the labels' histograms are."""
    return histograms.distances(_histograms(spark, sf_dir), "label")


_SAMPLES = ", ".join(str(int(s * tuning.SCALE)) for s in tuning.SHARES)


@query(f"WITH {PAIRS}, f AS (SELECT id, ('0x' || substr(md5('1:' || id), 1, 8))::BIGINT % {tuning.SCALE} AS place FROM w), a AS (SELECT id FROM f ORDER BY place, id LIMIT {tuning.QUERIES}), "
       f"c AS (SELECT unnest([{_SAMPLES}]) AS cut), s AS (SELECT cut, count(*) AS n FROM c JOIN f ON place < cut GROUP BY cut), "
       "r AS (SELECT cut, q_id, dist, row_number() OVER (PARTITION BY cut, q_id ORDER BY dist, p.id) AS rank FROM p JOIN f ON f.id = p.id JOIN c ON place < cut WHERE q_id IN (SELECT id FROM a)) "
       "SELECT n, rank, count(*) AS queries, round(avg(sqrt(dist)), 6) AS mean, round(avg(ln(sqrt(dist))), 6) AS mean_log FROM r JOIN s USING (cut) WHERE rank <= 5 AND dist > 0 GROUP BY n, rank")
def distance_moments(spark, sf_dir):
    """Mean and logarithmic mean of the distances to the five nearest, in nested samples of four sizes."""
    return tuning.moments(whole_vectors(spark, sf_dir), 5).withColumn("mean", F.round("mean", 6)).withColumn("mean_log", F.round("mean_log", 6))


@query()
def lsh_tuned(spark, sf_dir):
    """Tables, digits and width tuned to a recall of 0.9 of the five nearest, what the model expects and what the index reaches."""
    return tuning.report(vectors(spark, sf_dir).select("id", "vec"), 5, 0.9)
