"""Image search: votes of matching sketches, scores, ranking; lookups by pid, id and fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hamming_join import hamming_join

THRESHOLD, LEAST_SCORE, LEAST_SKETCHES = 7, 0.05, 2


def votes(hits: DataFrame, query: str = "q_image_id", image: str = "image_id") -> DataFrame:
    """(query_id, image_id, votes): matching (query sketch, db sketch) pairs of each image."""
    return hits.groupBy(F.col(query).alias("query_id"), F.col(image).alias("image_id")).agg(F.count("*").alias("votes"))


def rank_images(counted: DataFrame, images: DataFrame, least_score: float = LEAST_SCORE,
                least_sketches: int = LEAST_SKETCHES) -> DataFrame:
    """Scores votes against images(image_id, pid, siftnum): score = min(1, votes / siftnum).

    Images of fewer than ``least_sketches`` sketches, single votes, scores up to
    ``least_score`` and empty pids are dropped. rank orders by score, then image id.
    """
    scored = counted.join(images.select("image_id", "pid", "siftnum"), "image_id").where(
        (F.col("siftnum") >= least_sketches) & (F.col("votes") > 1)).withColumn(
        "score", F.least(F.lit(1.0), F.col("votes") / F.col("siftnum")))
    found = scored.where((F.col("score") > least_score) & (F.col("pid") != ""))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_id")
    return found.select("query_id", "image_id", "pid", "votes", "score").withColumn(
        "rank", F.row_number().over(order).cast("bigint"))


def image_search(queries: DataFrame, sketches: DataFrame, images: DataFrame, threshold: int = THRESHOLD,
                 bits: int = 16) -> DataFrame:
    """Ranked images for query sketches(image_id, ord, blocks), many queries in one plan."""
    return rank_images(votes(hamming_join(queries, sketches, threshold, bits)), images)


def best_match(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") == 1).drop("rank")


def reply_lines(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, reply): ten digits of length, then CODE, count and pid, score pairs, tab-separated."""
    pair = F.concat_ws("\t", "pid", F.format_string("%.4f", "score"))
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", pair.alias("pair")))).alias("hits"))
    hits = F.coalesce(F.col("hits.pair"), F.array().cast("array<string>"))
    line = F.concat(F.concat_ws("\t", F.concat(F.array(F.lit("REPLY_OK"), F.size(hits).cast("string")), hits)), F.lit("\t\n"))
    return queries.join(lists, "query_id", "left").select("query_id", line.alias("line")).select(
        "query_id", F.concat(F.lpad(F.octet_length("line").cast("string"), 10, "0"), "line").alias("reply"))


def pair_similarity(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, matches, total, similarity) of image pairs: the mean of the matches' share in each."""
    n = hits.groupBy(F.col("q_image_id").alias("a"), F.col("image_id").alias("b")).agg(
        F.count("*").alias("matches"), F.sum("distance").alias("total"))
    left = sizes.select(F.col("image_id").alias("a"), F.col("siftnum").alias("na"))
    right = sizes.select(F.col("image_id").alias("b"), F.col("siftnum").alias("nb"))
    return n.join(left, "a").join(right, "b").select(
        "a", "b", "matches", "total", ((F.col("matches") / F.col("na") + F.col("matches") / F.col("nb")) / 2).alias("similarity"))


def keypoint_match(a: DataFrame, b: DataFrame, radius: float, turn: float = 0.05) -> DataFrame:
    """Pairs of keypoints(image_id, id, x, y, dir) of different images, a before b, whose L1
    distance is ``radius`` or less and whose directions differ by less than ``turn``.

    Points meet in grid cells of side ``radius``; the left side looks into the nine cells around.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("gx"), (cell("y") + j).alias("gy"))
                                 for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.select([F.col(c).alias(f"a_{c}") for c in a.columns] + [around.alias("g")]).select("*", "g.gx", "g.gy").drop("g")
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns] + [cell("x").alias("gx"), cell("y").alias("gy")])
    far = F.abs(F.col("a_x") - F.col("b_x")) + F.abs(F.col("a_y") - F.col("b_y"))
    return left.join(right, ["gx", "gy"]).where(
        (F.col("a_image_id") < F.col("b_image_id")) & (far <= radius) & (F.abs(F.col("a_dir") - F.col("b_dir")) < turn)
    ).drop("gx", "gy").withColumn("distance", far)
