"""Importance resampling towards a target distribution, by hashed runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.ordering import positions

from .shared import checkpointed
from .url_filter import LOWER, UPPER

#: What stands between words, once A-Z are lower-cased; a word is what the contract's pattern matches.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED = 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
KEY = ["doc_id", "_h1", "_h2"]


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z only; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), GAP), "")


def runs(texts: DataFrame, order: int, key: list[str]) -> DataFrame:
    """(key, copies, first, one, gram): all runs of 1 to ``order`` consecutive words of texts(key, text), joined by one space.

    Words go into a table of positions. For longer runs lead() over the positions of a text brings the words that
    follow; rows of the same key, which hold the same text, are counted first. ``first`` marks one row of each text, which
    a text without words has too, with a null gram; ``one`` marks runs of one word.
    """
    placed = texts.select(*key, F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    begins = F.coalesce(F.col("pos"), F.lit(0)) == 0
    if order == 1:
        return placed.select(*key, F.lit(1).cast("long").alias("copies"), begins.alias("first"), F.col("word").isNotNull().alias("one"), F.col("word").alias("gram"))
    placed = placed.groupBy(*key, "pos").agg(F.any_value("word").alias("word"), F.count("*").alias("copies"))
    along = Window.partitionBy(*key).orderBy("pos")
    after = [F.col("word"), *(F.lead("word", j).over(along) for j in range(1, order))]
    placed = placed.select(*key, "pos", "copies", *(w.alias(f"_w{j}") for j, w in enumerate(after)))
    grams = F.array(*(F.concat(*[x for w in range(n) for x in (F.lit(" "), F.col(f"_w{w}"))][1:]) for n in range(1, order + 1)))
    each = placed.select(*key, "pos", "copies", F.posexplode_outer(F.array_compact(grams)).alias("n", "gram"))
    short = F.coalesce(F.col("n"), F.lit(0)) == 0
    return each.select(*key, "copies", (begins & short).alias("first"), (short & F.col("gram").isNotNull()).alias("one"), "gram")


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(buckets)).cast("int")


def bucket_counts(grams: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): runs in each bucket; at most ``buckets`` rows."""
    return grams.where("gram is not null").groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.sum("copies").alias(name))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of the smoothed share in target(bucket, t) over that in raw(bucket, s)."""
    spark = raw.sparkSession
    both = checkpointed(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(raw, "bucket", "left").join(
        target, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t").cast("double") + 1) * float(total["s"] + buckets)
    down = (F.col("s").cast("double") + 1) * float(total["t"] + buckets)
    return both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def draw(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
         least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Features are all runs of 1 to ``order`` words, repeats counted, hashed to buckets by crc32. A document's weight is the
    floored mean of its buckets' gains, its score the weight plus Gumbel noise from its id. Of the documents with
    ``least_words`` words or more, ``percent`` of a hundred are drawn (rounded down) by score, ties to smaller ids.

    Null and empty texts have no features, weight 0; texts of any length are read whole. Rows of one id and one text
    count and are returned each; with one id and other texts each is a document of its own, ties between them by
    n_features and weight. A null id has no noise, so no score, and is never drawn nor counted as eligible. An empty
    target gives the gains of no evidence; no documents, no rows. Other columns are ignored, whatever their names.

    Two passes over the texts: one counts buckets, one sums gains; both combine on the map side, so what is shuffled
    is a row a bucket and task and a row a document. Gains are broadcast: a row a bucket, a number that is a parameter.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(seed), "text").alias("_h2"))
    grams = runs(rows, order, KEY)
    wanted = target.select(F.col(target_col).cast("string").alias("text")).select("text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(seed), "text").alias("_h2"))
    gains = bucket_gains(bucket_counts(grams, buckets, "s"), bucket_counts(runs(wanted, order, KEY[1:]), buckets, "t"), buckets)
    valued = grams.withColumn("bucket", bucket(F.col("gram"), buckets)).join(F.broadcast(gains), "bucket", "left")
    count = lambda what: F.sum(F.when(what, F.col("copies")).otherwise(0))
    summed = valued.groupBy(*KEY).agg(
        count(F.col("first")).alias("docs"), count(F.col("one")).alias("n_words"), count(F.col("gram").isNotNull()).alias("n"),
        F.sum(F.col("copies") * F.coalesce("gain", F.lit(0))).alias("g"))
    weight = F.when(F.col("n") > 0, F.expr("(g - pmod(g, n)) div n")).otherwise(0)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    scored = summed.select("doc_id", F.expr("n div docs").alias("n_features"), weight.cast("long").alias("weight"),
                           (F.expr("n_words div docs") >= least_words).alias("long_enough"), F.explode(F.sequence(F.lit(1).cast("long"), "docs")))
    scored = checkpointed(scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))).drop("col"))
    may = F.col("long_enough") & F.col("score").isNotNull()
    drawn = scored.where(may).count() * percent // 100
    placed = positions(scored.where(may), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight"))
    cols = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*cols, F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank")).unionByName(
        scored.where(~may).select(*cols, F.lit(None).cast("long").alias("rank")))
