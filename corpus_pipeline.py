"""Corpus pipeline: toxicity, SimHash near-dedup, substring dedup, best-fit packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import packing, simhash, substring, toxicity
from kindred.llm.shared import shared_folder
from kindred.operators.ordering import spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones of docs, does not reject.

    Null and empty texts stay; without labels of both classes all do; see toxicity.grade_documents().
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies; see simhash.drop_near_copies() for nulls and repeated rows."""
    return simhash.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word sequences that occur earlier; n_chars follows the text. Documents cut to nothing stay, empty."""
    cut = substring.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces in sequences of 2048 tokens; a null or empty text gives its end token."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies),
          ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]
#: SQL can't express the fitted model, nor the packing.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read by the next.

    The files lie in the session's shared folder and go once the stage that reads them has written its own.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id"), F.xxhash64("text"))
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    read = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(wrote := f"{folder}/{k}-{name}")
            if read:
                _remove(spark, read)
            docs, read = spark.read.parquet(wrote), wrote
    if read:
        _remove(spark, read)  # packing has checkpointed its pieces and reads no texts any more
    return docs
