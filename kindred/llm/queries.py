"""The queries opN_<name> of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from kindred.operators.ordering import spread

from . import (bpe, embed_dedup, importance, multi_index, packing, sharding, simhash, substring, token_counts, topk, toxicity, url_filter,
               whitening)
from .oracles import ORACLE_SQL


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir):
    """documents; a small table is dealt to all cores."""
    return spread(table(spark, sf_dir, "documents"), F.col("doc_id"), F.xxhash64("text"))


def op1_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark, sf_dir):
    return bpe.round_trip(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def page_outcomes(spark, sf_dir):
    """labels, read as outcomes of the page of the same id: good is high quality and not toxic."""
    good = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 0).when(
        (F.col("toxic") == 0) & (F.col("quality") == 1), 1)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))


def op7_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))


def op8_toxicity(spark, sf_dir):
    return toxicity.grade_documents(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark, sf_dir):
    return substring.digest_without_repeats(texts(spark, sf_dir))


def op10_simhash(spark, sf_dir):
    return simhash.components(texts(spark, sf_dir))


def op11_multi_index(spark, sf_dir):
    return multi_index.nearest(table(spark, sf_dir, "embeddings"))


def op12_importance(spark, sf_dir):
    return importance.draw(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_bpe": op2_bpe,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash": op10_simhash,
    "op11_multi_index": op11_multi_index,
    "op12_importance": op12_importance,
    "op13_whitening": op13_whitening,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
