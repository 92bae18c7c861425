"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, linededup, lm, media, neardup, packing, sharding, toxicity, warc
from tessera.llm.common import materialise, read


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_documents(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialise(warc.write_archives(read(spark, sf_dir, "pages")), "warc", compression="none")
    return warc.read_archives(archives, payloads=False).drop("url")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest_documents(read(spark, sf_dir, "documents"))


def op6_collision_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join_documents(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_media_jpeg": op2_media_jpeg,
        "op3_toxicity": op3_toxicity,
        "op4_warc_zstd": op4_warc_zstd,
        "op5_line_dedup": op5_line_dedup,
        "op6_collision_knn": op6_collision_knn,
        "op7_jaccard_forest": op7_jaccard_forest,
        "op8_packing": op8_packing,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_gru_lm": op10_gru_lm,
    }


def oracle_sql() -> dict[str, str]:
    from tessera.llm import oracles

    return oracles.oracle_sql()
