"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, langid, lmscore, media, phrases, pieces, quality, secrets, shard, simjoin, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_table(table(spark, sf_dir, "documents"), 16)


def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.8)


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(table(spark, sf_dir, "documents"))


def op10_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(table(spark, sf_dir, "pages"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_table(table(spark, sf_dir, "documents"))


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.linked(table(spark, sf_dir, "documents"), 0.8)


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ffbs_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_encode(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"))


def op11_contiguous_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_baseline_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_jump_hash": op1_jump_hash,
        "op2_progressive_jpeg": op2_progressive_jpeg,
        "op3_chosen_path_join": op3_chosen_path_join,
        "op4_ffbs_pieces": op4_ffbs_pieces,
        "op5_minhash_containment": op5_minhash_containment,
        "op6_rank_order_language": op6_rank_order_language,
        "op7_cross_entropy_difference": op7_cross_entropy_difference,
        "op8_crf_toxicity": op8_crf_toxicity,
        "op9_markov_secrets": op9_markov_secrets,
        "op10_zstd_warc": op10_zstd_warc,
        "op11_contiguous_phrases": op11_contiguous_phrases,
        "op12_random_indexing_quality": op12_random_indexing_quality,
        "op13_baseline_divergence": op13_baseline_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jump_hash": shard.oracle(16),
        "op10_zstd_warc": warc.ORACLE,
        "op11_contiguous_phrases": phrases.ORACLE,
        "op13_baseline_divergence": divergence.ORACLE,
    }
