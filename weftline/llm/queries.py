"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import _shared, ann, chat_format, decontamination, language_id, near_dups, packing, quality, secret_scan, substring_dedup, training_order


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with the digest of the base ones."""
    return secret_scan.scan(_shared.source(spark, sf_dir, "documents"))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels whose remainder modulo 5 is not 0."""
    return quality.classify(spark, _shared.source(spark, sf_dir, "documents"), _shared.source(spark, sf_dir, "labels"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in shards of the training order; one row per sequence."""
    return training_order.write_shards(spark, _shared.source(spark, sf_dir, "documents"), _shared.new_path(spark, "shards"), key=20_240_607)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from documents whose remainder modulo 3 is not 1."""
    return language_id.identify(spark, _shared.source(spark, sf_dir, "documents"))


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the last answer of the next one; one row per rendered turn."""
    return chat_format.format_pairs(chat_format.pair_answers(_shared.source(spark, sf_dir, "conversations")))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20, all others being candidates."""
    return ann.search(spark, _shared.source(spark, sf_dir, "embeddings"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose four-word shingles are alike to 0.8."""
    return near_dups.link(spark, _shared.source(spark, sf_dir, "documents"), words=4, percent=80)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document packed into sequences of 2048."""
    return packing.pack(spark, _shared.source(spark, sf_dir, "documents"))


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that a window of a document is alike to 0.8."""
    return decontamination.contaminated(spark, _shared.source(spark, sf_dir, "documents"), _shared.source(spark, sf_dir, "benchmark"))


def op10_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document stays when repeated windows of 20 words go."""
    return substring_dedup.dedup_digest(spark, _shared.source(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_rule_ensemble, op3_training_order, op4_kneser_ney, op5_preference_format, op6_multi_index_hashing, op7_bottom_k, op8_harmonic_packing, op9_simhash_windows, op10_de_bruijn)}
ORACLE_SQL: dict[str, str] = {"op5_preference_format": chat_format.SQL}
