"""The registered queries of this subpackage: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm import bpe, conversations, fim, flac, langid, licenses, mixing, ngram_join, oracles, packing, quality, secrets, suffix_dedup, token_counts
from parchmint.session import table


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.features(flac.store(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


# What SQL can express of operators that it cannot express as a whole.


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_flac_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "frames_ok")


def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op7_mix_sources(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


_ALL = (
    op1_flac_media, op2_quality_rules, op3_language_id, op4_license_scan, op5_suffix_dedup, op6_ngram_join, op7_mix_sources, op8_secret_scan, op9_token_counts, op10_byte_bpe,
    op11_conversation_repair, op12_curve_packing, op13_fill_in_middle,
    media_payloads, base_license_places, base_secret_counts, bpe_decoded, mix_targets,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
