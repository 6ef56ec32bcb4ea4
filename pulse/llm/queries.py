"""The registered queries of the corpus operators, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulse.llm import (
    audit, bpe, linededup, multiset, packing, periodic, privacy, quality, secrets, simhash, substring, toxicity, urlfilter)
from pulse.llm.common import read

Build = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(read(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(read(spark, sf_dir), read(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(read(spark, sf_dir), read(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_query(read(spark, sf_dir))


def op4_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.privacy_query(read(spark, sf_dir))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprint_query(read(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_query(read(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_query(read(spark, sf_dir), read(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_query(read(spark, sf_dir))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_query(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Build] = {f.__name__: f for f in (
    op1_simhash, op2_quality, op3_substring_dedup, op4_privacy, op5_toxicity,
    op6_multiset_hash, op7_line_dedup, op8_secrets, op9_bpe, op10_packing,
    op11_filter_audit, op12_periodic_runs, op13_url_filter,
)}
#: The other operators have no SQL form; tests compare them with brute force.
SQL: dict[str, str] = {
    "op7_line_dedup": linededup.LINE_DEDUP_SQL, "op11_filter_audit": audit.AUDIT_SQL, "op13_url_filter": urlfilter.URL_SQL}
