"""The queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.backoff_lm import backoff_scores
from inkwell.llm.common import table
from inkwell.llm.license_scan import license_scan
from inkwell.llm.merkle_manifest import merkle_manifest
from inkwell.llm.minhash import minhash_dedup
from inkwell.llm.mixing import mix
from inkwell.llm.oracles import ORACLES
from inkwell.llm.piece_transducer import round_trips
from inkwell.llm.quality_classifier import classify
from inkwell.llm.quality_rules import MEASURES, quality_rules
from inkwell.llm.suffix_dedup import suffix_dedup
from inkwell.llm.token_alignment import token_alignment
from inkwell.llm.token_counts import token_counts
from inkwell.llm.url_filter import op5_url_filter
from inkwell.llm.vector_graph import vector_dedup


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), width=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


def op9_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *MEASURES, "base_failed", "kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_token_counts": op3_token_counts,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_url_filter": op5_url_filter,
        "op6_backoff_lm": op6_backoff_lm,
        "op7_mixing": op7_mixing,
        "op8_vector_dedup": op8_vector_dedup,
        "op9_piece_transducer": op9_piece_transducer,
        "op10_quality_rules": op10_quality_rules,
        "op11_token_alignment": op11_token_alignment,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
