"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licences, lines, mixing, near, neighbours, oracles, packing, pii, quality, substrings, token_files, tokens
from .tables import read


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(read(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_records(read(spark, sf_dir, "documents"), tokens.vocabulary()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokens.vocabulary())


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_license_scan, op3_substring_dedup, op4_nearest_neighbours, op5_mixing, op6_token_records, op7_pii, op8_line_dedup, op9_quality_rules, op10_packing)}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": oracles.OP1, "op3_substring_dedup": oracles.OP3, "op8_line_dedup": oracles.OP8}
