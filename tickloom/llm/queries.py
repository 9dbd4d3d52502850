"""Queries of the corpus operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, conversations, langid, line_crf, line_templates, packing, phrases, quality, runs, secrets, sharding, simhash, token_counts
from tickloom.llm.common import new_folder, table


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op5_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(table(spark, sf_dir, "documents"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.ledger_findings(table(spark, sf_dir, "documents"), new_folder(spark, "ledger"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_components(table(spark, sf_dir, "documents"))


def op11_block_convolution_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.document_runs(table(spark, sf_dir, "documents"))


def op12_four_russians_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hypergeometric_shards": op1_hypergeometric_shards,
    "op2_token_counts": op2_token_counts,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_line_templates": op4_line_templates,
    "op5_phrase_fingerprints": op5_phrase_fingerprints,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_filters": op7_language_filters,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_simhash_components": op10_simhash_components,
    "op11_block_convolution_runs": op11_block_convolution_runs,
    "op12_four_russians_repair": op12_four_russians_repair,
    "op13_line_field_quality": op13_line_field_quality,
}

SQL: dict[str, str] = {"op4_line_templates": line_templates.SQL}
