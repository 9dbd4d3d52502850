"""Corpus pipeline: language ID, line dedup, near-dedup by word shingles, secret scan and best-fit packing over documents.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All stages but the last
return the columns of documents; the last one returns the packed token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import langid, line_templates, near_copies, packing, secrets
from tickloom.llm.common import table, written

#: Columns of documents, in their order.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (null texts and texts without a letter); lang becomes the predicted one.

    A text of letters that has no learned n-gram (score 0) stays with the lang that it has.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    kept = langid.predict(docs.select(*COLUMNS), model).where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn("lang", F.when(F.col("score") > 0, F.col("lang_pred")).otherwise(F.col("lang"))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences of recurring templates go from all documents but the first; n_chars follows the text."""
    cleaned = line_templates.drop_recurring(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word Jaccard 0.8) stays, the one with the smallest doc_id (null last).

    Candidates come from SimHash with pigeonring filtering, and from a prefix filter for the copies that it misses; all are
    verified.
    """
    return near_copies.keep_one(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset.

    Workers are kept from the stages before, so they encode a megabyte of text at a time and remember fewer words.
    """
    return packing.pack(docs, slice_bytes=1 << 20, known_bytes=16 << 20)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens, fingerprints and learned languages can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each reads what the one before it wrote, so a stage that reads its rows twice sees the same ones."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
