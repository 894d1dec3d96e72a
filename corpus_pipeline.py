"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents; the last returns packed token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provider_analytics.llm import fair_mix, jaccard_join, language_id, packing, pii
from provider_analytics.llm.common import BATCH_ROWS, batches_of, table, written
from provider_analytics.llm.queries import END_ID, PACK_LIMITS, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, whatever their language column says; every other has a best language and stays. A
    missing language is filled in. Where no row is labelled, nothing is learned and all documents stay as they are."""
    batches_of(spark, BATCH_ROWS)
    columns = docs.columns
    model = language_id.fit_languages(docs)
    if not model.languages:
        return docs
    found = docs.withColumn("_found", language_id.language_column(F.col("text"), model))
    kept = found.filter(F.col("_found.lang_pred") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "_found.lang_pred")).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Ids may repeat."""
    return jaccard_join.without_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars follows the text."""
    batches_of(spark, BATCH_ROWS)
    columns = docs.columns
    clean = docs.withColumn("text", pii.redact_column(F.col("text"), pii.fit_pii(docs)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice."""
    return fair_mix.mixed_documents(docs, weights=(5, 2, 1), share=1.5, repeats=2, seed=7)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, with their ids."""
    batches_of(spark, BATCH_ROWS)
    return packing.pack(packing.tokenize(docs, tokenizer_path(), END_ID), PACK_LIMITS)


STAGES = [
    ("language identification", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: No stage can be said in SQL as a whole; tests check the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
