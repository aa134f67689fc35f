"""Corpus pipeline: stages over ``documents``, each calling one training-data operator.

Each stage works on all rows that the one before it kept.  Stages return the
columns of ``documents``, the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillcast.llm import langid, packing, secrets, simhash, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told (no text, no letters)."""
    return langid.keep_identified(docs, langid.train(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; learned from the labels of the documents still here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; no document goes."""
    return secrets.redact(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("secrets", redacted),
          ("packing", packed)]

# Trained models and tokenizers are not expressible in SQL; tests/llm/test_pipeline.py
# holds the rows against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
