"""The corpus pipeline: five stages over ``documents``, each the whole of what the one before kept.

Quality rules drop rejected documents, SimHash keeps one document of each group of near copies, the
benchmark's contaminated documents go, sources are mixed to target weights, and the token ids of the
mixture are written and read back. Every stage returns the columns of ``documents`` but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, mixing, quality, simhash, tokenfile
from tidewatch.session import shared_dir, stage_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, and the smallest text hash among its rows."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(*docs.columns)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = tokenfile.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.describe(spark, path, files)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_file", token_file),
]

#: near-duplicate groups and tokenization are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
