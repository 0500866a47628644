"""The queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, infill, lm, mixing, pii, quality, ruleset, shards, simhash, substring, tokenfile, tokens, trie
from tidewatch.llm.oracle import ORACLE
from tidewatch.session import shared_dir

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf, "documents"), k=20, with_text=False)
    return out.drop("removed_spans")


@query
def op2_backoff_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = lm.score_texts(table(spark, sf, "documents"), order=3, folds=7, held_out=2)
    # the order of a sum shows in the last bits
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@query
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id",
        "quality.n_words",
        "quality.word_chars",
        "quality.n_symbols",
        "quality.n_dup_lines",
        "quality.n_repeat_words",
        "quality.base_failed",
        "quality.kept",
    )


@query
def op6_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), n=13)
    return found.drop("items", "spans")


@query
def op8_simhash_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), threshold=4, width=4)


@query
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_poisson_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).select(
        "doc_id",
        "source",
        F.col("mix_copy").alias("copy"),
        F.round("mix_rate", 6).alias("rate"),
        F.col("mix_key").alias("order_key"),
    )


@query
def op9_interleaved_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = shards.interleave(table(spark, sf, "documents"), shards=8)
    return out.drop("source").withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op10_token_file(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = tokenfile.write_tokens(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfile.describe(spark, path, files)


#: stands for the key that a user keeps in a secret store
PII_KEY = b"a key for the test tables"


@query
def op7_feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), PII_KEY)
    replaced = F.aggregate(F.map_values("pii_counts"), F.lit(0).cast("long"), lambda t, x: t + x)
    return out.select("doc_id", "text", replaced.alias("n_replaced"), F.array_join(F.map_keys("pii_counts"), ",").alias("kinds"))


@query
def op11_rule_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return ruleset.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


@query
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf, "conversations"))
