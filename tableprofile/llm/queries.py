"""The operators over the given tables, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprofile.llm import (
    bpe,
    chat,
    fingerprints,
    jaccard,
    language,
    licenses,
    lines,
    packing,
    quality,
    repair,
    spelling,
    substrings,
    toxicity,
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, folder))


def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.substring_digest(documents(spark, folder))


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, folder))


def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_digest(documents(spark, folder))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.judge(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    # Texts without an id have no component; equal words tell their copies.
    words = F.when(F.col("doc_id").isNull(), packing.text_cluster(F.col("text")))
    found = jaccard.jaccard_components(docs, source=F.col("source").cast("string"), words=words)
    cluster = F.coalesce("component_id", "words").alias("cluster")
    return packing.pack_counted(found.select("doc_id", "source", cluster, F.col("n_words").alias("total")))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digest(documents(spark, folder), path, public_tokenizers.PATTERN)


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_digest(documents(spark, folder))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_digest(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_digest(documents(spark, folder))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder))


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_digest(conversations(spark, folder))


def op13_chat(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return chat.chat_digest(conversations(spark, folder), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_substrings": op2_substrings,
    "op3_jaccard": op3_jaccard,
    "op4_lines": op4_lines,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "op11_spelling": op11_spelling,
    "op12_repair": op12_repair,
    "op13_chat": op13_chat,
}

ORACLE: dict[str, str] = {
    "op2_substrings": substrings.PASSAGES_SQL,
    "op3_jaccard": jaccard.COMPONENTS_SQL,
    "op4_lines": lines.LINES_SQL,
    "op13_chat": chat.CHATS_SQL,
}
