"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.chats import damage_report
from tidepanel.llm.codes import code_report
from tidepanel.llm.common import documents
from tidepanel.llm.fingerprints import fingerprints
from tidepanel.llm.leaks import leak_report
from tidepanel.llm.licenses import license_scan
from tidepanel.llm.lines import line_report
from tidepanel.llm.ngram import ngram_join
from tidepanel.llm.packing import pack
from tidepanel.llm.passages import drop_passages
from tidepanel.llm.pii import pii_report
from tidepanel.llm.quality import quality_rules
from tidepanel.llm.sentencepieces import piece_report
from tidepanel.llm.transducer import token_counts
from tidepanel.llm.twins import ORACLES  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rates = ("rate_short", "rate_repeats", "rate_symbols", "rate_dup_lines")
    judged = quality_rules(documents(spark, folder).select("doc_id", "source", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source",
        *(F.round(r, 6).alias(r) for r in rates),
    )


@query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_report(documents(spark, folder))


@query
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(documents(spark, folder))


@query
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(documents(spark, folder), n=3, percent=90)


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder))


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_report(documents(spark, folder))


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_report(documents(spark, folder))
    return found.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder))


@query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(documents(spark, folder)).withColumn("score", F.round("score", 6))


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_passages(documents(spark, folder))


@query
def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leak_report(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return code_report(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return damage_report(spark.read.parquet(f"{folder}/conversations.parquet"))
