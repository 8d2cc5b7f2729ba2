"""Raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. The stages but the last return the columns of
``documents``, with ``n_chars`` counted anew where the text changed.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.llm.common import bounded_batches, free_name, shared_ids, small_side, versioned
from tidepanel.llm.lines import drop_lines
from tidepanel.llm.ngram import ngram_join
from tidepanel.llm.packing import pack
from tidepanel.llm.pii import redact
from tidepanel.llm.quality import quality_rules
from tidepanel.session import drop_scratch, scratch_scope, staged


def _step(stage):
    """A stage that first deletes what the stage before it staged: its result is written by then. Its Arrow batches are bounded by bytes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, "stage")
        bounded_batches(spark)
        with scratch_scope("stage"):
            return stage(spark, docs, sf_dir)

    return run


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs


@_step
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the verdict on their host reject go."""
    digest: Column = F.xxhash64("text")
    judged = quality_rules(docs.select("doc_id", "source", "text").withColumn("digest", digest))
    out = small_side(judged.where("not kept").select(F.col("doc_id").alias("r_doc"), F.col("digest").alias("r_digest")).distinct())
    return docs.join(out, docs["doc_id"].eqNullSafe(out["r_doc"]) & (F.xxhash64(docs["text"]) == out["r_digest"]), "left_anti")


@_step
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly, go, and so do documents of which no word is left."""
    return _counted(drop_lines(docs, emptied=False), docs.columns)


@_step
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word Jaccard similarity of 0.8 or more, the one of the smallest id stays.

    Rows of one id and one text are one document. Different texts of one id are judged each for itself, under a number of their own.
    """
    key, version = free_name("key", docs), free_name("version", docs)
    rows = versioned(docs, shared_ids(docs), version)
    rows = rows.withColumn(key, F.when(F.col(version) == 0, F.col("doc_id").cast("long")).otherwise(F.xxhash64("doc_id", version)))
    found = ngram_join(rows, n=5, percent=80, key=key)
    out = small_side(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct())
    return rows.join(out, rows[key] == out["gone"], "left_anti").select(*docs.columns)


@_step
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return _counted(redact(docs), docs.columns)


@_step
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed token pieces of the documents."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The tokenizer and the span model of the last two stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        result = stage(spark, docs, sf_dir)
        with scratch_scope(f"docs{k % 2}"):
            docs = staged(result, name)
        drop_scratch(spark, f"docs{1 - k % 2}")
    return STAGES[-1][1](spark, docs, sf_dir)
