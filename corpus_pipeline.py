"""Corpus pipeline: documents to token ids in five stages, each one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and gives it, read again, to the next one. All
but the last return the columns of the table they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, line_runs, quality_rules, sentencepieces, simhash
from shelfmark.llm.queries import MODEL
from shelfmark.llm.tables import write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality_rules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts, and documents that consist of nothing else go with them.
    A column n_chars follows the new text."""
    rows = line_runs.without_later_copies(docs)
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = rows.where((F.col("n_deleted") == 0) | has_words)
    return left.select(*(F.col("text").alias("text") if c == "text" else
                         F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
                         if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the least doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, with the round trip and the parity of each."""
    return sentencepieces.encode(docs, MODEL)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: SimHash and tokenisation have no SQL form; a test holds `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir)).frame
    return docs
