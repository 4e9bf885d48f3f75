"""Ledger views, duplicate checks and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.naming import first_category
from .grouping import concat_ordered, latest_per_key


def active_files(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_deleted")).orderBy(F.desc("ingested_at"), "id")


def awaiting_confirmation(files: DataFrame) -> DataFrame:
    return (files.filter(F.col("status") == "awaiting_confirmation")
            .select("id", "original_filename", "category", "confidence", "ingested_at").orderBy("ingested_at", "id"))


def file_moves(files: DataFrame) -> DataFrame:
    renamed = F.when(F.col("original_filename") == F.col("current_filename"), "Nicht umbenannt").otherwise("Umbenannt")
    return (files.filter(F.col("moved_at").isNotNull() & ~F.col("is_deleted"))
            .select("id", "original_filename", "current_filename", "original_path", "current_path", "category",
                    "confidence", "ingested_at", "moved_at", renamed.alias("rename_status"))
            .orderBy(F.desc("moved_at"), "id"))


def error_files(files: DataFrame) -> DataFrame:
    return (files.filter(F.col("status") == "error")
            .select("id", "original_filename", "original_path", "status", "error_message", "processing_attempts", "ingested_at")
            .orderBy(F.desc("ingested_at"), "id"))


def category_stats(files: DataFrame) -> DataFrame:
    """Per category: files, whole megabytes, mean confidence, first and last ingest."""
    return (files.filter(~F.col("is_deleted")).groupBy("category")
            .agg(F.count("*").alias("file_count"),
                 F.expr("sum(file_size_bytes) div 1024 div 1024").alias("total_size_mb"),
                 F.avg("confidence").alias("avg_confidence"),
                 F.min("ingested_at").alias("first_ingested"), F.max("ingested_at").alias("last_ingested"))
            .orderBy(F.desc("file_count"), "category"))


def duplicates(files: DataFrame, hash_col: str = "sha256", name: str = "original_filename", path: str = "original_path") -> DataFrame:
    """Content that occurs more than once, with its names and paths joined by `` | ``."""
    live = files.filter(~F.col("is_deleted")).select(hash_col, name, path)
    repeated = live.groupBy(hash_col).agg(F.count("*").alias("duplicate_count")).filter("duplicate_count > 1")
    copies = live.join(repeated, hash_col)
    joined = concat_ordered(copies, [hash_col, "duplicate_count"], [path], {"filenames": (name, " | "), "paths": (path, " | ")})
    return joined.drop("group_rows")


def known_hashes(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """Incoming rows with a flag and the path already held for the same content."""
    held = ledger.groupBy("sha256").agg(F.min_by("current_path", "id").alias("held_path"))
    joined = incoming.join(held, "sha256", "left")
    return joined.withColumn("is_duplicate", F.col("held_path").isNotNull())


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Union of both sides reduced to the latest row per key."""
    return latest_per_key(current.unionByName(incoming, allowMissingColumns=True), keys, *[F.col(c) for c in order])


def needs_attention(files: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Files with an open problem and their quarantine reason, oldest first."""
    q = quarantine.select(F.col("file_id").alias("id"), "quarantine_reason", F.col("created_at").alias("quarantined_at"))
    wanted = F.col("status").isin("error", "awaiting_confirmation", "quarantined") | F.col("requires_confirmation")
    return (files.filter(wanted).join(q, "id", "left")
            .select("id", "original_filename", "category", "confidence", "status", "quarantine_reason", "quarantined_at", "ingested_at")
            .orderBy("ingested_at", "id"))


def folder_templates(files: DataFrame, templates: DataFrame, category: str = "category") -> DataFrame:
    """Template of each file's category. ``templates`` is a fixed dimension of a few rows."""
    dim = F.broadcast(templates.select(F.col("category").alias("_key"), "template"))
    joined = files.withColumn("_key", first_category(F.col(category))).join(dim, "_key", "left").drop("_key")
    return joined.withColumn("template", F.coalesce("template", F.lit("/archive/" + V.DEFAULT_CATEGORY)))


def stage_progress(files: DataFrame) -> DataFrame:
    """One row: totals, how many have text, how many are indexed, and the lag between them."""
    has_text = F.length("extracted_text") > V.SHORT_TEXT
    indexed = F.col("status").startswith("indexed")
    return files.agg(
        F.count("*").alias("total"), F.count_if(has_text).alias("extracted"), F.count_if(indexed).alias("indexed"),
        (F.count_if(has_text) - F.count_if(has_text & indexed)).alias("lag"),
        F.count_if(F.col("status") == "error").alias("errors"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("files"))


def size_stats(files: DataFrame, size: Column) -> DataFrame:
    """Count, total and mean size per extension."""
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.sum(size).alias("total_size"), F.avg(size).alias("avg_size"))
