"""Quarantine and quality-check reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .grouping import concat_ordered, previous_in_time


def quarantine_summary(log: DataFrame) -> DataFrame:
    return (log.groupBy("quarantine_reason")
            .agg(F.count("*").alias("count"), F.count_if(F.col("resolved_at").isNull()).alias("pending"),
                 F.count_if(F.col("resolved_at").isNotNull()).alias("resolved"))
            .orderBy(F.desc("count"), "quarantine_reason"))


def quarantine_pending(log: DataFrame, files: DataFrame) -> DataFrame:
    """Open cases with the file's name, type and size, oldest first."""
    f = files.select(F.col("id").alias("file_id"), "original_filename", "content_type", "file_size_bytes")
    return (log.filter(F.col("resolved_at").isNull())
            .select("id", "file_id", "quarantine_reason", "original_inbox_path", "quarantine_path", "error_message", "created_at")
            .join(f, "file_id").orderBy("created_at", "id"))


def gate_stats(checks: DataFrame) -> DataFrame:
    """Per check: total, passed, failed, pass rate in percent and mean score."""
    passed = F.sum(F.when(F.col("check_passed"), 1).otherwise(0))
    return (checks.groupBy("check_name")
            .agg(F.count("*").alias("total_checks"), passed.alias("passed"),
                 F.sum(F.when(~F.col("check_passed"), 1).otherwise(0)).alias("failed"),
                 F.round(F.lit(100.0) * passed / F.count("*"), 2).alias("pass_rate_percent"),
                 F.avg("check_score").alias("avg_score"))
            .orderBy("pass_rate_percent", "check_name"))


def repeated_failures(attempts: DataFrame) -> DataFrame:
    """Files that failed at least twice, with the stages and the distinct messages."""
    failed = attempts.filter(~F.col("success"))
    totals = failed.groupBy("sha256").agg(
        F.count("*").alias("attempt_count"), F.max("attempt_number").alias("max_attempts"),
        F.array_join(F.array_sort(F.collect_set("processing_stage")), ",").alias("failed_stages")).filter("attempt_count >= 2")
    messages = failed.select("sha256", "error_message").distinct()
    joined = concat_ordered(messages, ["sha256"], ["error_message"], {"errors": ("error_message", " | ")})
    return totals.join(joined.drop("group_rows"), "sha256")


def quarantine_on_error(status_log: DataFrame, key: str = "file_hash", ts: str = "ts") -> DataFrame:
    """One quarantine row for each change of a file's status into ``failed``."""
    seen = previous_in_time(status_log, [key], "status", ts, "id", name="_before")
    turned = seen.filter((F.col("status") == "failed") & (F.coalesce("_before", F.lit("")) != "failed"))
    return turned.select(
        "id", key, F.lit("PROCESSING_ERROR").alias("quarantine_reason"),
        F.concat(F.lit("/quarantine/_processing_error/"), "filename").alias("quarantine_path"), "error_message",
        F.col(ts).alias("created_at"))
