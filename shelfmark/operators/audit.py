"""Audit trail reports. ``as_of`` stands for the current time and is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import retryable
from .. import fixed_values as V
from .grouping import number_in_time


def before(as_of: Column, text: str) -> Column:
    return as_of - F.expr(f"INTERVAL {text}")


def recent_failures(audit: DataFrame, as_of: Column) -> DataFrame:
    return (audit.filter((F.col("status") == "failed") & (F.col("ts") > before(as_of, "24 HOURS")))
            .select("file_hash", "filename", "stage", "error_message", "retry_count", "ts", "worker_id")
            .orderBy(F.desc("ts"), "file_hash"))


def stuck(audit: DataFrame, as_of: Column, stage: str = "extract") -> DataFrame:
    """Rows of a stage still ``started`` after ten minutes."""
    return (audit.filter((F.col("stage") == stage) & (F.col("status") == "started") & (F.col("ts") < before(as_of, "10 MINUTES")))
            .select("file_hash", "filename", "ts", "worker_id"))


def trail_of(audit: DataFrame, file_hash: str) -> DataFrame:
    return (audit.filter(F.col("file_hash") == file_hash)
            .select("stage", "status", "worker_id", "ts", "processing_time_ms", "error_message").orderBy("ts"))


def stage_status(audit: DataFrame) -> DataFrame:
    """Latest status of every stage of a file as a map, with first and last time and total milliseconds."""
    per_stage = audit.groupBy("file_hash", "filename", "stage").agg(
        F.max_by("status", F.struct("ts", "id")).alias("status"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_updated"),
        F.sum("processing_time_ms").alias("ms"))
    return per_stage.groupBy("file_hash", "filename").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "status")))).alias("stages"),
        F.min("first_seen").alias("first_seen"), F.max("last_updated").alias("last_updated"),
        F.sum("ms").alias("total_processing_ms"))


def worker_stats(audit: DataFrame, as_of: Column) -> DataFrame:
    return (audit.filter(F.col("ts") > before(as_of, "1 HOUR")).groupBy("worker_type", "worker_id")
            .agg(F.count("*").alias("jobs_processed"), F.count_if(F.col("status") == "completed").alias("successful"),
                 F.count_if(F.col("status") == "failed").alias("failed"),
                 F.avg("processing_time_ms").alias("avg_processing_ms"), F.max("ts").alias("last_active")))


def queue_throughput(audit: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Jobs and mean milliseconds per minute and queue, over the last hour or, without ``as_of``, over all."""
    rows = audit if as_of is None else audit.filter(F.col("ts") > before(as_of, "1 HOUR"))
    return rows.groupBy(F.date_trunc("minute", "ts").alias("minute"), "queue_name").agg(
        F.count("*").alias("jobs"), F.avg("processing_time_ms").alias("avg_ms"))


def queue_depth(jobs: DataFrame, acked: DataFrame, key: str = "id") -> DataFrame:
    """Pending jobs per queue and in total."""
    pending = jobs.join(acked.select(key), key, "left_anti")
    return pending.rollup("queue_name").agg(F.count("*").alias("pending")).withColumn(
        "queue_name", F.coalesce("queue_name", F.lit("TOTAL")))


def retry_plan(audit: DataFrame) -> DataFrame:
    """What happens to each failed attempt: retried while below the limit and retryable, else dead."""
    failed = audit.filter(F.col("status") == "failed")
    again = retryable(F.col("error_message")) & (F.col("retry_count") < V.MAX_RETRIES)
    return failed.withColumn("decision", F.when(again, "retry").otherwise("dead_letter"))


def numbered_attempts(audit: DataFrame) -> DataFrame:
    """Failed attempts of each file and stage numbered in time order."""
    return number_in_time(retry_plan(audit), ["file_hash", "stage"], "ts", "id", name="attempt")
