"""Corrections made by users: counts, patterns, trends, confusion matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import correction_type, monday_week


def typed_corrections(corrections: DataFrame) -> DataFrame:
    kind = correction_type(*[F.col(c) for c in ("predicted_category", "actual_category", "predicted_path", "actual_path")])
    return corrections.withColumn("correction_type", kind)


def by_type(corrections: DataFrame) -> DataFrame:
    return typed_corrections(corrections).groupBy("correction_type").agg(F.count("*").alias("corrections"))


def confusion(pairs: DataFrame, predicted: str = "predicted_category", actual: str = "actual_category") -> DataFrame:
    """Long form of the confusion matrix."""
    return pairs.groupBy(predicted, actual).agg(F.count("*").alias("n"))


def confusion_wide(pairs: DataFrame, labels: list[str], predicted: str = "predicted_category", actual: str = "actual_category") -> DataFrame:
    """One column per actual label. The labels are given, so no job runs to find them."""
    return pairs.groupBy(predicted).pivot(actual, labels).agg(F.count(F.lit(1))).na.fill(0)


def patterns(corrections: DataFrame) -> DataFrame:
    """How often each pair of categories was corrected, and when last."""
    return corrections.groupBy("predicted_category", "actual_category").agg(
        F.count("*").alias("occurrence_count"), F.max("ts").alias("last_seen"))


def merge_patterns(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add new pattern counts to stored ones."""
    return stored.unionByName(fresh).groupBy("predicted_category", "actual_category").agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.max("last_seen").alias("last_seen"))


def top_patterns(found: DataFrame, top: int = 10) -> DataFrame:
    return found.orderBy(F.desc("occurrence_count"), "predicted_category", "actual_category").limit(top)


def review_list(found: DataFrame, at_least: int = 3) -> DataFrame:
    """Categories whose files should be looked at again, with a message."""
    message = F.format_string("Dateien in '%s' sollten auf '%s' geprüft werden", "predicted_category", "actual_category")
    return (found.filter(F.col("occurrence_count") >= at_least)
            .select(F.col("predicted_category").alias("problematic_category"), F.col("actual_category").alias("correct_category"),
                    "occurrence_count", message.alias("suggestion"))
            .orderBy(F.desc("occurrence_count"), "problematic_category", "correct_category"))


def weekly(corrections: DataFrame, last: int = 12) -> DataFrame:
    return (corrections.groupBy(monday_week(F.col("ts")).alias("week")).agg(F.count("*").alias("corrections"))
            .orderBy(F.desc("week")).limit(last))


def monthly(corrections: DataFrame, last: int = 6) -> DataFrame:
    return (corrections.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("corrections"))
            .orderBy(F.desc("month")).limit(last))


def training_export(corrections: DataFrame) -> DataFrame:
    return corrections.select(
        "file_hash", "filename", F.col("predicted_category").alias("predicted"), F.col("actual_category").alias("actual"),
        F.col("predicted_confidence").alias("confidence"), F.col("ts").alias("timestamp")).orderBy(F.desc("timestamp"), "file_hash", "filename")


def predicted_and_actual(predicted: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    return predicted.join(actual, key)
