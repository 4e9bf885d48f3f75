"""Quality gates: six checks and a duplicate check decide between the archive and quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.lookup import first_case


def _gate(name: str, error: Column | None, warning: Column, score: Column) -> Column:
    passed = F.lit(True) if error is None else ~error
    severity = F.when(warning, "warning").otherwise("info")
    if error is not None:
        severity = F.when(error, "error").otherwise(severity)
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), severity.alias("severity"), score.alias("score"))


def gate_array(known_folders: Column | None = None) -> Column:
    """The gates in order as an array of structs over the columns of a candidate row: category,
    content_type, new_filename, target_folder, target_taken, confidence, text_length (characters of the extracted text),
    meta_description and is_duplicate."""
    category = F.trim(F.split_part(F.coalesce("category", F.lit("")), F.lit("|"), F.lit(1)))
    name = F.coalesce("new_filename", F.lit(""))
    folder = F.coalesce("target_folder", F.lit(""))
    length, description = F.coalesce("text_length", F.lit(0)), F.coalesce("meta_description", F.lit(""))
    confidence = F.coalesce("confidence", F.lit(0.0))
    odd_mime = first_case(
        [(category == c, ~reduce(lambda a, b: a | b, [F.coalesce("content_type", F.lit("")).startswith(p) for p in prefixes]))
         for c, prefixes in V.CATEGORY_MIME_PREFIXES.items()], False)
    off_pattern = ~name.rlike(V.FILENAME_PATTERN)
    forbidden = name.rlike(V.FORBIDDEN_NAME_CHARS)
    reachable = F.lit(True) if known_folders is None else known_folders
    one = F.lit(1.0)

    def score(ok: Column) -> Column:
        return F.when(ok, 1.0).otherwise(0.0)

    return F.array(
        _gate("CATEGORY_PLAUSIBILITY", ~category.isin(V.CATEGORIES), odd_mime, score(category.isin(V.CATEGORIES))),
        _gate("FILENAME_QUALITY", (name == "") | (~off_pattern & forbidden), off_pattern, score(~off_pattern)),
        _gate("TARGET_FOLDER_VALID", (folder == "") | ~folder.startswith("/") | ~reachable, F.lit(False), one),
        _gate("NO_COLLISION", (folder == "") | (name == "") | F.coalesce("target_taken", F.lit(False)), F.lit(False), one),
        _gate("CONFIDENCE_THRESHOLD", confidence < V.CONFIDENCE_MIN, confidence < V.CONFIDENCE_OK, confidence),
        _gate("CONTENT_EXTRACTED", (length == 0) & (description == ""),
              (length < V.SHORT_TEXT) & (F.length(description) < V.SHORT_DESCRIPTION), score(length >= V.SHORT_TEXT)),
        _gate("DUPLICATE_CHECK", F.coalesce("is_duplicate", F.lit(False)), F.lit(False), one))


def run_gates(candidates: DataFrame) -> DataFrame:
    """Candidates with their gates, the verdict, the first failed gate and the quarantine folder."""
    judged = candidates.withColumn("gates", gate_array())
    failed = F.filter("gates", lambda g: ~g["passed"])
    first = F.get(failed, F.lit(0))["name"]
    folder = (F.when(first == "DUPLICATE_CHECK", "_duplicates").when(first == "CONFIDENCE_THRESHOLD", "_low_confidence")
              .when(first.isNotNull(), "_review_needed").otherwise(""))
    warnings = F.size(F.filter("gates", lambda g: g["severity"] == "warning"))
    return (judged.withColumn("passed", F.size(failed) == 0).withColumn("quarantine_reason", F.coalesce(first, F.lit("")))
            .withColumn("quarantine_folder", folder).withColumn("warnings", warnings))


def with_targets_taken(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Mark candidates whose target path is already in use (``existing`` holds path)."""
    wanted = candidates.withColumn("_target", F.concat_ws("/", "target_folder", "new_filename"))
    taken = existing.select(F.col("path").alias("_target")).distinct().withColumn("target_taken", F.lit(True))
    return wanted.join(taken, "_target", "left").withColumn("target_taken", F.coalesce("target_taken", F.lit(False))).drop("_target")


def check_rows(judged: DataFrame, key: str = "id") -> DataFrame:
    """One quality-check row per gate."""
    g = judged.select(F.col(key).alias("file_id"), F.explode("gates").alias("g"))
    return g.select("file_id", F.col("g.name").alias("check_name"), F.col("g.passed").alias("check_passed"),
                    F.col("g.score").alias("check_score"), F.col("g.severity").alias("check_details"))
