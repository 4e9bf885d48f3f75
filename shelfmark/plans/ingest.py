"""The batch ingest chain: hash, clean, mask, classify, name, gate, then ledger or quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.naming import smart_filename, target_folder
from ..functions.pii import mask_pii, pii_counts
from ..functions.text import content_hash
from ..operators import classify, gates, ledger
from ..session import cut_lineage


def prepare(files: DataFrame) -> DataFrame:
    """Rows of id, filename, content_type, text and ingested_at as gate candidates: hashed on the raw text,
    masked before anything else sees it, classified, named and given a target folder."""
    hashed = files.withColumn("sha256", content_hash(F.col("text"))).withColumn("_pii", pii_counts(F.col("text")))
    labels = F.flatten(F.array(*[F.array_repeat(F.lit(n), F.col(f"_pii.{n}").cast("int")) for n in ("email", "iban", "phone", "date")]))
    masked = hashed.withColumn("extracted_text", mask_pii(F.col("text"))).withColumn("category", classify.category(F.col("text"), labels))
    day = F.date_format("ingested_at", "yyyy-MM-dd")
    return masked.select(
        "id", "sha256", "filename", "content_type", "category", F.lit(0.85).alias("confidence"), "extracted_text", F.length("extracted_text").alias("text_length"),
        F.lit("").alias("meta_description"), smart_filename(F.col("filename"), F.col("category"), F.lit(""), day).alias("new_filename"),
        target_folder(F.col("category")).alias("target_folder"), "ingested_at")


def ingest(files: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ledger rows and quarantine rows. ``stored`` is the ledger so far (id, sha256, current_path).

    Content known to the ledger, or seen earlier in the same batch, is a duplicate."""
    candidates = cut_lineage(prepare(files))  # texts are masked once, then used by gates, ledger and quarantine
    texts = candidates.select("id", "extracted_text")
    candidates = candidates.drop("extracted_text")  # the gates need its length alone
    first = candidates.groupBy("sha256").agg(F.min("id").alias("_first"))
    known = ledger.known_hashes(candidates.select("id", "sha256"), stored).select("id", F.col("is_duplicate").alias("_known"))
    flagged = (candidates.join(first, "sha256").join(known, "id")
               .withColumn("is_duplicate", F.col("_known") | (F.col("id") > F.col("_first"))).drop("_known", "_first"))
    judged = gates.run_gates(gates.with_targets_taken(flagged, stored.select(F.col("current_path").alias("path"))))
    accepted = judged.filter("passed").join(texts, "id").select(
        "id", "sha256", F.col("filename").alias("original_filename"), F.col("new_filename").alias("current_filename"),
        F.concat_ws("/", "target_folder", "new_filename").alias("current_path"), "category", "confidence", "extracted_text",
        F.lit("indexed").alias("status"), "ingested_at")
    rejected = judged.filter("NOT passed").select(
        "id", "sha256", "filename", "quarantine_reason", F.concat(F.lit("/quarantine/"), "quarantine_folder", F.lit("/"), "filename").alias("quarantine_path"),
        F.col("ingested_at").alias("created_at"))
    return accepted, rejected
