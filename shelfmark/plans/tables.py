"""Engine tables derived from the driver tables.

Each derived table is one SELECT in the dialect both Spark SQL and the checking database understand,
so the checked queries and their SQL twins start from the same rows. The few words that differ are
filled in by ``Dialect``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import spread

EXTENSIONS = ".pdf,.docx,.doc,.xlsx,.txt,.md,.csv,.json,.eml,.html,.jpg,.png,.mp3,.wav,.mp4,.mkv,.zip,.7z,.py,.bak"
MIMES = (
    "application/pdf,application/vnd.openxmlformats-officedocument,application/msword,application/vnd.ms-excel,"
    "text/plain,text/markdown,text/csv,application/json,message/rfc822,text/html,image/jpeg,image/png,audio/mpeg,"
    "audio/wav,video/mp4,video/x-matroska,application/zip,application/x-7z-compressed,text/x-python,application/octet-stream"
)
CATEGORIES = (
    "Finanzen,Arbeit,Privat,Medien,Dokumente,Technologie,Gesundheit,Reisen,Sonstiges,Unsortiert,"
    "Finanzen,Arbeit,Medien,Medien,Medien,Medien,Dokumente,Dokumente,Technologie,Sonstiges"
)
NAME_WORDS = "rechnung,backup,notes,vertrag,scan,photo,kopie,invoice,report,altbestand,bank,plan"
ERRORS = (
    "connection refused by host,file is empty,ocr error on page,operation timed out,"
    "unsupported format,cannot allocate buffer,strange failure"
)
STAGES = "intake,route,extract,enrich,index"
EPOCH = 1704067200


@dataclass(frozen=True)
class Dialect:
    sha: str
    ts: str
    json: str
    arr: str


SPARK = Dialect("sha2({0}, 256)", "timestamp_seconds({0})", "get_json_object({0}, '$.{1}')", "array({0})")
DUCK = Dialect("sha256({0})", "make_timestamp(CAST({0} AS BIGINT) * 1000000)", "json_extract_string({0}, '$.{1}')", "list_value({0})")


def files_sql(d: Dialect) -> str:
    """Ledger rows: one per document; attributes come from source, language and length."""
    return f"""
SELECT id, {d.sha.format('text')} AS sha256, extension, category, author, content_type, language, n_chars,
       name AS original_filename,
       CASE WHEN language = 'en' THEN name ELSE '2024-01-01_' || category || '_' || name END AS current_filename,
       '/inbox/' || author || '/' || name AS original_path,
       '/archive/' || category || '/' || CASE WHEN language = 'en' THEN name ELSE '2024-01-01_' || category || '_' || name END AS current_path,
       n_chars * 32768 AS file_size_bytes, confidence, status, text AS extracted_text,
       {d.ts.format(f'{EPOCH} + id * 977')} AS ingested_at,
       CASE WHEN status = 'indexed' THEN {d.ts.format(f'{EPOCH + 90} + id * 977')} END AS moved_at,
       CASE WHEN status = 'error' THEN split_part('{ERRORS}', ',', CAST(n_chars % 7 AS INT) + 1) END AS error_message,
       n_chars % 4 AS processing_attempts, n_chars BETWEEN 100 AND 160 AS is_deleted,
       confidence < 4e-1 AS requires_confirmation, {d.arr.format('language, author')} AS tags
FROM (SELECT *, CASE WHEN n_chars < 100 THEN 'error' WHEN n_chars > 12000 THEN 'quarantined'
                     WHEN confidence < 5e-1 THEN 'awaiting_confirmation' ELSE 'indexed' END AS status
      FROM (SELECT doc_id AS id, text, lang AS language, source AS author, n_chars,
                   split_part('{EXTENSIONS}', ',', CAST(substr(source, 4) AS INT) + 1) AS extension,
                   split_part('{MIMES}', ',', CAST(substr(source, 4) AS INT) + 1) AS content_type,
                   split_part('{CATEGORIES}', ',', CAST(substr(source, 4) AS INT) + 1) AS category,
                   split_part('{NAME_WORDS}', ',', CAST(n_chars % 12 AS INT) + 1) || '_' || lang || '_' || CAST(doc_id AS VARCHAR(20))
                       || split_part('{EXTENSIONS}', ',', CAST(substr(source, 4) AS INT) + 1) AS name,
                   3e-1 + 7e-1 * (CAST(n_chars % 97 AS DOUBLE) / 96) AS confidence
            FROM documents) AS typed) AS rated"""


def audit_sql(d: Dialect) -> str:
    """Audit trail: one row per event."""
    return f"""
SELECT event_id AS id, 'f' || k AS file_hash, 'file_' || k || '.pdf' AS filename, stage,
       CASE event_type WHEN 'click' THEN 'started' WHEN 'signup' THEN 'started' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
       'worker-' || CAST(user_id AS VARCHAR(20)) AS worker_id, stage || '-worker' AS worker_type,
       CASE WHEN stage IN ('intake', 'route') THEN 'intake:normal' ELSE stage || ':documents' END AS queue_name,
       ts, CAST(floor(value * 10) AS INT) AS processing_time_ms,
       CASE WHEN event_type = 'error' THEN split_part('{ERRORS}', ',', CAST(user_id % 7 AS INT) + 1) END AS error_message,
       CAST(user_id % 4 AS INT) AS retry_count, event_type, user_id
FROM (SELECT *, {d.json.format('props', 'k')} AS k,
             split_part('{STAGES}', ',', CAST(user_id % 5 AS INT) + 1) AS stage FROM events) AS parsed"""


def quarantine_sql(d: Dialect) -> str:
    """Quarantine log of the files that are not indexed."""
    return f"""
SELECT id, id AS file_id, sha256,
       CASE status WHEN 'error' THEN 'PROCESSING_ERROR' WHEN 'quarantined' THEN 'SIZE_LIMIT' ELSE 'LOW_CONFIDENCE' END AS quarantine_reason,
       '/quarantine/' || original_filename AS quarantine_path, original_path AS original_inbox_path, error_message,
       {d.ts.format(f'{EPOCH + 3600} + id * 977')} AS created_at,
       CASE WHEN language IN ('de', 'fr') THEN {d.ts.format(f'{EPOCH + 7200} + id * 977')} END AS resolved_at
FROM files WHERE status <> 'indexed'"""


CORRECTIONS_SQL = """
SELECT f.sha256 AS file_hash, f.id AS id, f.original_filename AS filename, f.category AS predicted_category,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Dokumente' WHEN l.quality = 1 THEN 'Privat'
            WHEN l.toxic = 0 THEN 'Arbeit' ELSE 'Sonstiges' END AS actual_category,
       f.current_path AS predicted_path,
       CASE WHEN l.toxic = 0 THEN '/archive/' ||
            CASE WHEN l.quality = 1 THEN 'Dokumente' ELSE 'Arbeit' END || '/' || f.current_filename END AS actual_path,
       f.confidence AS predicted_confidence, f.ingested_at AS ts
FROM labels l JOIN files f ON f.id = l.doc_id"""

INVENTORY_SQL = """
SELECT original_path AS path, original_filename AS filename, extension, file_size_bytes AS size_bytes,
       CAST(file_size_bytes AS DOUBLE) / 1048576 AS size_mb, ingested_at AS modified_ts,
       CAST(n_chars % 14 AS INT) AS depth, id, sha256
FROM files"""

FILES = f"files AS ({files_sql(DUCK)})"
AUDIT = f"audit AS ({audit_sql(DUCK)})"
QUARANTINE = f"{FILES}, quarantine AS ({quarantine_sql(DUCK)})"
CORRECTIONS = f"{FILES}, corrections AS ({CORRECTIONS_SQL})"
INVENTORY = f"{FILES}, inventory AS ({INVENTORY_SQL})"


class Tables:
    """Driver tables by name and the engine tables built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC times

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def docs(self) -> DataFrame:
        """Documents for steps that work on their texts, read by all cores."""
        return spread(self.documents, "doc_id")

    @property
    def html(self) -> DataFrame:
        return spread(self.pages, "page_id")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run a SELECT over given frames without leaving views behind."""
        for name, frame in frames.items():
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
        return self.spark.sql(text, **frames)

    def files(self) -> DataFrame:
        return self.sql(files_sql(SPARK), documents=self.documents)

    def text_files(self) -> DataFrame:
        """Ledger rows for steps that work on the extracted texts."""
        return self.sql(files_sql(SPARK), documents=self.docs)

    def audit(self) -> DataFrame:
        return self.sql(audit_sql(SPARK), events=self.events)

    def quarantine(self) -> DataFrame:
        return self.sql(quarantine_sql(SPARK), files=self.files())

    def corrections(self) -> DataFrame:
        return self.sql(CORRECTIONS_SQL, labels=self.labels, files=self.files())

    def inventory(self) -> DataFrame:
        return self.sql(INVENTORY_SQL, files=self.files())

    def as_of(self, frame: DataFrame, column: str):
        """Latest timestamp of a column as a scalar subquery."""
        return frame.agg(F.max(column).alias("as_of")).scalar()


def ts_text(column: Column | str) -> Column:
    """Timestamps as text, to the second, for comparison across engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
