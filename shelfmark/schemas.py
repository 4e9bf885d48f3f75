"""Schemas of the engine tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    """Schema from ``name type`` pairs separated by commas, without needing a session."""
    simple = {
        "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(),
        "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()),
        "map": T.MapType(T.StringType(), T.StringType()),
        "listmap": T.MapType(T.StringType(), T.ArrayType(T.StringType())),
    }
    return T.StructType([T.StructField(n, simple[t]) for n, t in (part.split() for part in ddl.split(","))])


INVENTORY = _struct("path string, filename string, extension string, size_bytes long, modified_ts timestamp, status string, "
                    "scan_ts timestamp, depth int")
FILES = _struct("sha256 string, file_size_bytes long, original_filename string, current_filename string, original_path string, "
                "current_path string, category string, subcategory string, confidence double, meta_description string, tags strings, "
                "entities listmap, content_type string, extracted_text string, language string, page_count int, duration double, "
                "ingested_at timestamp, moved_at timestamp, status string, error_message string, processing_attempts int, is_deleted boolean")
CATEGORY_FOLDER = _struct("category string, template string")
AUDIT_TRAIL = _struct("file_hash string, filename string, stage string, status string, worker_id string, worker_type string, "
                      "queue_name string, ts timestamp, processing_time_ms int, error_message string, retry_count int, metadata map")
QUARANTINE_LOG = _struct("id long, file_id long, sha256 string, quarantine_reason string, quarantine_path string, "
                         "original_inbox_path string, error_message string, created_at timestamp, resolved_at timestamp, resolution string")
QUALITY_CHECKS = _struct("file_id long, check_name string, check_passed boolean, check_score double, check_details string")
PROCESSING_ATTEMPTS = _struct("sha256 string, attempt_number int, success boolean, error_message string, processing_stage string")
CORRECTIONS = _struct("file_hash string, filename string, predicted_category string, actual_category string, predicted_path string, "
                      "actual_path string, predicted_confidence double, correction_type string, ts timestamp")
CORRECTION_PATTERNS = _struct("predicted_category string, actual_category string, occurrence_count long, last_seen timestamp")
JOBS = _struct("id string, path string, filename string, extension string, size long, modified timestamp, mime string, priority int, "
               "processing_path string, status string, retries int, error string")
EXTRACTIONS = _struct("job_id string, file_path string, text string, metadata map, entities listmap, confidence double, method string, "
                      "time_ms long, ts timestamp")
CHUNKS = _struct("chunk_id string, file_id string, idx int, content string, embedding floats, file_name string, extension string, "
                 "folder string, tags strings, uploaded_at timestamp")
QUERY_SET = _struct("id string, modality string, query string, expected_ids strings, notes string")
GOLDEN = _struct("id string, query string, expectedMarkers strings, minResponseLength int")
CHATS = _struct("id string, title string, created_at timestamp, sources strings")
MESSAGES = _struct("chat_id string, message_id string, turn long, role string, text string, status string, created_at timestamp")
