"""Checked queries over inventory, ledger, audit trail, quarantine and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.naming import smart_filename, target_folder
from ..functions.scoring import classify_error, retryable
from ..operators import audit, feedback, gates, inventory, ledger, quarantine
from ..operators.grouping import latest_per_key
from .registry import query
from .tables import AUDIT, CORRECTIONS, FILES, INVENTORY, QUARANTINE, Tables, ts_text

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def texts(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, ts_text(c))
    return df


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), digits))
    return df


TRIAGED = f"""{INVENTORY}, triaged AS (SELECT *, CASE WHEN lower(extension) IN ({sql_list(V.READY_EXTENSIONS)})
    THEN 'READY_FOR_INGEST' ELSE 'IGNORED' END AS status FROM inventory)"""

# --- inventory --------------------------------------------------------------------------------


@query("p1_triage_status", f"WITH {TRIAGED} SELECT path, extension, status FROM triaged")
def _(t: Tables):
    return inventory.triage(t.inventory()).select("path", "extension", "status")


@query("p2_work_list", f"""WITH {TRIAGED} SELECT path, {TS.format('modified_ts')} AS modified_ts FROM triaged
  WHERE status = 'READY_FOR_INGEST' AND path NOT IN (SELECT original_path FROM files WHERE status = 'indexed')
  ORDER BY triaged.modified_ts DESC, path LIMIT 50""")
def _(t: Tables):
    done = t.files().filter("status = 'indexed'").select(F.col("original_path").alias("path"))
    listed = inventory.work_list(inventory.triage(t.inventory()), "READY_FOR_INGEST", done, "path", "modified_ts", 50)
    return texts(listed.select("path", "modified_ts"), "modified_ts")


@query("a9_extension_stats", f"""WITH {INVENTORY}, s AS (
    SELECT CASE WHEN coalesce(extension, '') = '' THEN '[no_extension]' ELSE lower(extension) END AS extension,
           count(*) AS files, round(sum(size_mb), 4) AS size_mb FROM inventory GROUP BY 1)
  (SELECT *, 'count' AS ranking FROM s ORDER BY files DESC, extension LIMIT 20)
  UNION ALL (SELECT *, 'size' AS ranking FROM s ORDER BY size_mb DESC, extension LIMIT 20)""")
def _(t: Tables):
    return rounded(inventory.extension_stats(t.inventory()), "size_mb", digits=4)


@query("a10_inventory_flags", f"""WITH {INVENTORY} SELECT path, size_mb, depth, size_mb > 2000 AS is_large, depth > 10 AS is_deep,
    {' OR '.join(f"contains(lower(filename), '{w}')" for w in V.RED_FLAG_WORDS)} AS is_red_flag FROM inventory""")
def _(t: Tables):
    return inventory.inventory_flags(t.inventory())


@query("a10_largest_files", f"""WITH {INVENTORY} SELECT path, size_mb FROM inventory WHERE size_mb > 500
  ORDER BY size_mb DESC, path LIMIT 20""")
def _(t: Tables):
    return inventory.largest_files(t.inventory(), above_mb=500).select("path", "size_mb")


@query("a11_triage_report", f"""WITH {TRIAGED}, e AS (SELECT status, lower(extension) AS item, count(*) AS files FROM triaged GROUP BY ALL)
  SELECT 'status' AS section, status AS item, count(*) AS files,
         round(100.0 * count(*) / (SELECT count(*) FROM triaged), 2)::DOUBLE AS percent FROM triaged GROUP BY status
  UNION ALL (SELECT 'ready', item, files, NULL FROM e WHERE status = 'READY_FOR_INGEST' ORDER BY files DESC, item LIMIT 20)
  UNION ALL (SELECT 'ignored', item, files, NULL FROM e WHERE status = 'IGNORED' ORDER BY files DESC, item LIMIT 10)""")
def _(t: Tables):
    return inventory.triage_report(inventory.triage(t.inventory()))


@query("a12_capacity_estimate", f"""WITH {INVENTORY}, k AS (SELECT CASE WHEN extension IN ({sql_list(V.TEXT_EXTENSIONS)}) THEN 'text'
    WHEN extension IN ({sql_list(V.MEDIA_EXTENSIONS)}) THEN 'media' ELSE 'other' END AS kind, size_mb FROM inventory)
  SELECT kind, count(*) AS files, round(sum(size_mb), 4) AS size_mb,
    round(count(*) * CASE kind WHEN 'text' THEN 35 WHEN 'media' THEN 2 ELSE 1 END / 3600.0, 6)::DOUBLE AS hours,
    round(count(*) * CASE kind WHEN 'text' THEN 3 ELSE 0 END / 1024.0 / 1024.0, 6)::DOUBLE AS vector_gb,
    round(count(*) / 1024.0 / 1024.0, 6)::DOUBLE AS ledger_gb FROM k GROUP BY kind""")
def _(t: Tables):
    return rounded(rounded(inventory.capacity_estimate(t.inventory()), "size_mb", digits=4), "hours", "vector_gb", "ledger_gb")


SNAPSHOTS = f"""{INVENTORY},
  previous AS (SELECT i.path, i.size_bytes + l.toxic AS size_bytes FROM inventory i JOIN labels l ON l.doc_id = i.id),
  present AS (SELECT path, size_bytes FROM inventory WHERE extension <> '.bak')"""


def snapshots(t: Tables):
    inv = t.inventory()
    previous = inv.join(t.labels, inv.id == F.col("doc_id")).select("path", (F.col("size_bytes") + F.col("toxic")).alias("size_bytes"))
    return previous, inv.filter("extension <> '.bak'").select("path", "size_bytes")


@query("j4_snapshot_diff", f"""WITH {SNAPSHOTS} SELECT path, p.size_bytes AS old_value, c.size_bytes AS new_value,
    CASE WHEN p.size_bytes IS NULL THEN 'new' WHEN c.size_bytes IS NULL THEN 'gone'
         WHEN p.size_bytes <> c.size_bytes THEN 'changed' ELSE 'same' END AS change
  FROM previous p FULL OUTER JOIN present c USING (path)""")
def _(t: Tables):
    return inventory.snapshot_diff(*snapshots(t))


@query("j10_excluded_roots", f"""WITH {INVENTORY}, roots AS (SELECT '/inbox/src' || CAST(s_nationkey AS VARCHAR) AS root FROM supplier WHERE s_acctbal < 0)
  SELECT path FROM inventory i WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE i.path = r.root OR starts_with(i.path, r.root || '/'))""")
def _(t: Tables):
    roots = t.supplier.filter("s_acctbal < 0").select(F.concat(F.lit("/inbox/src"), F.col("s_nationkey").cast("string")).alias("root"))
    return inventory.without_excluded(t.inventory(), roots).select("path")


@query("j11_path_match", f"""WITH {FILES}, hits AS (SELECT id AS hit_id, upper(replace(current_path, '/archive/', 'D:\\')) AS hit_path FROM files)
  SELECT hit_id, id FROM hits, files WHERE lower(trim(replace(hit_path, '\\', '/'))) = lower(trim(replace(original_path, '\\', '/')))
     OR ends_with(lower(trim(replace(hit_path, '\\', '/'))), '/' || regexp_extract(lower(original_path), '([^/]+)$', 1))""")
def _(t: Tables):
    files = t.files()
    hits = files.select(F.col("id").alias("hit_id"), F.upper(F.replace("current_path", F.lit("/archive/"), F.lit("D:\\"))).alias("hit_path"))
    return inventory.match_paths(hits, files.select("id", "original_path"), "hit_path", "original_path").select("hit_id", "id")


@query("j16_verify_migration", f"""WITH {INVENTORY}, mapping AS (SELECT DISTINCT author AS root, '/target/' || author AS target_root FROM files),
  source AS (SELECT author AS root, original_filename AS rel_path, file_size_bytes AS size_bytes, sha256 FROM files),
  target AS (SELECT '/target/' || f.author || '/' || f.original_filename AS path, f.file_size_bytes + coalesce(l.toxic, 0) AS size_bytes,
             CASE WHEN f.language = 'es' THEN 'x' ELSE f.sha256 END AS sha256 FROM files f LEFT JOIN labels l ON l.doc_id = f.id WHERE NOT is_deleted),
  j AS (SELECT s.root, rel_path, target_root || '/' || rel_path AS expected_path,
        CASE WHEN t.size_bytes IS NULL THEN 'MISSING' WHEN t.size_bytes <> s.size_bytes THEN 'SIZE_MISMATCH'
             WHEN t.sha256 <> s.sha256 THEN 'CORRUPT' END AS issue
        FROM source s JOIN mapping m ON s.root = m.root LEFT JOIN target t ON t.path = target_root || '/' || rel_path)
  SELECT * FROM j WHERE issue IS NOT NULL""")
def _(t: Tables):
    files = t.files()
    mapping = files.select(F.col("author").alias("root"), F.concat(F.lit("/target/"), "author").alias("target_root")).distinct()
    source = files.select(F.col("author").alias("root"), F.col("original_filename").alias("rel_path"),
                          F.col("file_size_bytes").alias("size_bytes"), "sha256")
    target = files.filter("NOT is_deleted").join(t.labels, F.col("id") == F.col("doc_id"), "left").select(
        F.concat_ws("/", F.lit("/target"), "author", "original_filename").alias("path"),
        (F.col("file_size_bytes") + F.coalesce("toxic", F.lit(0))).alias("size_bytes"),
        F.when(F.col("language") == "es", "x").otherwise(F.col("sha256")).alias("sha256"))
    return inventory.verify_migration(source, target, mapping)


@query("j17_collisions", f"""WITH {FILES}, existing AS (SELECT '/sorted/' || original_filename AS path, CASE WHEN status = 'indexed' THEN sha256 ELSE 'other' END AS sha256
      FROM files WHERE language <> 'en'),
  j AS (SELECT f.id, '/sorted/' || f.original_filename AS target_path,
        CASE WHEN e.sha256 IS NULL THEN 'MOVED' WHEN e.sha256 = f.sha256 THEN 'SKIPPED' ELSE 'RESOLVED' END AS action
        FROM files f LEFT JOIN existing e ON e.path = '/sorted/' || f.original_filename)
  SELECT id, action, CASE action WHEN 'MOVED' THEN target_path WHEN 'RESOLVED' THEN
     regexp_replace(target_path, '^(.*?)(\\.[^./]*)?$', '\\1_CONFLICT_20240201\\2') END AS final_path FROM j""")
def _(t: Tables):
    files = t.files()
    existing = files.filter("language <> 'en'").select(
        F.concat(F.lit("/sorted/"), "original_filename").alias("path"),
        F.when(F.col("status") == "indexed", F.col("sha256")).otherwise("other").alias("sha256"))
    incoming = files.select("id", "sha256", F.concat(F.lit("/sorted/"), "original_filename").alias("target_path"))
    return inventory.resolve_collisions(incoming, existing, "20240201").select("id", "action", "final_path")


@query("j18_folder_mapping", f"""WITH {FILES}, mapping AS (SELECT upper(n_name) AS folder, 'nation/' || n_name AS target FROM nation
      UNION ALL SELECT upper(c), 'area/' || c FROM (SELECT DISTINCT category AS c FROM files WHERE category <> 'Sonstiges'))
  SELECT id, coalesce(m.target, '_rest/' || category) AS target FROM files LEFT JOIN mapping m ON lower(m.folder) = lower(category)""")
def _(t: Tables):
    files = t.files()
    areas = files.filter("category <> 'Sonstiges'").select("category").distinct().select(
        F.upper("category").alias("folder"), F.concat(F.lit("area/"), "category").alias("target"))
    nations = t.nation.select(F.upper("n_name").alias("folder"), F.concat(F.lit("nation/"), "n_name").alias("target"))
    return inventory.map_folders(files, "category", nations.unionByName(areas), "_rest").select("id", "target")


@query("a33_reconcile", f"""WITH {INVENTORY}, s AS (SELECT author, count(*) AS source_files, sum(file_size_bytes)::BIGINT AS source_bytes FROM files GROUP BY 1),
  g AS (SELECT author, count(*) AS target_files, sum(file_size_bytes)::BIGINT AS target_bytes FROM files WHERE status <> 'error' GROUP BY 1),
  b AS (SELECT author, coalesce(source_files, 0) AS source_files, coalesce(target_files, 0) AS target_files,
        coalesce(source_bytes, 0) AS source_bytes, coalesce(target_bytes, 0) AS target_bytes FROM s FULL OUTER JOIN g USING (author))
  SELECT *, CASE WHEN target_files >= source_files AND target_bytes >= source_bytes THEN 0 ELSE source_files - target_files END AS missing_files,
     CASE WHEN target_files >= source_files AND target_bytes >= source_bytes THEN 0.0::DOUBLE ELSE round((source_bytes - target_bytes)::DOUBLE / 1073741824, 2) END AS missing_gb,
     target_files >= source_files AND target_bytes >= source_bytes AS complete FROM b""")
def _(t: Tables):
    files = t.files().select("author", "status", F.col("file_size_bytes").alias("size_bytes"))
    return inventory.reconcile(files, files.filter("status <> 'error'"), "author")


@query("w6_sample_per_extension", f"""WITH {INVENTORY}, r AS (SELECT extension, path, size_bytes, row_number() OVER (PARTITION BY extension ORDER BY size_bytes, path) - 1 AS rank,
     count(*) OVER (PARTITION BY extension) AS n FROM inventory)
  SELECT * FROM r WHERE n < 2 OR rank = n // 2 OR rank = 0""")
def _(t: Tables):
    return inventory.sample_per_extension(t.inventory())


@query("p10_names_like", f"""WITH {FILES} SELECT id, original_filename FROM files WHERE lower(original_filename) LIKE '%rechnung%'
  OR lower(original_filename) LIKE '%vertrag%' OR lower(original_filename) LIKE '%bank%'""")
def _(t: Tables):
    return inventory.names_like(t.files(), ["Rechnung", "Vertrag", "Bank"]).select("id", "original_filename")


@query("p11_find_all_words", f"""WITH {FILES} SELECT id, original_path FROM files
  WHERE (contains(lower(original_filename), 'rechnung') OR contains(lower(original_path), 'rechnung'))
    AND (contains(lower(original_filename), 'src1') OR contains(lower(original_path), 'src1')) ORDER BY original_path LIMIT 10""")
def _(t: Tables):
    return inventory.find_all_words(t.files(), "Rechnung src1", 10).select("id", "original_path")

# --- ledger -----------------------------------------------------------------------------------


@query("p3_active_files", f"WITH {FILES} SELECT id, sha256, category, {TS.format('ingested_at')} AS ingested_at FROM files WHERE NOT is_deleted")
def _(t: Tables):
    return texts(ledger.active_files(t.files()).select("id", "sha256", "category", "ingested_at"), "ingested_at")


@query("p4_awaiting_confirmation", f"""WITH {FILES} SELECT id, original_filename, category, round(confidence, 6) AS confidence,
  {TS.format('ingested_at')} AS ingested_at FROM files WHERE status = 'awaiting_confirmation'""")
def _(t: Tables):
    return texts(rounded(ledger.awaiting_confirmation(t.files()), "confidence"), "ingested_at")


@query("p5_file_moves", f"""WITH {FILES} SELECT id, original_filename, current_filename, original_path, current_path, category,
  round(confidence, 6) AS confidence, {TS.format('ingested_at')} AS ingested_at, {TS.format('moved_at')} AS moved_at,
  CASE WHEN original_filename = current_filename THEN 'Nicht umbenannt' ELSE 'Umbenannt' END AS rename_status
  FROM files WHERE moved_at IS NOT NULL AND NOT is_deleted""")
def _(t: Tables):
    return texts(rounded(ledger.file_moves(t.files()), "confidence"), "ingested_at", "moved_at")


@query("p6_error_files", f"""WITH {FILES} SELECT id, original_filename, original_path, status, error_message, processing_attempts,
  {TS.format('ingested_at')} AS ingested_at FROM files WHERE status = 'error'""")
def _(t: Tables):
    return texts(ledger.error_files(t.files()), "ingested_at")


@query("a1_category_stats", f"""WITH {FILES} SELECT category, count(*) AS file_count, (sum(file_size_bytes) // 1024 // 1024)::BIGINT AS total_size_mb,
  round(avg(confidence), 6) AS avg_confidence, {TS.format('min(ingested_at)')} AS first_ingested, {TS.format('max(ingested_at)')} AS last_ingested
  FROM files WHERE NOT is_deleted GROUP BY category""")
def _(t: Tables):
    return texts(rounded(ledger.category_stats(t.files()), "avg_confidence"), "first_ingested", "last_ingested")


@query("a2_duplicates", f"""WITH {FILES} SELECT sha256, count(*) AS duplicate_count,
  string_agg(original_filename, ' | ' ORDER BY original_path) AS filenames, string_agg(original_path, ' | ' ORDER BY original_path) AS paths
  FROM files WHERE NOT is_deleted GROUP BY sha256 HAVING count(*) > 1""")
def _(t: Tables):
    return ledger.duplicates(t.files())


@query("j2_known_hashes", f"""WITH {FILES}, held AS (SELECT sha256, arg_min(current_path, id) AS held_path FROM files WHERE status = 'indexed' AND language <> 'es' GROUP BY 1)
  SELECT f.id, held_path, held_path IS NOT NULL AS is_duplicate FROM files f LEFT JOIN held USING (sha256)""")
def _(t: Tables):
    files = t.files()
    held = files.filter("status = 'indexed' AND language <> 'es'")
    return ledger.known_hashes(files.select("id", "sha256"), held).select("id", "held_path", "is_duplicate")


@query("j19_needs_attention", f"""WITH {QUARANTINE} SELECT f.id, original_filename, category, round(confidence, 6) AS confidence, status, quarantine_reason,
  {TS.format('q.created_at')} AS quarantined_at, {TS.format('ingested_at')} AS ingested_at FROM files f LEFT JOIN quarantine q ON q.file_id = f.id
  WHERE status IN ('error', 'awaiting_confirmation', 'quarantined') OR requires_confirmation""")
def _(t: Tables):
    return texts(rounded(ledger.needs_attention(t.files(), t.quarantine()), "confidence"), "quarantined_at", "ingested_at")


@query("j6_folder_templates", f"""WITH {FILES}, m AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in V.FOLDER_TEMPLATES.items())}) AS v(k, template))
  SELECT id, category, coalesce(template, '/archive/Sonstiges') AS template FROM files LEFT JOIN m ON m.k = category""")
def _(t: Tables):
    dim = t.spark.createDataFrame(list(V.FOLDER_TEMPLATES.items()), "category string, template string")
    return ledger.folder_templates(t.files(), dim).select("id", "category", "template")


@query("a24_stage_progress", f"""WITH {FILES} SELECT count(*) AS total, count(*) FILTER (length(extracted_text) > 50) AS extracted,
  count(*) FILTER (starts_with(status, 'indexed')) AS indexed,
  count(*) FILTER (length(extracted_text) > 50) - count(*) FILTER (length(extracted_text) > 50 AND starts_with(status, 'indexed')) AS lag,
  count(*) FILTER (status = 'error') AS errors FROM files""")
def _(t: Tables):
    return ledger.stage_progress(t.files())


@query("a24_status_counts", f"WITH {FILES} SELECT status, count(*) AS files FROM files GROUP BY status")
def _(t: Tables):
    return ledger.status_counts(t.files())


@query("s15_upsert_latest", f"""WITH {FILES}, u AS (SELECT sha256, id, status, ingested_at FROM files UNION ALL
     SELECT sha256, id, 'relabelled', moved_at FROM files JOIN labels l ON l.doc_id = id AND l.toxic = 1 WHERE moved_at IS NOT NULL)
  SELECT sha256, id, status FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY ingested_at DESC, id DESC, status DESC) AS rn FROM u) WHERE rn = 1""")
def _(t: Tables):
    files = t.files()
    fresh = files.filter("moved_at IS NOT NULL").join(t.labels.filter("toxic = 1"), F.col("id") == F.col("doc_id")).select(
        "sha256", "id", F.lit("relabelled").alias("status"), F.col("moved_at").alias("ingested_at"))
    stored = files.select("sha256", "id", "status", "ingested_at")
    return ledger.upsert(stored, fresh, ["sha256"], "ingested_at", "id", "status").select("sha256", "id", "status")


@query("w8_latest_per_key", f"""WITH {AUDIT} SELECT file_hash, id, status FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY ts DESC, id DESC) AS rn FROM audit) WHERE rn = 1""")
def _(t: Tables):
    return latest_per_key(t.audit(), ["file_hash"], F.col("ts"), F.col("id")).select("file_hash", "id", "status")


@query("w9_most_recent", f"WITH {FILES} SELECT id, original_filename FROM files ORDER BY ingested_at DESC, id LIMIT 10")
def _(t: Tables):
    return t.files().orderBy(F.desc("ingested_at"), "id").limit(10).select("id", "original_filename")

# --- audit ------------------------------------------------------------------------------------

AS_OF = "(SELECT max(ts) FROM audit)"


@query("p7_recent_failures", f"""WITH {AUDIT} SELECT file_hash, filename, stage, error_message, retry_count, {TS.format('ts')} AS ts, worker_id
  FROM audit WHERE status = 'failed' AND ts > {AS_OF} - INTERVAL 24 HOUR""")
def _(t: Tables):
    trail = t.audit()
    return texts(audit.recent_failures(trail, t.as_of(trail, "ts")), "ts")


@query("p8_stuck_jobs", f"""WITH {AUDIT} SELECT file_hash, filename, {TS.format('ts')} AS ts, worker_id FROM audit
  WHERE stage = 'extract' AND status = 'started' AND ts < {AS_OF} - INTERVAL 10 MINUTE""")
def _(t: Tables):
    trail = t.audit()
    return texts(audit.stuck(trail, t.as_of(trail, "ts")), "ts")


@query("p9_audit_trail_of_file", f"""WITH {AUDIT} SELECT stage, status, worker_id, {TS.format('ts')} AS ts, processing_time_ms, error_message
  FROM audit WHERE file_hash = 'f42'""")
def _(t: Tables):
    return texts(audit.trail_of(t.audit(), "f42"), "ts")


@query("a6_stage_status", f"""WITH {AUDIT}, s AS (SELECT file_hash, filename, stage, arg_max(status, ts) AS status, min(ts) AS a, max(ts) AS b,
     sum(processing_time_ms) AS ms FROM audit GROUP BY ALL)
  SELECT file_hash, filename, string_agg(stage || '=' || status, ',' ORDER BY stage) AS stages, {TS.format('min(a)')} AS first_seen,
    {TS.format('max(b)')} AS last_updated, sum(ms)::BIGINT AS total_processing_ms FROM s GROUP BY ALL""")
def _(t: Tables):
    out = audit.stage_status(t.audit())
    listed = F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return texts(out.withColumn("stages", listed), "first_seen", "last_updated")


@query("a7_worker_stats", f"""WITH {AUDIT} SELECT worker_type, worker_id, count(*) AS jobs_processed, count(*) FILTER (status = 'completed') AS successful,
  count(*) FILTER (status = 'failed') AS failed, round(avg(processing_time_ms), 6) AS avg_processing_ms, {TS.format('max(ts)')} AS last_active
  FROM audit WHERE ts > {AS_OF} - INTERVAL 1 HOUR GROUP BY ALL""")
def _(t: Tables):
    trail = t.audit()
    return texts(rounded(audit.worker_stats(trail, t.as_of(trail, "ts")), "avg_processing_ms"), "last_active")


@query("a8_queue_throughput", f"""WITH {AUDIT} SELECT {TS.format("date_trunc('minute', ts)")} AS minute, queue_name, count(*) AS jobs,
  round(avg(processing_time_ms), 6) AS avg_ms FROM audit WHERE ts > {AS_OF} - INTERVAL 1 HOUR GROUP BY date_trunc('minute', ts), queue_name""")
def _(t: Tables):
    trail = t.audit()
    return texts(rounded(audit.queue_throughput(trail, t.as_of(trail, "ts")), "avg_ms"), "minute")


@query("a8_queue_throughput_all", f"""WITH {AUDIT} SELECT {TS.format("date_trunc('minute', ts)")} AS minute, queue_name, count(*) AS jobs,
  round(avg(processing_time_ms), 6) AS avg_ms FROM audit GROUP BY date_trunc('minute', ts), queue_name""")
def _(t: Tables):
    return texts(rounded(audit.queue_throughput(t.audit()), "avg_ms"), "minute")


@query("a25_queue_depth", f"""WITH {AUDIT}, p AS (SELECT queue_name FROM audit WHERE id NOT IN (SELECT id FROM audit WHERE status = 'completed'))
  SELECT coalesce(queue_name, 'TOTAL') AS queue_name, count(*) AS pending FROM p GROUP BY ROLLUP (queue_name)""")
def _(t: Tables):
    trail = t.audit()
    return audit.queue_depth(trail, trail.filter("status = 'completed'"))


def error_case(column: str, field: int) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(coalesce({column}, '')), '{w}')" for w in words) + f" THEN '{group[field]}'"
        for *group, words in V.ERROR_PATTERNS)
    return f"CASE {arms} ELSE '{V.UNKNOWN_ERROR[field]}' END"


@query("c19_error_class", f"""WITH {AUDIT} SELECT id, error_message, {error_case('error_message', 0)} AS error_source,
  {error_case('error_message', 1)} AS error_type, {error_case('error_message', 0)} <> 'SOURCE_FILE' AS retry FROM audit WHERE status = 'failed'""")
def _(t: Tables):
    failed = t.audit().filter("status = 'failed'").withColumn("c", classify_error(F.col("error_message")))
    return failed.select("id", "error_message", "c.error_source", "c.error_type", "c.retry")


@query("w12_numbered_attempts", f"""WITH {AUDIT} SELECT id, row_number() OVER (PARTITION BY file_hash, stage ORDER BY ts, id) AS attempt,
  CASE WHEN {error_case('error_message', 0)} <> 'SOURCE_FILE' AND retry_count < 3 THEN 'retry' ELSE 'dead_letter' END AS decision
  FROM audit WHERE status = 'failed'""")
def _(t: Tables):
    return audit.numbered_attempts(t.audit()).select("id", "attempt", "decision")

# --- quarantine and gates ---------------------------------------------------------------------


@query("a3_quarantine_summary", f"""WITH {QUARANTINE} SELECT quarantine_reason, count(*) AS count, count(*) FILTER (resolved_at IS NULL) AS pending,
  count(*) FILTER (resolved_at IS NOT NULL) AS resolved FROM quarantine GROUP BY 1""")
def _(t: Tables):
    return quarantine.quarantine_summary(t.quarantine())


@query("j1_quarantine_pending", f"""WITH {QUARANTINE} SELECT q.id, q.file_id, quarantine_reason, original_inbox_path, quarantine_path, q.error_message,
  {TS.format('created_at')} AS created_at, original_filename, content_type, file_size_bytes FROM quarantine q JOIN files f ON q.file_id = f.id WHERE resolved_at IS NULL""")
def _(t: Tables):
    return texts(quarantine.quarantine_pending(t.quarantine(), t.files()), "created_at")


@query("a5_repeated_failures", f"""WITH {AUDIT}, f AS (SELECT * FROM audit WHERE status = 'failed')
  SELECT file_hash AS sha256, count(*) AS attempt_count, max(retry_count + 1) AS max_attempts, string_agg(DISTINCT stage, ',' ORDER BY stage) AS failed_stages,
    string_agg(DISTINCT error_message, ' | ' ORDER BY error_message) AS errors FROM f GROUP BY file_hash HAVING count(*) >= 2""")
def _(t: Tables):
    attempts = t.audit().select(F.col("file_hash").alias("sha256"), (F.col("retry_count") + 1).alias("attempt_number"),
                                (F.col("status") != "failed").alias("success"), "error_message", F.col("stage").alias("processing_stage"))
    return quarantine.repeated_failures(attempts)


@query("st6_quarantine_on_error_batch", f"""WITH {AUDIT}, l AS (SELECT *, lag(status) OVER (PARTITION BY file_hash ORDER BY ts, id) AS before FROM audit)
  SELECT id, file_hash, 'PROCESSING_ERROR' AS quarantine_reason, '/quarantine/_processing_error/' || filename AS quarantine_path, error_message,
    {TS.format('ts')} AS created_at FROM l WHERE status = 'failed' AND coalesce(before, '') <> 'failed'""")
def _(t: Tables):
    return texts(quarantine.quarantine_on_error(t.audit()), "created_at")


def candidates(t: Tables) -> DataFrame:
    """Ledger rows as they reach the gates: generated name, target folder, collisions, duplicates."""
    files = t.text_files()
    firsts = files.groupBy("sha256").agg(F.min("id").alias("first_id"))
    rows = files.join(firsts, "sha256").select(
        "id", "sha256", "category", "content_type", "confidence", F.length("extracted_text").alias("text_length"), F.lit("").alias("meta_description"),
        smart_filename(F.col("original_filename"), F.col("category"), F.lit(""), F.date_format("ingested_at", "yyyy-MM-dd")).alias("new_filename"),
        target_folder(F.col("category")).alias("target_folder"), (F.col("id") > F.col("first_id")).alias("is_duplicate"))
    taken = files.filter("is_deleted").select(
        F.concat_ws("/", target_folder(F.col("category")),
                    smart_filename(F.col("original_filename"), F.col("category"), F.lit(""), F.date_format("ingested_at", "yyyy-MM-dd"))).alias("path"))
    return gates.with_targets_taken(rows, taken)


NEW_NAME = "strftime(ingested_at, '%Y-%m-%d') || '_' || category || '_' || substr(left(original_filename, length(original_filename) - length(extension)), 1, 30) || extension"
ODD_MIME = "CASE " + " ".join(
    f"WHEN category = '{c}' THEN NOT ({' OR '.join(f'''starts_with(content_type, '{p}')''' for p in ps)})"
    for c, ps in V.CATEGORY_MIME_PREFIXES.items()) + " ELSE false END"
GATES = f"""{FILES}, firsts AS (SELECT sha256, min(id) AS first_id FROM files GROUP BY 1),
  named AS (SELECT f.*, {NEW_NAME} AS new_filename, CASE WHEN category = 'Unsortiert' THEN 'Sonstiges' ELSE category END AS folder,
    f.id > first_id AS is_duplicate FROM files f JOIN firsts USING (sha256)),
  taken AS (SELECT DISTINCT folder, new_filename FROM named WHERE is_deleted),
  g AS (SELECT n.id, confidence, length(extracted_text) AS n_text,
    category <> 'Unsortiert' AS ok1, {ODD_MIME} AS warn1,
    regexp_matches(n.new_filename, '(?i)^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}_[A-Za-zäöüÄÖÜß]+_[\\p{{L}}\\p{{N}}_\\-]+\\.[a-z0-9]+$') AS on_pattern,
    t.folder IS NULL AS ok4, confidence >= 0.5::DOUBLE AS ok5, confidence < 0.7::DOUBLE AS warn5, length(extracted_text) > 0 AS ok6, NOT is_duplicate AS ok7
    FROM named n LEFT JOIN taken t ON t.folder = n.folder AND t.new_filename = n.new_filename)"""


@query("c22_quality_gates", f"""WITH {GATES}, v AS (SELECT *, CASE WHEN NOT ok1 THEN 'CATEGORY_PLAUSIBILITY' WHEN NOT ok4 THEN 'NO_COLLISION'
    WHEN NOT ok5 THEN 'CONFIDENCE_THRESHOLD' WHEN NOT ok6 THEN 'CONTENT_EXTRACTED' WHEN NOT ok7 THEN 'DUPLICATE_CHECK' ELSE '' END AS quarantine_reason FROM g)
  SELECT id, quarantine_reason = '' AS passed, quarantine_reason, CASE quarantine_reason WHEN '' THEN '' WHEN 'DUPLICATE_CHECK' THEN '_duplicates'
    WHEN 'CONFIDENCE_THRESHOLD' THEN '_low_confidence' ELSE '_review_needed' END AS quarantine_folder,
    (ok1 AND warn1)::INT + (NOT on_pattern)::INT + (ok5 AND warn5)::INT + (ok6 AND n_text < 50)::INT AS warnings FROM v""")
def _(t: Tables):
    return gates.run_gates(candidates(t)).select("id", "passed", "quarantine_reason", "quarantine_folder", "warnings")


@query("a4_gate_stats", f"""WITH {GATES}, c AS (
    SELECT 'CATEGORY_PLAUSIBILITY' AS check_name, ok1 AS p, ok1::INT::DOUBLE AS s FROM g UNION ALL
    SELECT 'FILENAME_QUALITY', true, on_pattern::INT FROM g UNION ALL SELECT 'TARGET_FOLDER_VALID', true, 1 FROM g UNION ALL
    SELECT 'NO_COLLISION', ok4, 1 FROM g UNION ALL SELECT 'CONFIDENCE_THRESHOLD', ok5, confidence FROM g UNION ALL
    SELECT 'CONTENT_EXTRACTED', ok6, (n_text >= 50)::INT FROM g UNION ALL SELECT 'DUPLICATE_CHECK', ok7, 1 FROM g)
  SELECT check_name, count(*) AS total_checks, sum(p::INT)::BIGINT AS passed, sum((NOT p)::INT)::BIGINT AS failed,
    round(100.0 * sum(p::INT) / count(*), 2)::DOUBLE AS pass_rate_percent, round(avg(s), 6) AS avg_score FROM c GROUP BY check_name""")
def _(t: Tables):
    stats = quarantine.gate_stats(gates.check_rows(gates.run_gates(candidates(t))))
    return rounded(rounded(stats, "avg_score"), "pass_rate_percent", digits=2)


@query("corpus_category_stats", f"""WITH {FILES}, kept AS (SELECT arg_min(category, id) AS category, arg_min(confidence, id) AS confidence, arg_min(file_size_bytes, id) AS size
    FROM files WHERE length(extracted_text) > 50 GROUP BY sha256)
  SELECT category, count(*) AS files, (sum(size) // 1024 // 1024)::BIGINT AS size_mb, round(avg(confidence), 6) AS avg_confidence FROM kept
  WHERE confidence >= 0.5::DOUBLE GROUP BY category""")
def _(t: Tables):
    texts_ = t.files().filter(F.length("extracted_text") > 50).select("sha256", "id", "category", "confidence", "file_size_bytes")
    kept = texts_.groupBy("sha256").agg(*[F.min_by(c, "id").alias(c) for c in ("category", "confidence", "file_size_bytes")])
    stats = kept.filter(F.col("confidence") >= V.CONFIDENCE_MIN).groupBy("category").agg(
        F.count("*").alias("files"), F.expr("sum(file_size_bytes) div 1024 div 1024").alias("size_mb"), F.avg("confidence").alias("avg_confidence"))
    return rounded(stats, "avg_confidence")

# --- feedback ---------------------------------------------------------------------------------

TYPED = f"""{CORRECTIONS}, typed AS (SELECT *, CASE WHEN coalesce(predicted_path, '') <> '' AND coalesce(actual_path, '') <> '' AND predicted_category <> actual_category THEN 'both'
  WHEN coalesce(predicted_path, '') <> '' AND coalesce(actual_path, '') <> '' THEN 'path' ELSE 'category' END AS correction_type FROM corrections)"""
PATTERNS = f"{CORRECTIONS}, patterns AS (SELECT predicted_category, actual_category, count(*) AS occurrence_count, max(ts) AS last_seen FROM corrections GROUP BY 1, 2)"
ACTUALS = ["Arbeit", "Dokumente", "Privat", "Sonstiges"]


@query("a13_correction_types", f"WITH {TYPED} SELECT correction_type, count(*) AS corrections FROM typed GROUP BY 1")
def _(t: Tables):
    return feedback.by_type(t.corrections())


@query("c39_correction_type", f"WITH {TYPED} SELECT id, correction_type FROM typed")
def _(t: Tables):
    return feedback.typed_corrections(t.corrections()).select("id", "correction_type")


@query("a14_confusion", f"WITH {CORRECTIONS} SELECT predicted_category, actual_category, count(*) AS n FROM corrections GROUP BY 1, 2")
def _(t: Tables):
    return feedback.confusion(t.corrections())


@query("a14_confusion_wide", f"""WITH {CORRECTIONS} SELECT predicted_category, {', '.join(f"count(*) FILTER (actual_category = '{c}') AS {c}" for c in ACTUALS)}
  FROM corrections GROUP BY 1""")
def _(t: Tables):
    return feedback.confusion_wide(t.corrections(), ACTUALS)


@query("a15_patterns", f"WITH {PATTERNS} SELECT predicted_category, actual_category, 2 * occurrence_count AS occurrence_count, {TS.format('last_seen')} AS last_seen FROM patterns")
def _(t: Tables):
    stored = feedback.patterns(t.corrections())
    return texts(feedback.merge_patterns(stored, feedback.patterns(t.corrections())), "last_seen")


@query("a16_top_patterns", f"WITH {PATTERNS} SELECT predicted_category, actual_category, occurrence_count FROM patterns ORDER BY 3 DESC, 1, 2 LIMIT 10")
def _(t: Tables):
    return feedback.top_patterns(feedback.patterns(t.corrections())).drop("last_seen")


@query("a16_review_list", f"""WITH {PATTERNS} SELECT predicted_category AS problematic_category, actual_category AS correct_category, occurrence_count,
  'Dateien in ''' || predicted_category || ''' sollten auf ''' || actual_category || ''' geprüft werden' AS suggestion FROM patterns WHERE occurrence_count >= 3""")
def _(t: Tables):
    return feedback.review_list(feedback.patterns(t.corrections()))


@query("a17_weekly", f"WITH {CORRECTIONS} SELECT strftime(ts, '%Y-W%W') AS week, count(*) AS corrections FROM corrections GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def _(t: Tables):
    return feedback.weekly(t.corrections())


@query("a17_monthly", f"WITH {CORRECTIONS} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS corrections FROM corrections GROUP BY 1 ORDER BY 1 DESC LIMIT 6")
def _(t: Tables):
    return feedback.monthly(t.corrections())


@query("s16_training_export", f"""WITH {CORRECTIONS} SELECT file_hash, filename, predicted_category AS predicted, actual_category AS actual,
  round(predicted_confidence, 6) AS confidence, {TS.format('ts')} AS timestamp FROM corrections""")
def _(t: Tables):
    return texts(rounded(feedback.training_export(t.corrections()), "confidence"), "timestamp")


@query("j5_moved_by_user", f"""WITH {FILES}, seen AS (SELECT DISTINCT f.sha256, CASE WHEN l.toxic = 1 THEN '/archive/Privat/' ELSE '/archive/Finanzen-alt/' END || f.sha256 AS new_path
      FROM files f JOIN labels l ON l.doc_id = f.id), cats AS (SELECT f.id, f.sha256, new_path, f.current_path, f.original_filename, round(confidence, 6) AS confidence,
      CASE WHEN category IN ('Finanzen', 'Arbeit', 'Privat', 'Medien') THEN category ELSE 'Sonstiges' END AS old_cat,
      CASE WHEN new_path LIKE '/archive/Privat/%' THEN 'Privat' ELSE 'Finanzen-alt' END AS new_cat FROM files f JOIN seen USING (sha256))
  SELECT sha256 AS file_hash, original_filename AS filename, old_cat AS predicted_category, new_cat AS actual_category, current_path AS predicted_path,
    new_path AS actual_path, confidence AS predicted_confidence, 'both' AS correction_type FROM cats WHERE old_cat <> new_cat""")
def _(t: Tables):
    files = t.files()
    root = F.when(F.col("toxic") == 1, "/archive/Privat/").otherwise("/archive/Finanzen-alt/")
    seen = files.join(t.labels, F.col("id") == F.col("doc_id")).select("sha256", F.concat(root, "sha256").alias("new_path")).distinct()
    return rounded(inventory.moved_by_user(files, seen), "predicted_confidence")


@query("j15_predicted_actual", f"""WITH {CORRECTIONS} SELECT f.id, f.category AS predicted, c.actual_category AS actual, f.category = c.actual_category AS agrees
  FROM files f JOIN corrections c ON c.id = f.id""")
def _(t: Tables):
    predicted = t.files().select("id", F.col("category").alias("predicted"))
    actual = t.corrections().select("id", F.col("actual_category").alias("actual"))
    return feedback.predicted_and_actual(predicted, actual).withColumn("agrees", F.col("predicted") == F.col("actual"))


@query("st5_retry_or_dead_batch", f"""WITH {AUDIT} SELECT file_hash, count(*) FILTER ({error_case('error_message', 0)} <> 'SOURCE_FILE') AS retryable,
  count(*) FILTER ({error_case('error_message', 0)} = 'SOURCE_FILE') AS fatal FROM audit WHERE status = 'failed' GROUP BY 1""")
def _(t: Tables):
    again = retryable(F.col("error_message"))
    return t.audit().filter("status = 'failed'").groupBy("file_hash").agg(
        F.count_if(again).alias("retryable"), F.count_if(~again).alias("fatal"))
