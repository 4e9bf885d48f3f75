"""Checked streaming queries: each runs over all available input and must equal its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..functions.binary import HEAD_BYTES
from ..schemas import JOBS
from ..sources import queues
from ..streaming import jobs
from .queries_files import KINDS, signature
from .queries_ledger import TS, error_case, sql_list, texts
from .queries_text import EXT, ROUTER_SQL, sql_map
from .registry import query
from .tables import AUDIT, CORRECTIONS, FILES, SPARK, Tables, audit_sql, files_sql, ts_text


def stream(t: Tables, name: str) -> DataFrame:
    """A driver table as a stream of its files."""
    schema = getattr(t, name).schema
    rows = queues.read_table_stream(t.spark, queues.table_path(t.dir, name), schema)
    plain = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else rows  # event time needs a zone


def audit_stream(t: Tables) -> DataFrame:
    return t.sql(audit_sql(SPARK), events=stream(t, "events"))


DETECTED = f"CASE n_chars % 6 {' '.join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(KINDS[:5]))} ELSE {EXT} END"


@query("st1_route_jobs", f"""WITH {FILES}, typed AS (SELECT id, file_size_bytes, original_filename, {DETECTED} AS extension,
    CASE WHEN n_chars % 6 < 3 THEN 'magic' WHEN n_chars % 6 < 5 THEN 'container' ELSE 'extension' END AS detection_method FROM files)
  SELECT id, extension, detection_method, {ROUTER_SQL} AS queue,
  CASE WHEN file_size_bytes > 52428800 THEN 'deep' WHEN {EXT} IN ({sql_list(V.ROUTER_DEEP_TYPES)}) AND NOT
    (50 + 30 + {sql_map(V.ROUTER_WEIGHTS, EXT, '0')} + CASE WHEN {' OR '.join(f"contains(lower(original_filename), '{k}')" for k in V.ROUTER_KEYWORDS)} THEN 15 ELSE 0 END >= 70
     AND file_size_bytes < 10485760) THEN 'deep' ELSE 'fast' END AS processing_path FROM typed""")
def _(t: Tables):
    files = t.sql(files_sql(SPARK), documents=stream(t, "documents"))
    head = F.substring(F.concat(signature(F.col("n_chars")), F.col("extracted_text").cast("binary")), 1, HEAD_BYTES)
    incoming = files.select(F.col("id").cast("string").alias("id"), F.col("original_path").alias("path"), F.col("original_filename").alias("filename"),
                            "extension", F.col("file_size_bytes").alias("size"), F.col("ingested_at").alias("modified"), F.base64(head).alias("head"))
    parsed = queues.parse_jobs(incoming.select(F.to_json(F.struct("*")).alias("value")), T.StructType([*JOBS, T.StructField("head", T.StringType())]))
    routed = jobs.route_jobs(parsed, F.col("modified"), F.unbase64("head"))
    folder = jobs.run_folder(t.spark)
    wanted = routed.select("id", "extension", "detection_method", "queue", "processing_path")
    queues.write_by_queue(wanted, f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select(F.col("id").cast("bigint").alias("id"), "extension", "detection_method", "queue", "processing_path")


@query("st2_extract_handoff", "SELECT doc_id AS job_id, length(text) AS chars, 'enrich:ner' AS queue FROM documents")
def _(t: Tables):
    folder = jobs.run_folder(t.spark)
    source = stream(t, "documents").select(F.col("doc_id").alias("id"), "text")
    jobs.drain_to_index(source, t.spark, f"{folder}/index", f"{folder}/state", jobs.extract_batch)
    return t.spark.read.parquet(f"{folder}/index").select("job_id", "chars", "queue")


@query("st3_once_per_job", "SELECT event_id AS id, event_type FROM events")
def _(t: Tables):
    twice = stream(t, "events").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"), F.col("event_id").alias("id"), "event_type", "ts")
    return jobs.collect_stream(jobs.once_per_job(twice).select("id", "event_type"), t.spark)


@query("st4_throughput", f"""WITH {AUDIT} SELECT {TS.format("date_trunc('minute', ts)")} AS minute, queue_name, count(*) AS jobs, sum(processing_time_ms)::BIGINT AS total_ms
  FROM audit GROUP BY date_trunc('minute', ts), queue_name""")
def _(t: Tables):
    return texts(jobs.collect_updates(jobs.throughput(audit_stream(t)), t.spark, ["minute", "queue_name"]), "minute")


@query("st5_retry_or_dead", f"""WITH {AUDIT} SELECT id, row_number() OVER (PARTITION BY file_hash, stage ORDER BY ts, id) AS attempt, {error_case('error_message', 1)} AS error_type,
  CASE WHEN {error_case('error_message', 0)} <> 'SOURCE_FILE' AND row_number() OVER (PARTITION BY file_hash, stage ORDER BY ts, id) <= 3 THEN 'retry' ELSE 'dead_letter' END AS decision
  FROM audit WHERE status = 'failed'""")
def _(t: Tables):
    done = jobs.with_rocks(t.spark, lambda: jobs.collect_updates(jobs.retry_or_dead(audit_stream(t)), t.spark, ["id"]))
    return done.select("id", F.col("attempt").cast("bigint").alias("attempt"), "error_type", "decision")


@query("st6_quarantine_on_error", f"""WITH {AUDIT}, l AS (SELECT *, lag(status) OVER (PARTITION BY file_hash ORDER BY ts, id) AS before FROM audit)
  SELECT id, file_hash, filename, error_message FROM l WHERE status = 'failed' AND coalesce(before, '') <> 'failed'""")
def _(t: Tables):
    told = jobs.with_rocks(t.spark, lambda: jobs.collect_updates(jobs.quarantine_on_error(audit_stream(t)), t.spark, ["id"]))
    return told.filter("turned").select("id", "file_hash", "filename", "error_message")


@query("st7_stuck_stages", f"""WITH {AUDIT}, l AS (SELECT *, lead(ts) OVER (PARTITION BY file_hash, stage ORDER BY ts, id) AS until, max(ts) OVER () AS now FROM audit)
  SELECT id, file_hash, stage, {TS.format('ts')} AS since FROM l WHERE status = 'started' AND least(coalesce(until, now), now) >= ts + INTERVAL 10 MINUTE""")
def _(t: Tables):
    alerts = jobs.with_rocks(t.spark, lambda: jobs.collect_stream(jobs.stuck_stages(audit_stream(t), delay="0 seconds"), t.spark))
    return texts(alerts, "since")


@query("st8_pattern_counts", f"WITH {CORRECTIONS} SELECT predicted_category, actual_category, count(*) AS occurrence_count, {TS.format('max(ts)')} AS last_seen FROM corrections GROUP BY 1, 2")
def _(t: Tables):
    files = t.files()
    labelled = stream(t, "labels").join(files, F.col("doc_id") == F.col("id"))
    actual = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Dokumente").when(F.col("quality") == 1, "Privat")
              .when(F.col("toxic") == 0, "Arbeit").otherwise("Sonstiges"))
    corrections = labelled.select(F.col("category").alias("predicted_category"), actual.alias("actual_category"), F.col("ingested_at").alias("ts"))
    return texts(jobs.collect_updates(jobs.pattern_counts(corrections), t.spark, ["predicted_category", "actual_category"]), "last_seen")


@query("st9_drain_to_index", "SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1")
def _(t: Tables):
    folder = jobs.run_folder(t.spark)
    source = stream(t, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))

    def prepare(batch: DataFrame) -> DataFrame:
        return batch.groupBy("sha256").agg(F.count("*").alias("copies"))

    jobs.drain_to_index(source, t.spark, f"{folder}/index", f"{folder}/state", prepare)
    return jobs.read_sums(t.spark, f"{folder}/index", ["sha256"], ["copies"])


@query("st11_worker_activity", f"""WITH {AUDIT} SELECT {TS.format("date_trunc('hour', ts)")} AS hour, worker_type, worker_id, count(*) AS jobs_processed, count(*) FILTER (status = 'completed') AS successful,
  count(*) FILTER (status = 'failed') AS failed, {TS.format('max(ts)')} AS last_active FROM audit GROUP BY date_trunc('hour', ts), worker_type, worker_id""")
def _(t: Tables):
    return texts(jobs.collect_updates(jobs.worker_activity(audit_stream(t)), t.spark, ["hour", "worker_type", "worker_id"]), "hour", "last_active")


@query("st11_worker_sessions", f"""WITH {AUDIT}, g AS (SELECT worker_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM audit),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT worker_id, {TS.format('min(ts)')} AS session_start, count(*) AS jobs FROM s GROUP BY worker_id, n""")
def _(t: Tables):
    sessions = jobs.collect_complete(jobs.worker_sessions(audit_stream(t)), t.spark)
    return texts(sessions, "session_start").select("worker_id", "session_start", "jobs")


DELIVERIES = 7
DELIVERY = "CAST(least(5, floor((day(ts) - 1) / 5)) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS INT)"


@query("st11_late_rows", f"""WITH d AS (SELECT event_id, ts, {DELIVERY} AS delivery FROM events),
  n AS (SELECT delivery, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 10 MINUTE AS behind FROM d GROUP BY delivery)
  SELECT delivery, count(*) AS rows, count(*) FILTER (ts <= behind) AS late_rows FROM d JOIN n USING (delivery) GROUP BY delivery""")
def _(t: Tables):
    """Events come in deliveries of five days, every fiftieth one delivery too late; one run of the stream takes each."""
    folder = jobs.run_folder(t.spark)
    sent = t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(DELIVERY).alias("delivery"))
    counts = []
    for n in range(DELIVERIES):
        sent.filter(F.col("delivery") == n).drop("delivery").write.mode("append").parquet(f"{folder}/in")
        rows = queues.read_table_stream(t.spark, f"{folder}/in", sent.drop("delivery").schema, per_batch=1_000_000)
        counts.append((n, *jobs.run_counting_late(jobs.once_per_job(rows), t.spark, f"{folder}/out", f"{folder}/state")))
    return t.spark.createDataFrame(counts, "delivery int, rows long, late_rows long").filter("rows > 0")


@query("s18_sink_by_queue", f"WITH {AUDIT} SELECT queue_name, count(*) AS rows FROM audit GROUP BY 1")
def _(t: Tables):
    folder = jobs.run_folder(t.spark)
    queues.write_by_queue(audit_stream(t).select("id", "queue_name"), f"{folder}/out", f"{folder}/state", "queue_name").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").groupBy("queue_name").agg(F.count("*").alias("rows"))


@query("s17_queue_batches", "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1")
def _(t: Tables):
    counted = stream(t, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"))
    return jobs.collect_updates(counted, t.spark, ["conv_id"])
