"""Streams over files that arrive one after the other."""

import datetime
import json
import random

from pyspark.sql import functions as F

from shelfmark.sources import queues
from shelfmark.streaming import jobs


def test_parse_jobs_drops_bad_messages(spark, tmp_path):
    lines = ["", "not json", json.dumps({"id": "1", "path": ""}), json.dumps({"id": "2", "path": "/a.pdf", "filename": "a.pdf", "extension": ".pdf", "size": 10})]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    parsed = queues.parse_jobs(queues.read_job_stream(spark, str(tmp_path)))
    out = jobs.collect_stream(jobs.route_jobs(parsed.withColumn("modified", F.to_timestamp(F.lit("2020-01-01")))).select("id", "queue", "processing_path"), spark)
    assert [tuple(r) for r in out.collect()] == [("2", "extract:documents", "deep")]


def test_route_by_content(spark):
    """Bytes decide before the name; a name decides where the bytes say nothing."""
    rows = [("1", "a.txt", ".txt", b"%PDF-1.7"), ("2", "b.pdf", ".pdf", b"\x89PNG\r\n\x1a\n..."), ("3", "c.eml", ".eml", b"From: x"), ("4", "d", None, b""), ("5", "e.doc", ".doc", None)]
    files = spark.createDataFrame([(i, n, e, 10, datetime.datetime(2020, 1, 1), bytearray(b) if b is not None else None) for i, n, e, b in rows],
                                  "id string, filename string, extension string, size long, modified timestamp, head binary")
    routed = {r.id: (r.extension, r.detection_method, r.queue) for r in jobs.route_jobs(files, F.col("modified"), F.col("head")).collect()}
    assert routed == {"1": ("pdf", "magic", "extract:documents"), "2": ("png", "magic", "extract:images"), "3": ("eml", "extension", "extract:email"),
                      "4": ("unknown", "unknown", "extract:unknown"), "5": ("doc", "extension", "extract:documents")}


def test_updates_over_several_batches_equal_batch(spark, tmp_path):
    schema = "ts timestamp, queue_name string, processing_time_ms int"
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=20 * i), f"q{i % 2}", i) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20:(n + 1) * 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    source = queues.read_table_stream(spark, str(tmp_path / "in"), table.schema, per_batch=1)
    got = jobs.collect_updates(jobs.throughput(source), spark, ["minute", "queue_name"])
    want = table.groupBy(F.date_trunc("minute", "ts").alias("minute"), "queue_name").agg(
        F.count("*").alias("jobs"), F.sum("processing_time_ms").alias("total_ms"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_inbox_and_repeated_drain(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    index, state = str(tmp_path / "index"), str(tmp_path / "state")

    def prepare(batch):
        return batch.select(F.col("path").alias("id"), F.col("content").cast("string").alias("text"))

    for n in range(2):
        (inbox / f"{n}.txt").write_text(f"file {n}")
        jobs.drain_to_index(jobs.watch_inbox(spark, str(inbox)), spark, index, state, prepare)
    assert sorted(r.text for r in jobs.read_index(spark, index, "id").collect()) == ["file 0", "file 1"]


def shuffled_audit(spark, folder, files=6):
    """Audit rows in several files in random order, some delivered twice."""
    rng = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, f"f{rng.randrange(4)}", rng.choice("ab"), rng.choice(["started", "failed", "failed", "completed"]), start + datetime.timedelta(minutes=rng.randrange(600)),
             f"n{i}", rng.choice(["timeout", "corrupt"])) for i in range(400)]
    sent = rows + rng.sample(rows, 30)
    rng.shuffle(sent)
    schema = "id long, file_hash string, stage string, status string, ts timestamp, filename string, error_message string"
    for n in range(files):
        spark.createDataFrame(sent[n::files], schema).coalesce(1).write.mode("append").parquet(folder)
    return rows, spark.read.parquet(folder).schema


def latest(spark, folder, schema, follow):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        source = queues.read_table_stream(spark, folder, schema, per_batch=1)
        return jobs.with_rocks(spark, lambda: jobs.collect_updates(follow(source), spark, ["id"])).cache()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def by_key(rows, *at):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        groups.setdefault(tuple(r[i] for i in at), []).append(r)
    return groups


def test_histories_do_not_depend_on_slicing(spark, tmp_path):
    folder = str(tmp_path / "audit")
    rows, schema = shuffled_audit(spark, folder)
    want = {}
    for group in by_key([r for r in rows if r[3] == "failed"], 1, 2).values():
        for n, r in enumerate(group, 1):
            want[r[0]] = (n, "retry" if r[6] == "timeout" and n <= 3 else "dead_letter")
    assert {r.id: (r.attempt, r.decision) for r in latest(spark, folder, schema, jobs.retry_or_dead).collect()} == want

    turned = {r[0] for group in by_key(rows, 1).values() for before, r in zip([None, *group], group) if r[3] == "failed" and (before is None or before[3] != "failed")}
    assert {r.id for r in latest(spark, folder, schema, jobs.quarantine_on_error).filter("turned").collect()} == turned


def test_stuck_stages_alert_by_timer(spark, tmp_path):
    """Rows come shuffled over six files. The delay covers all of them, so alerts are those known at the newest row less the delay: planted
    last rows carry the clock beyond everything else."""
    folder = str(tmp_path / "audit")
    rows, schema = shuffled_audit(spark, folder)
    wait, clock = datetime.timedelta(minutes=10), max(r[4] for r in rows) + datetime.timedelta(minutes=700)
    spark.createDataFrame([(1000, "clock", "a", "started", clock, "n", None)], schema).coalesce(1).write.mode("append").parquet(folder)
    stuck = {(r[0], r[4]) for group in by_key(rows, 1, 2).values() for r, after in zip(group, [*group[1:], None])
             if r[3] == "started" and (after is None or after[4] >= r[4] + wait)}
    source = queues.read_table_stream(spark, folder, schema, per_batch=1)
    got = jobs.with_rocks(spark, lambda: jobs.collect_stream(jobs.stuck_stages(source, delay="600 minutes"), spark)).collect()
    assert len(got) == len(stuck) and {(r.id, r.since) for r in got} == stuck


def kept_rows(query):
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])


def test_state_is_bounded_and_expires(spark, tmp_path):
    """One row an hour for 40 days: what stays is the lateness's share of a key, and nothing of a key that has been silent for the
    retention. Outcomes go on counting over settled rows."""
    folder, start = str(tmp_path / "audit"), datetime.datetime(2024, 1, 1)
    schema = "id long, file_hash string, stage string, status string, ts timestamp, filename string, error_message string"
    rows = [(h, "f0" if h < 24 else "f1", "a", "failed" if h % 3 else "completed", start + datetime.timedelta(hours=h), "n", "timeout") for h in range(960)]
    for n in range(8):
        spark.createDataFrame(rows[n * 120:(n + 1) * 120], schema).coalesce(1).write.mode("append").parquet(folder)
    source = queues.read_table_stream(spark, folder, spark.read.parquet(folder).schema, per_batch=1)

    def run(stream, name, mode):
        query = (stream.writeStream.format("parquet") if mode == "append" else stream.writeStream.foreachBatch(
            lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / name / f"version={n}"))))
        query = query.outputMode(mode).option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True)
        query = query.start()
        query.awaitTermination()
        return query

    retries = jobs.with_rocks(spark, lambda: run(jobs.retry_or_dead(source, retention="10 days"), "retry", "update"))
    assert 0 < kept_rows(retries) < 40  # 16 rows of the last day, what is settled, and the timer
    attempts = [r.attempt for r in spark.read.parquet(str(tmp_path / "retry")).orderBy("id").collect()]
    assert attempts == [*range(1, 17), *range(1, 625)]
    stuck = jobs.with_rocks(spark, lambda: run(jobs.stuck_stages(source), "stuck", "append"))
    assert 0 < kept_rows(stuck) < 10


def test_drained_counts_and_late_rows(spark, tmp_path):
    folder, index = str(tmp_path / "audit"), str(tmp_path / "index")
    rows, schema = shuffled_audit(spark, folder)
    stream = queues.read_table_stream(spark, folder, schema, per_batch=1)
    jobs.drain_to_index(stream, spark, index, str(tmp_path / "state"), lambda b: b.groupBy("status").agg(F.count("*").alias("n")))
    assert sum(r.n for r in jobs.read_sums(spark, index, ["status"], ["n"]).collect()) == len(rows) + 30
    batches = spark.createDataFrame([(0, 100), (1, 50), (1, 2000), (2, 1300), (2, 1500)], "batch int, s long").select("batch", F.timestamp_seconds("s").alias("ts"))
    assert tuple(jobs.late_rows(batches).first()) == (1, 5)
