"""Streaming operators over jobs and audit events.

Every stream is a DataFrame to DataFrame function, so the batch form of the same rows can be compared
with it. Results of updating streams are kept as versions per batch; the latest version per key is
the table.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from .. import fixed_values as V
from ..functions.binary import file_type
from ..functions.pii import mask_pii
from ..functions.scoring import classify_error, router_path, router_priority, router_queue
from ..operators.grouping import latest_per_key
from ..session import checkpoint_dir
from ..sources import queues

WATERMARK = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_folder(spark: SparkSession) -> str:
    """A fresh folder for one run below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def detect_types(jobs: DataFrame, content: Column, members: Column | None = None) -> DataFrame:
    """Jobs whose extension and mime come from the file's first bytes (and archive member names, when given) before its name, with the
    way they were found in detection_method."""
    found = jobs.withColumn("_type", file_type(content, F.coalesce("extension", F.lit("")), members))
    return found.withColumns({"extension": F.col("_type.extension"), "mime": F.col("_type.mime"), "detection_method": F.col("_type.method")}).drop("_type")


def route_jobs(jobs: DataFrame, as_of: Column | None = None, content: Column | None = None) -> DataFrame:
    """Jobs with priority, path and queue (one-to-one, no state). With ``content``, the first bytes of the file, the type is detected
    first and decides all three."""
    if content is not None:
        jobs = detect_types(jobs, content)
    now = F.current_timestamp() if as_of is None else as_of
    priority = router_priority(F.col("filename"), F.col("extension"), F.col("size"), F.col("modified"), now)
    routed = jobs.withColumn("priority", priority).withColumn(
        "processing_path", router_path(F.col("extension"), F.col("size"), F.col("priority")))
    return routed.withColumn("queue", router_queue(F.col("extension")))


def once_per_job(jobs: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    """Re-deliveries of a job within the watermark are dropped."""
    return jobs.withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark([key])


def throughput(audit: DataFrame, width: str = "1 minute") -> DataFrame:
    """Jobs and milliseconds per queue in tumbling windows; means follow from sum and count."""
    w = F.window("ts", width)
    return (audit.withWatermark("ts", WATERMARK).groupBy(w, "queue_name")
            .agg(F.count("*").alias("jobs"), F.sum("processing_time_ms").alias("total_ms"))
            .select(F.col("window.start").alias("minute"), "queue_name", "jobs", "total_ms"))


def worker_activity(audit: DataFrame, width: str = "1 hour") -> DataFrame:
    """Jobs, successes, failures and last activity per worker and window."""
    return (audit.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "worker_type", "worker_id")
            .agg(F.count("*").alias("jobs_processed"), F.count_if(F.col("status") == "completed").alias("successful"),
                 F.count_if(F.col("status") == "failed").alias("failed"), F.max("ts").alias("last_active"))
            .select(F.col("window.start").alias("hour"), "worker_type", "worker_id", "jobs_processed", "successful", "failed", "last_active"))


def worker_sessions(audit: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Spells of activity per worker, ended by a gap."""
    return (audit.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap), "worker_id").agg(F.count("*").alias("jobs"))
            .select("worker_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "jobs"))


def pattern_counts(corrections: DataFrame) -> DataFrame:
    """Running counts of corrected category pairs."""
    return corrections.groupBy("predicted_category", "actual_category").agg(
        F.count("*").alias("occurrence_count"), F.max("ts").alias("last_seen"))


#: How far a status row may lag behind the newest one and still change outcomes.
LATENESS = "1 day"
#: Event time after which a key without rows is forgotten; a row that comes later starts anew.
RETENTION = "90 days"


def _reset_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer per key, so that timers do not grow with the rows."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at_ms)


class KeyHistory(StatefulProcessor):
    """Keeps the rows of a key that may still get rows before them, in the order of (ts, id), whatever batches they come in, and reports
    every row whose outcome is new or has changed. The latest report of each id is the result, so it depends neither on the
    slicing of the input nor on the order of arrival; a row delivered twice counts once.

    Rows behind the watermark are settled: only what later outcomes need of them stays, one small row per key, and that goes
    when the watermark has passed the key's last row by the retention. So the state of a key holds the rows of the lateness, not its
    history, and a batch costs as much."""

    CARRIED: str
    OUTCOME: str
    SETTLED: str

    def __init__(self, retention_ms: int) -> None:
        self._retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", f"at long, id long, {self.CARRIED}, {self.OUTCOME}")
        self._settled = handle.getValueState("settled", f"last long, {self.SETTLED}")

    def outcomes(self, rows: pd.DataFrame, settled: tuple | None) -> pd.DataFrame:
        """Outcome of every row, given what is left of the rows before."""
        raise NotImplementedError

    def settle(self, rows: pd.DataFrame, settled: tuple | None) -> tuple:
        """What outcomes of later rows need of these (at least one) and those before."""
        raise NotImplementedError

    def _before(self) -> tuple | None:
        return tuple(self._settled.get())[1:] if self._settled.exists() else None

    def _keep(self, rows: pd.DataFrame, watermark_ms: int) -> None:
        """Settle the rows behind the watermark, keep the others, and wake when those are behind it, too."""
        done = rows["at"] < watermark_ms * 1000
        if done.any():
            past = rows[done]
            self._settled.update((int(past["at"].iloc[-1]), *self.settle(past, self._before())))
        rest = rows[~done]
        if len(rest):
            self._rows.put(list(rest.astype(object).where(rest.notna(), None).itertuples(index=False, name=None)))
            _reset_timer(self._handle, int(rest["at"].iloc[-1]) // 1000 + 1)
        else:
            self._rows.clear()
            _reset_timer(self._handle, max(int(self._settled.get()[0]) // 1000, watermark_ms) + self._retention_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, told = ["at", "id", *_names(self.CARRIED)], _names(self.OUTCOME)
        new = pd.concat(list(rows))[names]
        old = self._stored()
        merged = (pd.concat([old[names], new]) if len(old) else new).drop_duplicates("id").sort_values(["at", "id"], ignore_index=True)
        found = self.outcomes(merged, self._before())
        before = {r[0]: r[1:] for r in old[["id", *told]].itertuples(index=False, name=None)}
        changed = [before.get(i) != t for i, t in zip(merged["id"], found.itertuples(index=False, name=None))]
        whole = pd.concat([merged, found], axis=1)
        self._keep(whole, timerValues.getCurrentWatermarkInMs())
        yield whole.assign(**dict(zip(self.KEYS, key)))[changed][_names(self.output())]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._rows.exists():
            self._keep(self._stored(), timerValues.getCurrentWatermarkInMs())
        else:
            self._settled.clear()
        return iter(())

    def _stored(self) -> pd.DataFrame:
        columns = ["at", "id", *_names(self.CARRIED), *_names(self.OUTCOME)]
        return pd.DataFrame([tuple(r) for r in self._rows.get()] if self._rows.exists() else [], columns=columns)

    @classmethod
    def output(cls) -> str:
        return ", ".join(["id long", *(f"{k} string" for k in cls.KEYS), cls.CARRIED, cls.OUTCOME])

    def close(self) -> None:
        pass


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _millis(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).first()[0]


def _follow(rows: DataFrame, history: type[KeyHistory], lateness: str, retention: str) -> DataFrame:
    kept = rows.withWatermark("ts", lateness).select("id", "ts", F.unix_micros("ts").alias("at"), *history.KEYS, *_names(history.CARRIED))
    processor = history(_millis(rows.sparkSession, retention))
    return kept.groupBy(*history.KEYS).transformWithStateInPandas(processor, history.output(), outputMode="update", timeMode="EventTime")


class RetryCounter(KeyHistory):
    """Counts the failures of a stage; retryable ones go back while fewer than three attempts were made."""

    KEYS = ("file_hash", "stage")
    CARRIED = "error_type string, retry boolean"
    OUTCOME = "attempt int, decision string"
    SETTLED = "attempts int"

    def outcomes(self, rows: pd.DataFrame, settled: tuple | None) -> pd.DataFrame:
        attempt = pd.Series(range(1, len(rows) + 1), dtype="int32") + (settled[0] if settled else 0)
        again = rows["retry"].astype(bool) & (attempt <= V.MAX_RETRIES)
        return pd.DataFrame({"attempt": attempt, "decision": again.map({True: "retry", False: "dead_letter"})})

    def settle(self, rows: pd.DataFrame, settled: tuple | None) -> tuple:
        return (int(rows["attempt"].iloc[-1]),)


def retry_or_dead(audit: DataFrame, lateness: str = LATENESS, retention: str = RETENTION) -> DataFrame:
    """Decision for each failed attempt of a file's stage: retry, or dead letter with its error class. An updating stream of
    reports; the latest per id counts. Rows later than ``lateness`` are dropped."""
    failed = audit.filter(F.col("status") == "failed").withColumn("_c", classify_error(F.col("error_message"))).select(
        "id", "file_hash", "stage", "ts", F.col("_c.error_type").alias("error_type"), F.col("_c.retry").alias("retry"))
    return _follow(failed, RetryCounter, lateness, retention)


class ErrorTransition(KeyHistory):
    """Tells for each status of a file whether the file turned into ``failed`` with it."""

    KEYS = ("file_hash",)
    CARRIED = "filename string, status string, error_message string"
    OUTCOME = "turned boolean"
    SETTLED = "failed boolean"

    def outcomes(self, rows: pd.DataFrame, settled: tuple | None) -> pd.DataFrame:
        failed = rows["status"] == "failed"
        return pd.DataFrame({"turned": failed & ~failed.shift(fill_value=bool(settled and settled[0]))})

    def settle(self, rows: pd.DataFrame, settled: tuple | None) -> tuple:
        return (rows["status"].iloc[-1] == "failed",)


def quarantine_on_error(audit: DataFrame, lateness: str = LATENESS, retention: str = RETENTION) -> DataFrame:
    """Reports of status rows; those whose latest report has ``turned`` are the files to quarantine. Rows later than ``lateness``
    are dropped."""
    return _follow(audit, ErrorTransition, lateness, retention)


class StuckStage(StatefulProcessor):
    """Raises an alert for a start once the watermark has passed it by the wait and nothing came in between. Until then the state holds
    the start and the rows after it; decided starts and rows that no undecided one needs go."""

    ROWS = ["at", "id", "started"]

    def __init__(self, wait_ms: int) -> None:
        self._wait = wait_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", "at long, id long, started boolean")

    def _stored(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self._rows.get()] if self._rows.exists() else [], columns=self.ROWS)

    def _keep(self, rows: pd.DataFrame, watermark: int) -> None:
        """Rows from the watermark or the first undecided start on stay; wake when that start is due."""
        starts = rows.loc[rows["started"].astype(bool), "at"]
        waiting = starts[starts + self._wait > watermark]
        rest = rows[rows["at"] >= min([watermark, *waiting.head(1)])]
        if not len(rest):
            self._rows.clear()
            return
        self._rows.put([(int(a), int(i), bool(s)) for a, i, s in rest.itertuples(index=False, name=None)])
        # without a start the rows go once the watermark is past the last of them
        due = int(waiting.iloc[0]) + self._wait if len(waiting) else int(rest["at"].iloc[-1])
        _reset_timer(self._handle, due // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        merged = pd.concat([self._stored(), *(part[self.ROWS] for part in rows)]).drop_duplicates("id").sort_values(["at", "id"])
        # nothing is decided here: a start that was due before this batch has had its timer
        self._rows.put([(int(a), int(i), bool(s)) for a, i, s in merged.itertuples(index=False, name=None)])
        starts = merged.loc[merged["started"].astype(bool), "at"]
        due = int(starts.iloc[0]) + self._wait if len(starts) else int(merged["at"].iloc[-1])
        _reset_timer(self._handle, max(due // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self._stored()
        due = rows["at"] + self._wait
        after = rows["at"].shift(-1)
        stuck = rows["started"].astype(bool) & (due <= watermark) & (after.isna() | (after >= due))
        self._keep(rows, watermark)
        yield pd.DataFrame({"id": rows["id"], **dict(zip(("file_hash", "stage"), key)), "since": rows["at"]})[stuck]

    def close(self) -> None:
        pass


def stuck_stages(audit: DataFrame, wait: str = "10 minutes", delay: str = WATERMARK) -> DataFrame:
    """Starts of a file's stage after which nothing came for the wait, as an appending stream: the alert comes by a timer of
    event time, without a later row of the key. Rows later than ``delay`` are dropped; each start is reported once at most."""
    rows = audit.withWatermark("ts", delay).select(
        "id", "ts", F.unix_micros("ts").alias("at"), "file_hash", "stage", (F.col("status") == "started").alias("started"))
    alerts = rows.groupBy("file_hash", "stage").transformWithStateInPandas(
        StuckStage(_millis(audit.sparkSession, wait)), "id long, file_hash string, stage string, since long", outputMode="append", timeMode="EventTime")
    return alerts.withColumn("since", F.timestamp_micros("since"))


def extract_batch(batch: DataFrame) -> DataFrame:
    """Text jobs turned into extractions: masked text, method and length."""
    return batch.select(F.col("id").alias("job_id"), mask_pii(F.col("text")).alias("text"), F.lit("text").alias("method"),
                        F.length("text").alias("chars"), F.lit("enrich:ner").alias("queue"))


def collect_stream(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run an appending stream over all available input into a folder and read it back."""
    folder = run_folder(spark)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def collect_updates(stream: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Run an updating stream over all available input; the latest version of each key is the result."""
    folder = run_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/version={number}")

    queues.write_batches(stream, f"{folder}/state", keep, mode="update").awaitTermination()
    versions = spark.read.schema(stream.schema.add("version", "long")).parquet(f"{folder}/out")
    return latest_per_key(versions, keys, F.col("version")).drop("version")


def collect_complete(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run an aggregating stream over all available input; the whole result after the last batch."""
    folder = run_folder(spark)
    batches = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/version={number}")
        batches.append(number)

    queues.write_batches(stream, f"{folder}/state", keep, mode="complete").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/version={max(batches)}")


def late_rows(rows: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Number of rows that came later than the delay behind the newest row of the batches before theirs. Rows carry the number
    of their batch in column batch; batches are few."""
    newest = rows.groupBy("batch").agg(F.max(ts).alias("newest"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    limits = newest.select("batch", (F.max("newest").over(before) - F.expr(f"INTERVAL {delay}")).alias("limit"))
    return rows.join(F.broadcast(limits), "batch").agg(F.count_if(F.col(ts) < F.col("limit")).alias("late_rows"), F.count("*").alias("rows"))


class _Progress(StreamingQueryListener):
    """Rows read and rows dropped behind the watermark, per run of a query."""

    def __init__(self) -> None:
        self.counts: dict[str, list[int]] = {}
        self.ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        count = self.counts.setdefault(str(event.progress.runId), [0, 0])
        count[0] += event.progress.numInputRows
        count[1] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.end_of(str(event.runId)).set()


def run_counting_late(stream: DataFrame, spark: SparkSession, out: str, checkpoint: str, patience: float = 120) -> tuple[int, int]:
    """Run an appending stream over the input that has come since the last run; rows it read and rows its stateful steps dropped as late,
    taken from the progress of every batch. Exact where rows reach the stateful step one by one (de-duplication, key state);
    windowed sums drop whole partial sums."""
    progress = _Progress()
    spark.streams.addListener(progress)
    try:
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        run = str(query.runId)
        if not progress.end_of(run).wait(patience):  # events come in order, so all progress has come before the end
            raise TimeoutError("the stream's progress was not reported")
    finally:
        spark.streams.removeListener(progress)
    rows, late = progress.counts.get(run, (0, 0))
    return rows, late


def drain_to_index(stream: DataFrame, spark: SparkSession, index: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame]) -> None:
    """Write each micro-batch to its own folder of the index, after preparing it. A repeated batch
    overwrites itself, and offsets move on only after success."""
    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{index}/batch={number}")

    queues.write_batches(stream, checkpoint, write).awaitTermination()


def read_index(spark: SparkSession, index: str, key: str) -> DataFrame:
    """Latest row per key of a drained index: for rows that are whole in themselves (snapshots). What a batch has only
    counted or summed needs ``read_sums``."""
    return latest_per_key(spark.read.parquet(index), [key], F.col("batch")).drop("batch")


def read_sums(spark: SparkSession, index: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Additive values of a drained index, summed over its batches."""
    return spark.read.parquet(index).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def watch_inbox(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Files of a folder as they appear, with their bytes."""
    return (spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True)
            .schema("path string, modificationTime timestamp, length long, content binary").load(folder))


def with_rocks(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run with the state store that stateful Python processors need, then restore the setting."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
