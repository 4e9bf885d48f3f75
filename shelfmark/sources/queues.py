"""Streams of jobs: folders as queues, Kafka where its jar is present, sinks by queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..schemas import JOBS


def read_table_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as they appear; ``per_batch`` files at most per micro-batch."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).parquet(folder))


def table_path(folder: str, name: str) -> str:
    """Pattern that only a table's path matches, be it one file or a folder of them: a stream takes no plain path of a file."""
    return f"{folder.rstrip('/')}/{name}.[p]arquet"


def read_job_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Job messages, one JSON text per line (column value)."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(folder)


def read_kafka(spark: SparkSession, servers: str, topics: str, per_batch: int = 100_000) -> DataFrame:
    """Job messages from Kafka topics; the offsets in the checkpoint take the role of a consumer group."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
           .option("maxOffsetsPerTrigger", per_batch).load())
    return raw.select(F.col("value").cast("string").alias("value"), F.col("topic").alias("queue"), "timestamp")


def parse_jobs(messages: DataFrame, schema: T.StructType = JOBS) -> DataFrame:
    """Jobs from JSON texts; empty, broken and pathless messages are dropped."""
    parsed = messages.filter(F.length(F.trim("value")) > 0).select(F.from_json("value", schema).alias("j")).select("j.*")
    return parsed.filter(F.coalesce(F.length("path"), F.lit(0)) > 0)


def write_by_queue(stream: DataFrame, folder: str, checkpoint: str, column: str = "queue", once: bool = True) -> StreamingQuery:
    """Append rows to one sub-folder per queue, exactly once."""
    writer = (stream.writeStream.format("parquet").partitionBy(column).option("path", folder).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append", once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to a function that must be idempotent in the batch number."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()
