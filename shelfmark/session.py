"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; cluster settings given by spark-submit win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def write_round(df: DataFrame) -> tuple[DataFrame, str]:
    """One round of a loop as a table in the shared checkpoint folder, and its path for ``drop_round``."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_round(spark: SparkSession, path: str) -> None:
    """Delete a round's table that no later round reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result as a table into the shared checkpoint folder and continue from it.
    A lost executor costs a read, not the work; unlike a checkpoint the plan runs only once."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """A table in the shared checkpoint folder, dealt out by a key once, so that joins and groups on it shuffle it no more, and its name for ``drop_buckets``."""
    spark, name = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name), name


def drop_buckets(spark: SparkSession, name: str) -> None:
    """Forget a table of ``write_buckets`` that nothing reads later, and delete its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    drop_round(spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}")
