"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfmark.session import checkpoint_dir


@dataclass(frozen=True)
class Table:
    frame: DataFrame
    path: str


def new_path(spark, name: str = "table") -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, free: bool = False) -> Table:
    """Write and read again: a lost executor costs a read, not the work before. With `free`, Spark deletes the shuffle files of this write at
    its end; without it they stay until the driver collects its garbage."""
    path = new_path(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_FREES, "false")
    if free:
        conf.set(_FREES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            conf.set(_FREES, before)
    return Table(df.sparkSession.read.schema(df.schema).parquet(path), path)


def drop_table(table: Table) -> None:
    """Delete a table that no later step reads."""
    jvm = table.frame.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.path)
    path.getFileSystem(table.frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
