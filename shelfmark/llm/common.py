"""Small helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than the six ASCII blanks (Java, Python and RE2 syntax agree).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: bytes.split() cuts at exactly the blanks that WORD leaves out."""
    return text.split() if text else []


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_column(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text alone, the text as UTF-8 bytes, so that extra columns can clash with nothing."""
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))


def map_rows(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict[str, Iterable]], fields: list[T.StructField],
             keep: tuple[str, ...] = ("key",), rows: int = 512) -> DataFrame:
    """One output row per input row: the columns `keep` pass, `per_batch` gives the others. Batches are cut to
    `rows` rows so that memory does not depend on the session's Arrow settings."""
    schema = T.StructType([df.schema[k] for k in keep] + fields)
    names = [f.name for f in fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = per_batch(part)
                arrays = [part.column(k) for k in keep] + [pa.array(made[n], ARROW[f.dataType.simpleString()]) for n, f in zip(names, fields)]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return df.mapInArrow(apply, schema)


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
         "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


LAST_KEY = (1 << 63) - 1


def document(key: str = "key", text: str = "text") -> list[Column]:
    """Columns (d, copy) that stand for a document where a join has to find it again: its integer key, null as the largest
    number, and a hash of its text. Rows that repeat with key and text are one document."""
    return [F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_KEY)).alias("d"), F.xxhash64(text).alias("copy")]
