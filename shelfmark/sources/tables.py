"""Tables from CSV, JSON and JDBC, summaries, profiles and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import QUERY_SET


def read_inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Inventory index; bad numbers become 0 and blank extensions ``[no_extension]``."""
    raw = spark.read.csv(path, header=True, schema=None)
    ext, depth = F.lower(F.coalesce("Extension", F.lit(""))) if "Extension" in raw.columns else F.lit(""), F.lit(0)
    if "Depth" in raw.columns:
        depth = F.coalesce(F.try_to_number(F.col("Depth"), F.lit("999999999")).cast("int"), F.lit(0))
    size = F.coalesce(F.expr("try_cast(Size_MB AS DOUBLE)"), F.lit(0.0))
    return raw.select(F.col("Path").alias("path"), F.col("Filename").alias("filename"),
                      F.when(ext == "", "[no_extension]").otherwise(ext).alias("extension"), size.alias("size_mb"), depth.alias("depth"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Input of fewer splits than cores is spread by key before heavy work; larger input is left as it
    is, so that no shuffle of texts is planned at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """CSV or TSV with a header; types are inferred only when no schema is given."""
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def table_summary(df: DataFrame, name: str, max_rows: int = 20) -> DataFrame:
    """One row: columns, row and column count, preview of the first rows as JSON, truncated flag."""
    preview = df.limit(max_rows).agg(F.collect_list(F.to_json(F.struct(*df.columns))).alias("preview"))
    counted = df.agg(F.count("*").alias("row_count")).withColumn("preview", preview.scalar())
    return counted.select(
        F.lit(name).alias("name"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "row_count",
        F.lit(len(df.columns)).alias("column_count"), "preview", (F.col("row_count") > max_rows).alias("truncated"))


def read_json_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a JSON file that holds a list, an object with a ``data`` list, or one object."""
    reader = spark.read.option("multiLine", True)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    if "data" in df.columns and isinstance(df.schema["data"].dataType, T.ArrayType):
        rows = df.select(F.explode("data").alias("row"))
        return rows.select("row.*") if isinstance(rows.schema["row"].dataType, T.StructType) else rows
    return df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, QUERY_SET)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None,
              partitions: int = 64, **options: str) -> DataFrame:
    """Database table through a driver jar on the classpath, read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


COLUMN_LIST = "array<struct<name:string,type:string,nullable:boolean>>"


def catalog_profile(tables: dict[str, DataFrame], sample_rows: int = 5, count_rows: bool = True) -> DataFrame:
    """Per table: columns with type and nullability, row count, preview rows as JSON."""
    out = None
    for name, df in tables.items():
        columns = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                                     F.lit(f.nullable).alias("nullable")) for f in df.schema.fields]).cast(COLUMN_LIST)
        preview = df.limit(sample_rows).agg(F.collect_list(F.to_json(F.struct(*df.columns))).alias("p")).scalar()
        rows = F.count("*") if count_rows else F.lit(None).cast("bigint")
        source = df if count_rows else df.limit(1)
        row = source.agg(rows.alias("row_count") if count_rows else F.first(rows).alias("row_count")).select(
            F.lit(name).alias("table_name"), columns.alias("columns"), "row_count", preview.alias("preview"))
        out = row if out is None else out.unionByName(row)
    return out


def export_lines(df: DataFrame, fmt: str, limit: int | None = None) -> DataFrame:
    """Rows as CSV or JSON text lines."""
    rows = df if limit is None else df.limit(limit)
    packed = F.struct(*rows.columns)
    line: Column = F.to_csv(packed) if fmt == "csv" else F.to_json(packed)
    return rows.select(line.alias("line"))


def export_table(df: DataFrame, path: str, fmt: str = "csv", limit: int | None = None) -> None:
    """Write rows as CSV with a header or as JSON lines, one file per partition."""
    rows = df if limit is None else df.limit(limit)
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def export_corrections(corrections: DataFrame, path: str) -> None:
    """Corrections newest first as JSON lines; files are range-sorted by time, so no task holds them all."""
    corrections.orderBy(F.desc("timestamp")).write.mode("overwrite").json(path)
