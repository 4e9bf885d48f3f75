"""Run reports, table profiles and small analytic queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..functions.lookup import lookup
from ..functions.scoring import format_spec, registered_formats
from .grouping import exact_quantiles, top_k_per


def component_summary(runs: DataFrame) -> DataFrame:
    """Per component and overall: tests, passes, failures, times, accuracy of passes, error rate."""
    ok = F.col("success")
    return runs.rollup("component").agg(
        F.count("*").alias("total_tests"), F.count_if(ok).alias("passed_tests"), F.count_if(~ok).alias("failed_tests"),
        F.avg("seconds").alias("avg_time"), F.min("seconds").alias("min_time"), F.max("seconds").alias("max_time"),
        F.coalesce(F.avg(F.when(ok, F.col("accuracy"))), F.lit(0.0)).alias("avg_accuracy"),
        (F.count_if(~ok) / F.greatest(F.lit(1), F.count("*"))).alias("error_rate")).withColumn(
            "component", F.coalesce("component", F.lit("OVERALL")))


def format_coverage(runs: DataFrame) -> DataFrame:
    """Per format: files, passes, rate and verdict (at least half passed)."""
    rate = F.count_if("success") / F.count("*")
    return runs.groupBy("extension").agg(
        F.count("*").alias("files_tested"), F.count_if("success").alias("files_passed"), rate.alias("success_rate"),
        F.when(rate >= 0.5, "passed").otherwise("failed").alias("status"))


def coverage_verdict(coverage: DataFrame) -> DataFrame:
    """Rates over all formats and files against the criteria."""
    c = V.COVERAGE_CRITERIA
    rates = coverage.agg(
        (F.count_if(F.col("status") == "passed") / F.greatest(F.lit(1), F.count("*"))).alias("format_success_rate"),
        (F.sum("files_passed") / F.greatest(F.lit(1), F.sum("files_tested"))).alias("file_success_rate"))
    formats, files = F.col("format_success_rate") >= c["format_success_rate"], F.col("file_success_rate") >= c["file_success_rate"]
    errors = (1 - F.col("file_success_rate")) <= c["error_rate_max"]
    return rates.select("format_success_rate", "file_success_rate", formats.alias("formats_ok"), files.alias("files_ok"),
                        errors.alias("errors_ok"), (formats & files & errors).alias("meets_criteria"))


def value_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, exact median, least, greatest and sample deviation (0 for one value) per group."""
    plain = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
                                    F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)).alias("stdev"))
    return plain.join(exact_quantiles(rows, group, value, {"median": 0.5}), group)


def plausibility(files: DataFrame) -> DataFrame:
    """Matches, mismatches and unknowns of MIME type and category against the extension."""
    ext = F.lower("extension")
    mime, category = lookup(ext, V.EXPECTED_MIME), lookup(ext, V.EXPECTED_CATEGORY)
    return files.agg(
        F.count_if(F.col("content_type").contains(mime)).alias("mime_match"), F.count_if(~F.col("content_type").contains(mime)).alias("mime_mismatch"),
        F.count_if(mime.isNull()).alias("mime_unknown"), F.count_if(F.col("category") == category).alias("category_match"),
        F.count_if(F.col("category") != category).alias("category_mismatch"), F.count_if(category.isNull()).alias("category_unknown"))


def run_report(results: DataFrame) -> DataFrame:
    """Per extension and in total: tested, ok, parser ok, model ok, mean seconds."""
    return results.rollup("extension").agg(
        F.count("*").alias("tested"), F.count_if("ok").alias("ok"), F.count_if("parser_ok").alias("parser_ok"),
        F.count_if("model_ok").alias("model_ok"), F.avg("seconds").alias("avg_seconds")).withColumn(
            "extension", F.coalesce("extension", F.lit("TOTAL")))


def failures(results: DataFrame, top: int = 30) -> DataFrame:
    return results.filter(~F.col("ok")).orderBy("id").limit(top)


def mean_of_nonzero(results: DataFrame, *metrics: str) -> DataFrame:
    """Totals and the mean of each metric over its values above zero."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
                       *[F.coalesce(F.avg(F.when(F.col(m) > 0, F.col(m))), F.lit(0.0)).alias(m) for m in metrics])


def latency_report(rows: DataFrame) -> DataFrame:
    """Mean latency to one decimal per category and extension, per category, and overall."""
    return rows.rollup("category", "extension").agg(F.count("*").alias("submitted"), F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms")).withColumn(
        "category", F.coalesce("category", F.lit("ALL"))).withColumn("extension", F.coalesce("extension", F.lit("ALL")))


def load_summary(rounds: DataFrame) -> DataFrame:
    """Latency weighted by successes, throughput per second, greatest queue depth."""
    good = F.sum("successful")
    return rounds.agg(
        F.when(good > 0, F.round(F.sum(F.col("avg_latency_ms") * F.col("successful")) / F.nullif(good, F.lit(0)), 1)).otherwise(0.0).alias("avg_latency_ms"),
        F.round(good / (F.sum("total_ms") / 1000), 1).alias("throughput"), F.max("queue_depth").alias("peak_depth"))


def olap_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes"), F.avg("confidence").alias("avg_confidence"))


def confident_count(files: DataFrame, above: float = 0.8) -> DataFrame:
    return files.filter(F.col("confidence") > above).agg(F.count("*").alias("files"))


def revenue_per_customer(customers: DataFrame, orders: DataFrame, above: float) -> DataFrame:
    """Orders and revenue of each customer, those above an amount. ``customers`` hold id and name,
    ``orders`` customer_id, order_id and total; orders are reduced before the join."""
    spent = orders.groupBy(F.col("customer_id").alias("id")).agg(F.count("order_id").alias("orders"), F.sum("total").alias("revenue"))
    joined = customers.join(spent, "id", "left").select("id", "name", F.coalesce("orders", F.lit(0)).alias("orders"), "revenue")
    return joined.filter(F.col("revenue") > above).orderBy(F.desc("revenue"), "id")


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def profile(df: DataFrame, top: int = 5, approximate: bool = False) -> DataFrame:
    """Long-form profile (column, metric, value): row count, ranges, means and sums of numbers, ranges of
    dates, distinct counts and most frequent values of texts. One pass for the aggregates, one for texts."""
    simple = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    entries: list[Column] = [F.struct(F.lit("*").alias("column"), F.lit("rows").alias("metric"), F.count("*").cast("string").alias("value"))]

    def entry(name: str, metric: str, value: Column) -> None:
        entries.append(F.struct(F.lit(name).alias("column"), F.lit(metric).alias("metric"), value.cast("string").alias("value")))

    texts = []
    for f in simple:
        c, kind = F.col(f.name), _kind(f.dataType)
        if kind == "numeric":
            for metric, value in (("min", F.min(c)), ("max", F.max(c)), ("mean", F.avg(c)), ("sum", F.sum(c))):
                entry(f.name, metric, F.format_string("%.2f", F.round(value.cast("double"), 2)))
        elif kind == "date":
            entry(f.name, "min", F.date_format(F.min(c), "yyyy-MM-dd HH:mm:ss"))
            entry(f.name, "max", F.date_format(F.max(c), "yyyy-MM-dd HH:mm:ss"))
        else:
            texts.append(f.name)
            if approximate:
                entry(f.name, "unique", F.approx_count_distinct(c))
    result = df.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("e")).select("e.*")
    if not texts:
        return result
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("item")) for n in texts])).alias("e")).select("e.*")
    counts = long.filter("item IS NOT NULL").groupBy("column", "item").agg(F.count("*").alias("n"))
    best = top_k_per(counts, ["column"], [F.desc("n"), F.col("item")], top).select(
        "column", F.concat(F.lit("top"), F.col("rank").cast("string")).alias("metric"), F.concat("item", F.lit(": "), F.col("n").cast("string")).alias("value"))
    if not approximate:
        unique = counts.groupBy("column").agg(F.count("*").cast("string").alias("value")).select("column", F.lit("unique").alias("metric"), "value")
        best = best.unionByName(unique)
    return result.unionByName(best)


def category_formats(files: DataFrame, extension: str = "extension") -> DataFrame:
    """Per registry category: formats registered, files present and formats among them. Categories without files stay, files of
    unknown formats make up one of their own."""
    known = files.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, registered_formats()))).alias("ext"))
    registered = known.groupBy(format_spec(F.col("ext"))["category"].alias("category")).agg(F.count("*").alias("formats"))
    present = files.groupBy(extension).agg(F.count("*").alias("n")).groupBy(format_spec(F.col(extension))["category"].alias("category")).agg(
        F.sum("n").alias("files"), F.count("*").alias("formats_seen"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("formats", "files", "formats_seen")}
    return registered.join(present, "category", "full").withColumns(zero)


def rows_of_maximum(df: DataFrame, columns: list[str], show: list[str]) -> DataFrame:
    """For each numeric column the row that holds its greatest value, in one pass."""
    picks = [F.struct(F.lit(c).alias("column"), F.max_by(F.struct(*show), F.struct(F.col(c), *[-F.col(s) for s in show])).alias("row")) for c in columns]
    return df.agg(F.array(*picks).alias("_p")).select(F.explode("_p").alias("p")).select("p.column", "p.row.*")
