"""Grouping helpers that stay bounded when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Last row of each key by ``order``. An aggregate, so rows are reduced before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def concat_ordered(df: DataFrame, keys: list[str], order: list[str], joined: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per group with the values of its rows joined in order. ``joined`` maps an output name to (column, separator);
    ``group_rows`` counts. A group's result is one text, so it must fit a row; what is joined is all that is shuffled."""
    entries = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_{n}") for n, (c, _) in joined.items()])))
    grouped = df.groupBy(*keys).agg(F.count("*").alias("group_rows"), entries.alias("_rows"))
    return grouped.select(*keys, "group_rows", *[F.array_join(F.col("_rows")[f"_{n}"], sep).alias(n) for n, (_, sep) in joined.items()])


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key. Spark keeps only ``k`` rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "number") -> DataFrame:
    """Running number of each row of a key. ``bucket`` must not decrease along ``order``: rows are numbered
    inside (key, bucket) and shifted by the count of the key's earlier buckets, so a hot key is spread
    over its buckets."""
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = counts.withColumn("_before", F.sum("_n").over(earlier) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_rank", F.row_number().over(inside)).join(offsets, [*keys, "_bucket"])
    return numbered.withColumn(name, (F.col("_rank") + F.col("_before")).cast("bigint")).drop("_rank", "_before", "_bucket")


def number_in_time(df: DataFrame, keys: list[str], ts: str, *ties: str, unit: str = "hour", name: str = "number") -> DataFrame:
    """``number_rows`` in time order, with hours (or another unit) as buckets."""
    return number_rows(df, keys, F.date_trunc(unit, ts), [ts, *ties], name)


def previous_in_time(df: DataFrame, keys: list[str], value: str, ts: str, *ties: str, unit: str = "hour", name: str = "previous") -> DataFrame:
    """Value of the row before, per key in time order, with the same two levels."""
    bucketed = df.withColumn("_bucket", F.date_trunc(unit, ts))
    last = bucketed.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(ts, *ties)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.withColumn("_carried", F.lag("_last").over(across)).drop("_last")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, *ties)
    joined = bucketed.withColumn("_lag", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    return (joined.join(carried, [*keys, "_bucket"])
            .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
            .drop("_bucket", "_lag", "_first", "_carried"))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in an order fixed by key and seed, so a rerun after a lost executor draws the same."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def exact_quantiles(rows: DataFrame, group: str, value: str, points: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Interpolated quantiles per group, one column per point; exact.

    A sketch that tasks merge gives two values around each point, by rank, so outliers do not matter: its ranks are off by one in
    ``accuracy`` at most, and the bracket is four times as wide. Rows below a bracket are only counted, rows inside are counted by
    value and numbered: some ten-thousandths of the group. Groups of up to ``accuracy`` rows are a bracket of their own. Null
    values and null groups do not count; a wanted rank outside its bracket would end the query."""
    slack, infinity = 4 / accuracy, F.lit(float("inf"))
    v = rows.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    ends = [end for p in points.values() for end in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = v.groupBy(group).agg(F.percentile_approx("_v", ends, accuracy).alias("_q"), F.count("*").alias("_n"))

    def bracket(n: int, name: str, p: float) -> Column:
        small = F.col("_n") <= accuracy
        low = F.when(small | F.lit(p <= slack), -infinity).otherwise(F.get("_q", 2 * n))
        high = F.when(small | F.lit(p >= 1 - slack), F.lit(float("nan"))).otherwise(F.get("_q", 2 * n + 1))  # not a number orders last
        return F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_n") - 1)).alias("at"), low.alias("low"), high.alias("high"))

    brackets = sketch.select(group, F.array(*(bracket(n, *point) for n, point in enumerate(points.items()))).alias("_b"))
    met = v.join(brackets, group).select(group, "_v", F.explode("_b").alias("_b")).filter(F.col("_v") <= F.col("_b.high"))
    counted = (met.select(group, "_b.name", "_b.at", F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_v"))
               .groupBy(group, "name", "at", "_v").agg(F.count("*").alias("_k")))  # null: all rows below
    upto = F.sum("_k").over(Window.partitionBy(group, "name", "at").orderBy(F.col("_v").asc_nulls_first()))
    placed = counted.withColumn("_to", upto)

    def ranked(rank: Column) -> Column:
        found = F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_k")), F.col("_v")))
        return F.when(found.isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(found)

    ends_ = placed.groupBy(group, "name", "at").agg(ranked(F.floor("at")).alias("_low"), ranked(F.ceil("at")).alias("_high"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("at") - F.floor("at"))
    exact = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between)
    return ends_.groupBy(group).agg(*(F.max(F.when(F.col("name") == name, exact)).alias(name) for name in points))
