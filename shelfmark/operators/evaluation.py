"""Retrieval and clustering quality, latency, comparison of variants."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.naming import paths_match
from ..functions.scoring import any_word
from ..session import cut_lineage
from . import vector_search
from .grouping import exact_quantiles


def neighbour_precision(vectors: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of each vector's ``k`` nearest others that have its label (id, label, embedding)."""
    queries = vectors.select(F.col("id").alias("query_id"), "embedding")
    hits = vector_search.search(queries, vectors, k=k, exclude_self=True)
    own = vectors.select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    other = vectors.select("id", F.col("label").alias("other"))
    return hits.join(own, "query_id").join(other, "id").agg(
        F.countDistinct("query_id").alias("n"), F.avg(F.when(F.col("own") == F.col("other"), 1.0).otherwise(0.0)).alias("precision"))


def silhouette(vectors: DataFrame) -> DataFrame:
    """Cosine silhouette per row (id, label, embedding). The mean distance of a unit vector to a cluster
    is one minus its product with the cluster's summed unit vectors over the cluster size, so no pairs
    are formed; only the cluster sums go to the tasks, in slices of bounded size if they are many."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.select("label", F.transform("embedding", lambda x: x.cast("double") / length).alias("u"))
    sums = (unit.select("label", F.posexplode("u").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("_s"), F.max("n").alias("n")))
    sums = cut_lineage(sums)
    cells = sums.agg(F.sum(F.size("_s"))).first()[0] or 0
    slices = max(1, -(-cells * 8 // vector_search.BROADCAST_BYTES))
    types = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}

    def against(some: DataFrame) -> DataFrame:
        """Per row: own cluster's size and mean distance, where it is among these clusters, and the nearest other one's."""
        local = some.select("label", "n", F.col("_s.s").alias("total")).orderBy("label").toPandas()
        totals = np.vstack(local["total"].to_numpy()) if len(local) else np.zeros((0, 0))
        shared = vectors.sparkSession.sparkContext.broadcast((local["label"].to_numpy(), local["n"].to_numpy().astype(float), totals))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            labels, sizes, totals = shared.value
            for batch in batches:
                if not len(batch) or not len(labels):
                    continue
                products = vector_search.unit_rows(batch["embedding"]) @ totals.T
                own = batch["label"].to_numpy()[:, None] == labels[None, :]
                here = own.any(axis=1)
                n_own = np.where(here, sizes[own.argmax(axis=1)], 0.0)
                a = np.where(here, (n_own - np.where(own, products, 0.0).sum(axis=1)) / np.maximum(n_own - 1, 1), 0.0)
                b = np.where(own, np.inf, 1 - products / sizes[None, :]).min(axis=1)
                yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "n": n_own, "a": a, "b": b})

        return vectors.select("id", "label", "embedding").mapInPandas(
            measure, f"id {types['id']}, label {types['label']}, n double, a double, b double")

    parts = [against(sums if slices == 1 else sums.filter(F.pmod(F.xxhash64("label"), F.lit(slices)) == i)) for i in range(slices)]
    rows = parts[0]
    if slices > 1:
        rows = reduce(DataFrame.unionAll, parts).groupBy("id", "label").agg(F.max("n").alias("n"), F.max("a").alias("a"), F.min("b").alias("b"))
    usable = (F.col("n") > 1) & (F.col("b") < float("inf"))
    value = F.when(usable, (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))).otherwise(0.0)
    return rows.select("id", "label", value.alias("silhouette"))


def keyword_precision(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Share of the first ``k`` hits (query_id, rank, text) holding any expected word (query_id, words)."""
    found = hits.filter(F.col("rank") <= k).join(expected, "query_id")
    per_query = found.groupBy("query_id").agg((F.count_if(any_word(F.col("text"), F.col("words"))) / k).alias("precision"))
    return expected.select("query_id").join(per_query, "query_id", "left").select(
        "query_id", F.coalesce("precision", F.lit(0.0)).alias("precision"))


def precision_summary(precision: DataFrame, least: float = V.PLAUSIBLE_PRECISION) -> DataFrame:
    """Number of queries, their mean precision (null without queries) and whether it is plausible."""
    mean = F.avg("precision")
    return precision.agg(F.count("*").alias("queries"), mean.alias("mean_precision"), (mean >= least).alias("plausible"))


def ranking_quality(hits: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG of each judged query. ``hits`` hold query_id, id and
    rank; ``judgements`` query_id and id."""
    wanted = judgements.select("query_id", "id").distinct()
    expected = wanted.groupBy("query_id").agg(F.count("*").alias("expected"))
    good = (hits.filter(F.col("rank") <= k).join(wanted, ["query_id", "id"]).groupBy("query_id")
            .agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")))
    gains = F.transform(F.sequence(F.lit(1), F.least(F.col("expected"), F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1.0))
    ideal = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    zero = F.lit(0.0)
    return expected.join(good, "query_id", "left").select(
        "query_id", (F.coalesce("found", F.lit(0)) / k).alias("precision"), (F.coalesce("found", F.lit(0)) / F.col("expected")).alias("recall"),
        F.coalesce(1 / F.col("first"), zero).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"))


def entity_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 per label from (doc_id, label, value) rows."""
    keys = ["doc_id", "label", "value"]
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    f = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    counted = e.join(f, keys, "full_outer").groupBy("label").agg(
        F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("tp"),
        F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0))).otherwise(0.0)

    tp = F.col("tp")
    p, r = ratio(tp, tp + F.col("fp")), ratio(tp, tp + F.col("fn"))
    return counted.select("label", "tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"),
                          F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0))), 3).alias("f1"))


def latency(rows: DataFrame, group: str, value: str, ok: Column, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated percentiles and success rate per group."""
    totals = rows.groupBy(group).agg(F.count("*").alias("n"), (F.count_if(ok) / F.count("*")).alias("success_rate"))
    return totals.join(exact_quantiles(rows, group, value, {f"p{int(p * 100)}": p for p in points}), group)


def evidence_level(hits: DataFrame, ledger: DataFrame) -> DataFrame:
    """Best evidence of each searched token. ``hits`` hold query_id, token, rank, path, filename and excerpt;
    ``ledger`` query_id, ledger_path and current_filename."""
    token = F.col("token")
    matched = (F.when(paths_match(F.coalesce("path", F.lit("")), F.coalesce("ledger_path", F.lit(""))), "path")
               .when(F.col("filename") == F.col("current_filename"), "filename")
               .when(F.col("excerpt").contains(token) | F.col("filename").contains(token) | F.col("path").contains(token), "token"))
    judged = ledger.join(hits, "query_id", "left").withColumn("_m", matched)
    first = judged.groupBy("query_id").agg(F.min_by("_m", F.when(F.col("_m").isNotNull(), F.col("rank"))).alias("matched_on"))
    on = F.coalesce("matched_on", F.lit("none"))
    return first.select("query_id", on.alias("matched_on"),
                        F.when(on.isin("path", "filename"), "strong").when(on == "token", "medium").otherwise("fail").alias("level"))


def compare_variants(results: DataFrame, test: str = "test_name", variant: str = "variant") -> DataFrame:
    """Winner and recommendation of variant B against A per test. Rows hold accuracy, speed, memory_mb,
    success_rate and errors."""
    metrics = ["accuracy", "speed", "memory_mb", "success_rate", "errors"]
    wide = results.groupBy(test).pivot(variant, ["A", "B"]).agg(*[F.first(m).alias(m) for m in metrics])

    def a(m: str) -> Column:
        return F.col(f"A_{m}")

    def b(m: str) -> Column:
        return F.col(f"B_{m}")

    accuracy, success = b("accuracy") >= a("accuracy"), b("success_rate") >= a("success_rate")
    every = (accuracy & (b("speed") >= a("speed")) & ((b("memory_mb") <= a("memory_mb")) | (b("memory_mb") < 100)) & success
             & (b("errors") <= a("errors")))
    clear = (b("accuracy") > a("accuracy") + 0.05) | (b("speed") > a("speed") * 1.5)
    winner = F.when(every, "B").when(accuracy & success, "TIE").otherwise("A")
    advice = (F.when(every & clear, "UPGRADE").when(every, "UPGRADE (marginal)").when(accuracy & success, "INCONCLUSIVE").otherwise("KEEP"))
    return wide.select(test, winner.alias("winner"), advice.alias("recommendation"), every.alias("all_aspects_better"))


def compare_points(results: DataFrame, test: str = "test_name", variant: str = "variant") -> DataFrame:
    """Point form: precision counts two, silhouette, speed and memory one each; ties go to A."""
    wide = results.groupBy(test).pivot(variant, ["A", "B"]).agg(*[F.first(m).alias(m) for m in ("precision", "silhouette", "speed", "memory_mb")])
    wins = [(F.col("B_precision") > F.col("A_precision"), 2), (F.col("B_silhouette") > F.col("A_silhouette"), 1),
            (F.col("B_speed") > F.col("A_speed"), 1), (F.col("B_memory_mb") < F.col("A_memory_mb"), 1)]
    points_b = sum((F.when(won, n).otherwise(0) for won, n in wins), F.lit(0))
    points_a = F.lit(5) - points_b
    return wide.select(test, points_a.alias("points_a"), points_b.alias("points_b"),
                       F.when(points_b > points_a, "B").when(points_a > points_b, "A").otherwise("TIE").alias("winner"))

