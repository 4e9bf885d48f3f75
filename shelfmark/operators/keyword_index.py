"""Stored inverted index for BM25 search.

An index is a folder of batches. A batch holds the postings of its documents as blocks: one row for a term and a window of WINDOW consecutive ids, with the ids
as distances from the window's start, the counts and the documents' lengths, and the block's highest count and least length. Blocks lie in folders by
the term's hash; the files of a folder hold some windows each, sorted by term and window. The batch's entry in ``batches`` is written last, so readers see a batch whole or not at all.

A search reads the folders of its terms. The scores of each query's rarest terms give a score that its k best reach at least. Terms
whose best blocks together stay below it cannot bring in a document, so their blocks are read only in windows that hold candidates, and a candidate
goes before that if the best of its window cannot lift it over the threshold. Results are those of a full evaluation.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import fixed_values as V
from ..session import drop_round, write_round
from .grouping import top_k_per
from .retrieval import query_terms, term_counts, tokens

#: Ids of one block's window, and so the most postings of a block.
WINDOW = 1024
#: Postings of one folder, about. Each task that writes puts a file into every folder, so folders are large.
POSTINGS_A_PART = 32_000_000
#: Windows of one task that writes, about, and the most of these tasks.
TASK_WINDOWS = 4
MAX_TASKS = 240
#: Postings per wanted hit from which the threshold is taken.
SEED = 8
ROUNDING = 1e-9


@dataclass(frozen=True)
class Batch:
    name: str
    documents: int
    tokens: int
    parts: int


def _batches(spark: SparkSession, path: str) -> list[Batch]:
    """The finished batches: a row each."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batches")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return [Batch(r["name"], r["documents"], r["tokens"], r["parts"]) for r in spark.read.parquet(f"{path}/batches").orderBy("name").collect()]


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")


def add_batch(documents: DataFrame, path: str) -> None:
    """Add ``documents`` (id, a whole number, and text) to the index at ``path``, which need not exist. Ids must be new and differ; null ids are
    refused like known ones. Null and blank texts count as documents without words."""
    spark = documents.sparkSession
    name = uuid.uuid4().hex
    keyed = documents.select(F.col("id").cast("bigint").alias("id"), "text").withColumn("window", F.floor(F.col("id") / WINDOW))
    cut = keyed.select("id", "window", F.coalesce(tokens(F.col("text")), F.array()).alias("_t")).withColumn("len", F.size("_t"))
    lengths = f"{path}/documents/{name}"
    cut.select("id", "len").write.parquet(lengths)
    new = spark.read.parquet(lengths)
    sums = new.agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.count_distinct("id").alias("distinct"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"),
                   F.count_distinct(F.floor(F.col("id") / WINDOW)).alias("windows")).first()
    known = [spark.read.parquet(f"{path}/documents/{b.name}").select("id") for b in _batches(spark, path)]
    if sums["distinct"] < sums["n"] or (known and not new.join(reduce(DataFrame.unionAll, known), "id", "left_semi").isEmpty()):
        drop_round(spark, lengths)
        raise ValueError("ids must be new, distinct and not null")
    # the texts are dealt out by window, so that a window's blocks are made and written by one task and postings are never shuffled
    whole = keyed.repartition(max(1, min(MAX_TASKS, ceil(sums["windows"] / TASK_WINDOWS))), "window")
    counted = whole.select("window", "id", F.coalesce(tokens(F.col("text")), F.array()).alias("_t")).select(
        "window", "id", F.size("_t").alias("len"), F.explode(term_counts(F.col("_t"))).alias("c")).select("window", "id", "len", "c.term", "c.tf")
    place = F.struct(F.pmod(F.col("id"), F.lit(WINDOW)).cast("int").alias("offset"), "tf", "len")
    blocks = counted.groupBy("window", "term").agg(F.sort_array(F.collect_list(place)).alias("p"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
    parts = max(1, sums["tokens"] // POSTINGS_A_PART)
    stored = blocks.select(_part(parts).alias("part"), "term", "window", F.size("p").alias("n"), "max_tf", "min_len",
                           F.col("p.offset").alias("offsets"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"))
    stored.sortWithinPartitions("part", "term", "window").write.partitionBy("part").parquet(f"{path}/postings/{name}")
    row = spark.createDataFrame([(name, sums["n"], sums["tokens"], parts)], "name string, documents bigint, tokens bigint, parts int")
    row.coalesce(1).write.mode("append").parquet(f"{path}/batches")


_BLOCK = "term string, window bigint, n int, max_tf int, min_len int, offsets array<int>, tfs array<int>, lens array<int>, part int"


def _blocks(spark: SparkSession, path: str, batches: list[Batch], vocabulary: DataFrame) -> DataFrame:
    """The blocks of the wanted terms; only folders that can hold one are listed and read."""
    out = []
    for batch in batches:
        wanted = [r[0] for r in vocabulary.select(_part(batch.parts)).distinct().collect()]  # no more than the batch has folders
        if wanted and batch.tokens:
            out.append(spark.read.schema(_BLOCK).parquet(f"{path}/postings/{batch.name}").where(F.col("part").isin(wanted)).drop("part"))
    return reduce(DataFrame.unionAll, out).join(vocabulary, "term", "left_semi") if out else spark.createDataFrame([], _BLOCK).drop("part")


def _weight(tf: Column, length: Column, mean: float) -> Column:
    """The part of a term's score that its count and the document's length decide; it grows with the count and falls with the length."""
    return tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (F.lit(1 - V.BM25_B) + F.lit(V.BM25_B) * length / F.lit(mean)))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` documents of each query (query_id, query) by BM25 over all batches."""
    batches = _batches(spark, path)
    n = sum(b.documents for b in batches)
    mean = sum(b.tokens for b in batches) / n if n else 1.0
    mean = mean or 1.0
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        frame, where = write_round(df)
        made.append(where)
        return frame

    terms = keep(query_terms(queries))
    blocks = _blocks(spark, path, batches, terms.select("term").distinct())
    known = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(_weight(F.col("max_tf"), F.col("min_len"), mean)).alias("best"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = keep(terms.join(known.withColumn("idf", idf), "term").select("query_id", "term", "df", "idf", (F.col("idf") * F.col("best")).alias("most")))

    def postings(of: DataFrame) -> DataFrame:
        """(…, id, part): scores of the postings of blocks joined with their term's idf"""
        each = of.withColumn("p", F.explode(F.arrays_zip("offsets", "tfs", "lens"))).drop("offsets", "tfs", "lens")
        part = F.col("idf") * _weight(F.col("p.tfs"), F.col("p.lens"), mean)
        return each.withColumns({"id": F.col("window") * WINDOW + F.col("p.offsets"), "part": part})

    def summed(of: DataFrame) -> DataFrame:
        found = postings(blocks.join(of.select("query_id", "term", "idf"), "term"))
        return found.groupBy("query_id", "id").agg(F.sum("part").alias("sum"))

    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seed = asked.withColumn("before", before).where(F.col("before") < SEED * k)
    kth = top_k_per(summed(seed), ["query_id"], [F.desc("sum"), F.col("id")], k).groupBy("query_id").agg(F.min("sum").alias("kth"), F.count("*").alias("n"))
    least = kth.where(F.col("n") == k).select("query_id", (F.col("kth") * (1 - ROUNDING)).alias("least"))
    weakest = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    planned = keep(asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("upto", F.sum("most").over(weakest)))
    leading, rest = planned.where("upto >= least"), planned.where("upto < least")
    limits = planned.groupBy("query_id").agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(F.col("upto") < F.col("least"), F.col("upto"))), F.lit(0.0)).alias("more"))
    hopeful = summed(leading).join(limits, "query_id").where("sum + more >= least")
    candidates = keep(hopeful.select("query_id", "id", "sum", "least", F.floor(F.col("id") / WINDOW).alias("window")))
    # what the leading terms alone give is a better threshold; then the best that the other terms' blocks hold for a window
    reached = top_k_per(candidates, ["query_id"], [F.desc("sum"), F.col("id")], k).groupBy("query_id").agg(F.min("sum").alias("kth"), F.count("*").alias("n"))
    better = limits.join(reached.where(F.col("n") == k), "query_id", "left").select(
        "query_id", "more", F.greatest("least", F.coalesce(F.col("kth") * (1 - ROUNDING), F.lit(0.0))).alias("least"))
    candidates = keep(candidates.drop("least").join(better, "query_id").where("sum + more >= least").drop("more"))
    wanted = candidates.select("query_id", "window").distinct().join(rest.select("query_id", "term", "idf"), "query_id")
    ahead = blocks.select("term", "window", "max_tf", "min_len").join(wanted, ["term", "window"]).groupBy("query_id", "window").agg(
        F.sum(F.col("idf") * _weight(F.col("max_tf"), F.col("min_len"), mean)).alias("ahead"))
    left = keep(candidates.join(ahead, ["query_id", "window"], "left").where("sum + coalesce(ahead, 0) >= least").select("query_id", "id", "sum", "window"))
    open_terms = left.join(rest.select("query_id", "term", "idf"), "query_id").select("query_id", "id", "window", "term", "idf")
    needed = open_terms.select("term", "window", "idf").distinct()
    parts = postings(blocks.join(needed, ["term", "window"])).select("term", "id", "part")
    more = open_terms.select("query_id", "id", "term").join(parts, ["term", "id"]).groupBy("query_id", "id").agg(F.sum("part").alias("more"))
    total = left.join(more, ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("sum") + F.coalesce("more", F.lit(0.0)), 9).alias("score"))
    best, _ = write_round(top_k_per(total, ["query_id"], [F.desc("score"), F.col("id")], k))
    for where in made:
        drop_round(spark, where)
    return best
