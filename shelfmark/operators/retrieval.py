"""Keyword, hybrid and reranked retrieval, rank fusion, embedding cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .. import fixed_values as V
from ..session import cut_lineage
from .grouping import top_k_per

TOKEN = V.WORD + "{2,}"
SMALL_VOCABULARY = 1_000_000
#: Postings that one task sums up, about.
POSTINGS_A_TASK = 200_000


def tokens(text: Column) -> Column:
    """Lower-case words of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each query without stopwords."""
    exploded = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).distinct()
    return exploded.filter(~F.col("term").isin(V.ENGLISH_STOPWORDS))


def term_counts(words: Column) -> Column:
    """Array of (term, tf) of an array of words, without a shuffle: equal words stand together once sorted, and a count is the way to the next run."""
    def bound(value: Column, use) -> Column:  # a lambda holds the value, so it is computed once
        return F.get(F.transform(F.array(value), use), 0)

    def counts(ordered: Column) -> Column:
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return bound(starts, lambda b: F.transform(b, lambda i, k: F.struct(
            F.get(ordered, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(ordered)) - i).alias("tf"))))

    return bound(F.array_sort(words), counts)


def bm25(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Best documents of each query by BM25. ``documents`` hold id and text, ``queries`` query_id and query.

    Words are counted inside tasks, and those that no query asks for are dropped, before anything is shuffled."""
    terms = cut_lineage(query_terms(queries))
    vocabulary = terms.select("term").distinct()
    small = terms.count() <= SMALL_VOCABULARY
    if small:
        vocabulary, terms = F.broadcast(vocabulary), F.broadcast(terms)
    # one scan of the texts: the corpus' numbers are observed while the postings, each with its document's length, are written
    seen = Observation()
    cut = (documents.select("id", tokens(F.col("text")).alias("_t")).select("id", "_t", F.coalesce(F.size("_t"), F.lit(0)).alias("_len"))
           .observe(seen, F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean")))
    counted = cut.select("id", "_len", F.explode(term_counts(F.col("_t"))).alias("c")).select("id", "_len", "c.term", "c.tf")
    asked = counted.join(vocabulary, "term", "left_semi")
    postings = cut_lineage(asked)
    if small:  # a document's postings go to one task, which sums them up; tasks grow in number, not in size
        postings = postings.repartition(max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), postings.count() // POSTINGS_A_TASK), "id")
    corpus = seen.get
    n, mean = corpus["n"], corpus["mean"] or 1.0
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.select("term", idf.alias("idf"))  # no larger than the vocabulary
    if small:
        weighted = F.broadcast(weighted)
    length = F.lit(1 - V.BM25_B) + F.lit(V.BM25_B) * F.col("_len") / F.lit(mean)
    part = F.col("idf") * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + V.BM25_K1 * length)
    scored = postings.join(weighted, "term").select("id", "term", part.alias("part")).join(terms, "term")
    total = scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k_per(total, ["query_id"], [F.desc("score"), F.col("id")], k)


def reciprocal_rank_fusion(ranked: DataFrame, group: str, item: str, k: int, by_score: bool = False,
                           fusion_k: int = V.FUSION_K) -> DataFrame:
    """Fuse ranked lists: sum of weight / (rank + 60) per item, best ``k`` of each group."""
    weight = F.col("score") if by_score else F.lit(1.0)
    fused = ranked.groupBy(group, item).agg(F.round(F.sum(weight / (F.col("rank") + fusion_k)), 12).alias("fused"))
    return top_k_per(fused, [group], [F.desc("fused"), F.col(item)], k)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = V.DENSE_WEIGHT, sparse_weight: float = V.SPARSE_WEIGHT) -> DataFrame:
    """Weighted sum of dense scores and sparse scores scaled by each query's best, best ``k``."""
    top = sparse.groupBy("query_id").agg(F.max("score").alias("_top"))
    scaled = sparse.join(top, "query_id").select("query_id", "id", (F.col("score") / F.col("_top")).alias("_sparse"))
    both = dense.select("query_id", "id", F.col("score").alias("_dense")).join(scaled, ["query_id", "id"], "full_outer")
    score = dense_weight * F.coalesce("_dense", F.lit(0.0)) + sparse_weight * F.coalesce("_sparse", F.lit(0.0))
    origin = F.when(F.col("_dense").isNull(), "sparse").when(F.col("_sparse").isNull(), "dense").otherwise("dense+sparse")
    total = both.select("query_id", "id", F.round(score, 9).alias("score"), origin.alias("source"))
    return top_k_per(total, ["query_id"], [F.desc("score"), F.col("id")], k)


def routing(query: Column) -> Column:
    """Keyword search for short queries and those with numbers, semantic search for the rest."""
    return F.when(query.rlike("[0-9]") | (F.size(tokens(query)) <= 2), "keyword").otherwise("semantic")


def zero_result_rate(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of queries without any hit."""
    found = hits.select("query_id").distinct().withColumn("_found", F.lit(1))
    return queries.select("query_id").join(found, "query_id", "left").agg(
        F.count("*").alias("queries"), F.count_if(F.col("_found").isNull()).alias("without_result"),
        (F.count_if(F.col("_found").isNull()) / F.count("*")).alias("zero_result_rate"))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's words found in the text."""
    wanted = F.array_distinct(tokens(query))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, tokens(text))) / F.size(wanted))


def rerank(candidates: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = lexical_overlap) -> DataFrame:
    """Candidates (query_id, query, id, text, rank) reordered by a scorer, or the first ``k`` without one."""
    if scorer is None:
        kept = candidates.filter(F.col("rank") <= k)
        return kept.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("reranked", F.lit(False))
    scored = candidates.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 9)).withColumn("_before", F.col("rank")).drop("rank")
    best = top_k_per(scored, ["query_id"], [F.desc("rerank_score"), F.col("_before")], k)
    return best.withColumn("reranked", F.lit(True)).withColumnRenamed("_before", "first_rank")


def cache_key(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model + ":"), text), 256)


def not_cached(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts without a vector of this model; ``cache`` holds key."""
    return texts.withColumn("key", cache_key(F.col("text"), model)).join(cache.select("key"), "key", "left_anti")


def hashing_encoder(texts: DataFrame, dim: int = 256) -> DataFrame:
    """Default encoder: normalised term counts hashed to ``dim`` places (id, text to id, embedding)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    counted = HashingTF(inputCol="_t", outputCol="_f", numFeatures=dim).transform(texts.withColumn("_t", tokens(F.col("text"))))
    unit = Normalizer(inputCol="_f", outputCol="_u", p=2.0).transform(counted)
    return unit.select("id", vector_to_array("_u", dtype="float32").alias("embedding"))


def embed(texts: DataFrame, cache: DataFrame, model: str, encoder: Callable[[DataFrame], DataFrame] = hashing_encoder) -> DataFrame:
    """Vectors of all texts: from the cache (key, embedding) where present, else encoded once per content."""
    keyed = texts.select("id", "text", cache_key(F.col("text"), model).alias("key"))
    missing = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    fresh = encoder(missing.withColumnRenamed("key", "id")).withColumnRenamed("id", "key")
    vectors = cache.select("key", "embedding").unionByName(fresh.select("key", "embedding"))
    return keyed.select("id", "key").join(vectors, "key")
