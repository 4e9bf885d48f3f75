"""Topics: clusters of vectors with an outlier topic, sizes and describing words."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..session import cut_lineage
from .grouping import top_k_per
from .retrieval import tokens

OUTLIER = -1


def assign_topics(vectors: DataFrame, k: int = 15, min_size: int = 10, seed: int = 42) -> DataFrame:
    """Topic of each row (id, embedding): clusters numbered by size, small ones are outliers (-1)."""
    features = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(features)
    assigned = model.transform(features).select("id", F.col("prediction").alias("_c"))
    sizes = assigned.groupBy("_c").agg(F.count("*").alias("_n"))
    numbered = sizes.filter(F.col("_n") >= min_size).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("_n"), "_c"))).alias("_o"))  # at most k rows
    topics = numbered.select(F.posexplode("_o").alias("topic", "_s")).select("topic", F.col("_s._c").alias("_c"))
    return assigned.join(F.broadcast(topics), "_c", "left").select("id", F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))


def topic_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count("*").alias("count"))


def fold_outliers(groups: DataFrame, min_size: int = 10) -> DataFrame:
    """Rows (id, topic) whose topic is smaller than ``min_size`` moved to the outlier topic."""
    small = groups.groupBy("topic").agg(F.count("*").alias("_n")).filter(F.col("_n") < min_size).select("topic", F.lit(True).alias("_small"))
    return groups.join(small, "topic", "left").select("id", F.when(F.col("_small"), OUTLIER).otherwise(F.col("topic")).alias("topic"))


def topic_terms(texts: DataFrame, k: int = 10) -> DataFrame:
    """Best words of each topic (topic, text) by class-based TF-IDF: tf in the topic times
    ln(1 + mean words per topic / frequency of the word)."""
    words = texts.select("topic", F.explode(tokens(F.col("text"))).alias("term")).filter(~F.col("term").isin(V.ENGLISH_STOPWORDS))
    tf = cut_lineage(words.groupBy("topic", "term").agg(F.count("*").alias("tf")))  # used four times
    frequency = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    per_topic = tf.groupBy("topic").agg(F.sum("tf").alias("words"))
    mean = per_topic.agg(F.avg("words").alias("a")).scalar()
    weighted = (tf.join(frequency, "term").join(per_topic, "topic")
                .select("topic", "term", F.round(F.col("tf") / F.col("words") * F.log(1 + mean / F.col("f")), 9).alias("weight")))
    return top_k_per(weighted, ["topic"], [F.desc("weight"), F.col("term")], k)


def topic_names(terms: DataFrame, words: int = 4) -> DataFrame:
    """``topic_word_word_word_word`` of each topic."""
    head = terms.filter(F.col("rank") <= words).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    return head.select("topic", F.concat_ws("_", F.col("topic").cast("string"), F.array_join(F.col("_t.term"), "_")).alias("name"))
