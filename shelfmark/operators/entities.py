"""Fuzzy matching and merging of entity names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.matching import matching_ratio
from ..session import cut_lineage, drop_round, write_round


def _grams(text: Column) -> Column:
    """Two-character pieces numbered by occurrence, so that they form a set."""
    size = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda o: o == g)).cast("string")))


EPS = 1e-9


def _gram_share(ratio: float) -> float:
    """Shared two-character pieces per character of both names, see ``similar_names``."""
    if not 0.8 <= ratio <= 1:
        raise ValueError("the ratio must lie between 0.8 and 1")
    return ratio / 2 - (1 - ratio)


def _short_bounds(ratio: float) -> tuple[int, int]:
    """Longest name that can match one too short for the piece bound, and their unmatched characters."""
    share = _gram_share(ratio)
    shortest = max(n for n in range(1, 50) if floor(share * (n + ceil(n * ratio / (2 - ratio) - EPS)) - 1 - EPS) < 1)
    longest = floor(shortest * (2 - ratio) / ratio + EPS)
    return longest, floor((1 - ratio) * (shortest + longest) + EPS)


def _with_deletions(word: Column) -> Column:
    """The word and its spellings with one character left out."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.concat(F.array(word), F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))))


#: Spellings a name may have as join keys, and the length up to which they are tried.
SPELLINGS, SPELT_LENGTH = 2000, 40
NAMES_AT_ONCE = 500
#: Matches of one first letter that a task decides in one pass, about 200 bytes each.
EDGES_AT_ONCE = 1 << 20


def _kept_lengths(ratio: float, longest: int) -> dict[int, list[int]]:
    """For each length of a name, lengths of the common subsequences that it must have with similar names of up to ``longest`` characters."""
    kept: dict[int, set[int]] = {}
    for m in range(1, longest + 1):
        for n in range(1, longest + 1):
            if 2 * min(m, n) >= ratio * (m + n) - EPS:
                kept.setdefault(m, set()).add(ceil(ratio * (m + n) / 2 - EPS))
    return {m: sorted(sizes) for m, sizes in kept.items()}


def _spelt_up_to(ratio: float) -> int:
    """Length up to which names meet by spellings: few of them a name, but all names too short for the piece bound."""
    longest = _short_bounds(ratio)[0]
    while longest < SPELT_LENGTH and max(sum(comb(m - 1, c - 1) for c in sizes) for m, sizes in _kept_lengths(ratio, longest + 1).items()) <= SPELLINGS:
        longest += 1
    return longest


def similar_names(names: DataFrame, ratio: float = V.ENTITY_RATIO, column: str = "name") -> DataFrame:
    """Pairs of distinct names with equal first letter and similarity of at least ``ratio`` (a < b).

    Candidates come from two exact filters. Matched characters are a common subsequence, which may begin with the equal first letter, so two names of lengths m and n
    share a spelling of r(m+n)/2 characters, rounded up, that leaves out some of the others. Names of up to 16 letters (at 0.85) meet under these spellings,
    which are nearly as rare as the pairs. Longer names meet each other, and those short ones that can match them, by a prefix filter: a ratio r leaves at most
    (1-r)(m+n) unmatched characters, so at least r(m+n)/2 - (1-r)(m+n) - 1 two-character pieces are shared, and two names must then share one of the
    rarest pieces of each. Keys that are hot nevertheless are split by adaptive execution."""
    share, longest = _gram_share(ratio), _spelt_up_to(ratio)
    kept = _kept_lengths(ratio, longest)
    plain = names.select(F.col(column).alias("name")).filter(F.length("name") > 0).distinct()
    keyed = plain.select("name", F.lower("name").alias("low"))
    keyed = cut_lineage(keyed.withColumn("block", F.substring("low", 1, 1)).withColumn("n", F.length("low")))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), NAMES_AT_ONCE):
                part = batch.iloc[start:start + NAMES_AT_ONCE]
                yield pd.DataFrame([(name, low, low[0] + "".join(rest)) for name, low in zip(part["name"], part["low"])
                                    for c in kept[len(low)] for rest in set(combinations(low[1:], c - 1))], columns=["name", "low", "key"])

    spelt = keyed.filter(F.col("n") <= longest).select("name", "low").mapInPandas(spell, "name string, low string, key string")
    spelt_rows = cut_lineage(spelt.select("name", "low", F.length("low").alias("n"), F.length("key").alias("size"), F.xxhash64("key").alias("key")))

    shortest = ceil((longest + 1) * ratio / (2 - ratio) - EPS)  # of those that can match a longer name
    need = F.floor(F.lit(share) * (F.col("n") + F.ceil(F.col("n") * (ratio / (2 - ratio)) - EPS)) - 1 - EPS)
    gram_rows = keyed.filter(F.col("n") >= shortest).select("name", "low", "block", "n", need.alias("need"), F.explode(_grams(F.col("low"))).alias("key"))
    frequency = gram_rows.groupBy("key").agg(F.count("*").alias("freq"))
    ordered = (gram_rows.join(frequency, "key").groupBy("name", "low", "block", "n", "need")
               .agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("sorted")))
    long_ = ordered.select(
        "name", "low", "block", "n", F.explode(F.slice(F.col("sorted.key"), F.lit(1), (F.size("sorted") - F.col("need") + 1).cast("int"))).alias("key"))
    both = F.col("na") + F.col("nb")

    def side(rows: DataFrame, own: str, keys: list[str]) -> DataFrame:
        return rows.select(F.col("name").alias(own), F.col("low").alias(f"l{own}"), F.col("n").alias(f"n{own}"), *keys)

    def close(met: DataFrame) -> DataFrame:
        # matched characters are a common subsequence, so the edit distance is within the unmatched ones
        edits = F.levenshtein("la", "lb") <= (1 - ratio) * both + EPS
        return met.filter((2 * F.least("na", "nb") >= ratio * both - EPS) & edits).select("a", "b", "la", "lb")

    under = ["size", "key"]
    short_pairs = side(spelt_rows, "a", under).join(side(spelt_rows, "b", under), under).filter(
        (F.col("a") < F.col("b")) & (F.ceil(F.lit(ratio) * both / 2 - EPS) == F.col("size")))
    under = ["block", "key"]
    far = side(long_.filter(F.col("n") > longest), "a", under).join(side(long_, "b", under), under)
    ordered_pair = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "la", "lb")).otherwise(
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lb").alias("la"), F.col("la").alias("lb")))
    long_pairs = close(far.filter(F.col("a") != F.col("b"))).select(ordered_pair.alias("p")).select("p.*")
    candidates = cut_lineage(close(short_pairs).unionByName(long_pairs).distinct())
    return candidates.withColumn("ratio", matching_ratio("la", "lb")).filter(F.col("ratio") >= ratio).select("a", "b", "ratio")


def one_edit_apart(names: DataFrame, column: str = "name") -> DataFrame:
    """Pairs (a < b) of distinct names whose lower-case forms differ by one edit at most. Both or one of such names with one character
    left out are equal, so they meet under that spelling."""
    plain = names.select(F.col(column).alias("name")).filter(F.length("name") > 0).distinct()
    spelt = plain.select("name", F.explode(F.array_distinct(_with_deletions(F.lower("name")))).alias("key"))
    a, b = spelt.select(F.col("name").alias("a"), "key"), spelt.select(F.col("name").alias("b"), "key")
    return a.join(b, "key").filter("a < b").select("a", "b").distinct().filter(F.levenshtein(F.lower("a"), F.lower("b")) <= 1)


def _members(edges: DataFrame) -> DataFrame:
    """Names (name) that join an earlier one, from all matches (a < b)."""
    spark, path, found = edges.sparkSession, None, []
    left = edges.select("a", "b", F.substring(F.lower("a"), 1, 1).alias("block"))
    while (left.groupBy("block").count().agg(F.max("count")).first()[0] or 0) > EDGES_AT_ONCE:  # every round settles the matches of the first name at least
        waiting = left.select(F.col("b").alias("a")).distinct()
        joined = cut_lineage(left.join(waiting, "a", "left_anti").select(F.col("b").alias("name")).distinct())
        found.append(joined)
        rest, written = write_round(left.join(joined.select(F.col("name").alias("b")), "b", "left_anti").join(
            joined.select(F.col("name").alias("a")), "a", "left_anti").select("a", "b", "block"))
        if path:
            drop_round(spark, path)
        left, path = rest, written

    def decide(matches: pd.DataFrame) -> pd.DataFrame:
        joined: set[str] = set()
        for a, b in matches.sort_values("b")[["a", "b"]].itertuples(index=False, name=None):
            if a not in joined:  # all matches that lead to a came before
                joined.add(b)
        return pd.DataFrame({"name": list(joined)}, dtype=object)

    found.append(left.groupBy("block").applyInPandas(decide, "name string"))
    return reduce(DataFrame.unionByName, found)


def merge_entities(names: DataFrame, ratio: float = V.ENTITY_RATIO, column: str = "name") -> DataFrame:
    """Greedy clusters in sorted order (name, leader, winner): a name joins the first earlier leader it
    resembles, else it leads. The winner is the longest name of the cluster.

    A name joins one exactly if some earlier match of it does not itself join one. Matches have equal first letters, so each letter is decided on its own: in one
    pass of a task over the matches in order where they are at most ``EDGES_AT_ONCE``. Before that, rounds thin them out while a letter has more: names that no
    match leads to any more are leaders, their matches join, and all matches of these are dropped."""
    plain = names.select(F.col(column).alias("name")).filter(F.length("name") > 0).distinct()
    edges = cut_lineage(similar_names(names, ratio, column).select("a", "b"))
    members = cut_lineage(_members(edges))
    led = edges.join(members.select(F.col("name").alias("a")), "a", "left_anti").join(members.select(F.col("name").alias("b")), "b", "left_semi")
    first = led.groupBy("b").agg(F.min("a").alias("leader")).withColumnRenamed("b", "name")
    clusters = plain.join(members, "name", "left_anti").select("name", F.col("name").alias("leader")).unionByName(first)
    winners = clusters.groupBy("leader").agg(
        F.min(F.struct(-F.length("name"), "name")).alias("_w"), F.count("*").alias("cluster_size"))
    return clusters.join(winners.select("leader", F.col("_w.name").alias("winner"), "cluster_size"), "leader")


def entity_names(entities: Column) -> Column:
    """First of sender, vendor and organization in a map of entity fields, trimmed."""
    named = [F.when(entities[k] != "", entities[k]) for k in ("sender", "vendor", "organization")]
    return F.trim(F.coalesce(*named))
