"""Near-equal texts by their word shingles: an exact set-similarity join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

SHINGLE = 5
ABOVE = 0.8
BLANKS = r"[\x20\x09-\x0D]+"
#: Of the shingles two similar texts must share, the part looked for before whole sets are read.
EARLY = 0.25
#: Ids sent to every task, at most; more are joined by shuffles.
SENT_IDS = 2_000_000
#: Shingles and texts of one piece of a cell; a task holds two pieces.
PIECE_SHINGLES, PIECE_TEXTS = 4_000_000, 500
#: Allowed for rounding: in similarities, and in products of them and numbers of shingles.
SLACK, COUNT_SLACK = 1e-9, 1e-6


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of all runs of ``size`` words; a shorter text is one run, a blank one none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(hashes))

    return F.get(F.transform(F.array(words), runs), 0)  # the outer lambda holds the words, so they are split once


def text_copies(texts: DataFrame) -> DataFrame:
    """Texts (id, representative) that equal one with a smaller id, with the smallest such id."""
    keyed = texts.filter("text IS NOT NULL").select("id", F.sha2("text", 256).alias("_sha"))
    groups = keyed.groupBy("_sha").agg(F.min("id").alias("representative"), F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(groups, "_sha").filter("id <> representative").select("id", "representative")


def similar_texts(texts: DataFrame, above: float = ABOVE, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Pairs (id_a, id_b, jaccard) of distinct texts whose shingle sets reach the threshold, each text standing under its smallest
    id, and the copies (id, representative). ``texts`` hold id and text.

    Whole sets are read only of texts that share enough shingles with others to have a similar one. Among these a prefix filter finds
    every pair: ordered from the rarest shingle on, two sets of Jaccard similarity t share one of the first n - ceil(t n) + 1 shingles
    of each. Rare shingles come first, so a passage that many texts share is a join key only for texts that hold nothing rarer.
    Candidates are confirmed on the whole sets, where texts with an equal least shingle meet once instead of once a pair."""
    copies = cut_lineage(text_copies(texts))
    first = _by_ids(texts.filter("text IS NOT NULL").select("id", "text"), copies.select("id"), "left_anti")
    hopeful = cut_lineage(_hopeful(first, above, size))
    sets = cut_lineage(_by_ids(first, hopeful, "left_semi").select("id", shingles(F.col("text"), size).alias("s")))
    return _confirmed(cut_lineage(_candidates(sets, above)), sets, above), copies


def _by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows with or without the ids of a stored table; the rows are shuffled only if there are too many ids to send them."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", how)


def _must_share(n: Column, above: float) -> Column:
    """Shingles that a set of n shares with any similar one, at least."""
    return F.ceil(F.lit(above) * n - COUNT_SLACK)


def _hopeful(first: DataFrame, above: float, size: int) -> DataFrame:
    """Ids of texts that may have a similar one. In any fixed order, here that of the hashes, two sets share m shingles of the first
    n - ceil(t n) + m of each. m is a quarter of what a set must share, and a similar set may be smaller by t; a text with fewer shingles
    that other texts have among their first ones has no similar text."""
    def early(n: Column) -> Column:
        return F.floor(EARLY * above * n) + 1

    def front(s: Column) -> Column:
        n = F.size(s)
        return F.struct(n.alias("n"), F.slice(F.array_sort(s), F.lit(1), F.least(n, n - _must_share(n, above) + early(n)).cast("int")).alias("h"))

    fronts = F.get(F.transform(F.array(shingles(F.col("text"), size)), front), 0)  # the lambda holds the set, so it is made once
    rows = first.select("id", fronts.alias("f")).select("id", F.col("f.n").alias("n"), F.explode("f.h").alias("h"))
    shared = rows.withColumn("_f", F.count("*").over(Window.partitionBy("h"))).filter("_f > 1")
    return shared.groupBy("id", "n").agg(F.count("*").alias("_c")).filter(F.col("_c") >= early(_must_share(F.col("n"), above))).select("id")


def _candidates(sets: DataFrame, above: float) -> DataFrame:
    """Pairs (id_a, id_b, cell) that share a shingle of their prefixes early enough. A cell is a least shingle that both have, in one of
    three orders, with one piece or two of the texts that have it; a pair that agrees in none has a cell to itself."""
    rows = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("h"))
    kept = rows.withColumn("f", F.count("*").over(Window.partitionBy("h"))).filter("f > 1")  # a shingle found once can join nothing; it only takes a place in front
    kept = kept.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("o"))
    alone = F.col("n") - F.size("o")
    taken = F.col("n") - _must_share(F.col("n"), above) + 1 - alone
    least = sets.select("id", F.array(F.array_min("s"), F.array_max("s"), F.array_min(F.transform("s", lambda h: F.xxhash64(h)))).alias("least"))
    prefix = (kept.filter(taken > 0).select("id", "n", alone.alias("_alone"), F.slice("o.h", F.lit(1), taken.cast("int")).alias("o"))
              .join(least, "id").select("id", "n", "least", "_alone", F.posexplode("o").alias("_at", "h"))
              .select("id", "n", "least", (F.col("n") - F.col("_alone") - F.col("_at")).alias("left"), "h"))  # shingles from this one on
    a = prefix.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("least").alias("least_a"), "h")
    b = prefix.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), F.col("least").alias("least_b"), "h")
    # where two sets first meet they can share no more than what is left of either
    enough = F.least("left_a", "left_b") >= F.lit(above / (1 + above)) * (F.col("n_a") + F.col("n_b")) - COUNT_SLACK
    order = F.coalesce(*(F.when(F.get("least_a", F.lit(k)) == F.get("least_b", F.lit(k)), F.lit(k)) for k in range(3)), F.lit(3))
    met = a.join(b, "h").filter((F.col("id_a") < F.col("id_b")) & enough).select("id_a", "id_b", order.alias("k"), F.get("least_a", order).alias("v")).distinct()
    texts = least.join(sets.select("id", F.size("s").alias("n")), "id").select("n", F.posexplode("least").alias("k", "v"))
    large = texts.groupBy("k", "v").agg(F.greatest(F.ceil(F.sum("n") / PIECE_SHINGLES), F.ceil(F.count("*") / PIECE_TEXTS)).alias("pieces")).filter("pieces > 1")
    placed = met.join(F.broadcast(large), ["k", "v"], "left")  # at most three rows for 500 texts or 4,000,000 shingles
    piece_a, piece_b = (F.coalesce(F.pmod(F.xxhash64(i), "pieces"), F.lit(0)) for i in ("id_a", "id_b"))
    cell = F.when(F.col("k") == 3, F.xxhash64("id_a", "id_b")).otherwise(F.xxhash64("k", "v", F.least(piece_a, piece_b), F.greatest(piece_a, piece_b)))
    return placed.select("id_a", "id_b", cell.alias("cell"))


def _confirmed(candidates: DataFrame, sets: DataFrame, above: float) -> DataFrame:
    """Candidates (id_a, id_b, jaccard) that reach the threshold on the whole sets. A set goes once to each cell it has a candidate in."""
    needed = candidates.select("cell", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    members = needed.join(sets, "id").select(F.col("cell").alias("at"), "id", "s")

    def score(pairs: pa.Table, members: pa.Table) -> pa.Table:
        pairs, at = pairs.sort_by("id_a"), members.column("id").combine_chunks()
        lists = members.column("s").combine_chunks()
        n = lists.value_lengths().to_numpy()
        ends = np.cumsum(n)
        codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        a, b = (pc.index_in(pairs.column(c).combine_chunks(), value_set=at).to_numpy() for c in ("id_a", "id_b"))
        common, held = np.empty(len(a), dtype=np.int64), np.zeros(codes.max() + 1, dtype=bool)
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        for lo, hi in zip(starts, np.append(starts[1:], len(a))):
            mine = codes[ends[a[lo]] - n[a[lo]]:ends[a[lo]]]
            held[mine] = True
            for i in range(lo, hi):
                common[i] = np.count_nonzero(held[codes[ends[b[i]] - n[b[i]]:ends[b[i]]]])
            held[mine] = False
        jaccard = common / (n[a] + n[b] - common)
        found = pa.table({"id_a": pairs.column("id_a"), "id_b": pairs.column("id_b"), "jaccard": jaccard})
        return found.filter(pa.array(jaccard >= above - SLACK))

    kind = dict(sets.dtypes)["id"]
    return candidates.groupBy("cell").cogroup(members.groupBy("at")).applyInArrow(score, f"id_a {kind}, id_b {kind}, jaccard double")
