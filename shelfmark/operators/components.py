"""Connected components of a table of pairs by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import drop_round, write_round


def _nearest(pairs: DataFrame, number: int) -> DataFrame:
    """(node, to): each node with itself or that neighbour which comes first in the round's random order."""
    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(number), c), F.col(c).alias("to"))

    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(rank("b")).alias("m"))  # reduced before the shuffle, so a hub's neighbours do not meet
    return first.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a")).getField("to").alias("to"))


def components(pairs: DataFrame, most_rounds: int = 200) -> tuple[DataFrame, int]:
    """((node, component), rounds): for every node of ``pairs`` (a, b) the least node it can be reached from, itself included; pairs with a null are left out.

    Each round every node goes to the first of itself and its neighbours in a new random order, and pairs follow their nodes. Nodes that share a component stay
    connected, and their number falls by a quarter or more on average whatever the shape, so chains need about as many rounds as stars. Then the rounds are read
    backwards, each a join that gives the nodes of a round the component of the node they went to."""
    spark = pairs.sparkSession
    open_, path = write_round(pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    made, moves = [path], []
    while True:
        linked = open_.where("a <> b")
        if linked.isEmpty():
            break
        if len(moves) == most_rounds:
            raise RuntimeError(f"not contracted after {most_rounds} rounds")
        to, path = write_round(_nearest(linked, len(moves)))
        made.append(path)
        moves.append(to)
        a, b = (to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        open_, path = write_round(linked.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct())
        made.append(path)
    loops = spark.read.parquet(made[0]).where("a = b").select(F.col("a").alias("node"))
    group = None
    for to in reversed(moves):
        if group is None:
            step = to.select("node", F.col("to").alias("group"))
        else:
            known = group.select(F.col("node").alias("to"), "group")
            step = to.join(known, "to", "left").select("node", F.coalesce("group", "to").alias("group"))
        group, path = write_round(step)
        made.append(path)
    alone = loops.distinct().select("node", F.col("node").alias("group"))
    whole = alone if group is None else group.unionAll(alone.join(group, "node", "left_anti"))
    least = whole.groupBy("group").agg(F.min("node").alias("component"))
    result, _ = write_round(whole.join(least, "group").select("node", "component"))
    for path in made:
        drop_round(spark, path)
    return result, len(moves)
