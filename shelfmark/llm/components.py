"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import drop_table, write_table


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One half-round. Large star: every node ties its larger neighbours to its least neighbour; small star: a node
    ties itself and its smaller neighbours to the least of them. Minima are reduced before the shuffle and joined back,
    so a hub's neighbours are never gathered in one place."""
    if larger:
        links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return links.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b; any order, of one comparable type, never null); root is the least
    node that can be reached. Alternates large and small stars until the edges no longer change, which needs about log2(n)
    rounds; each round is one table in the shared folder and the one before it is deleted. An empty table gives an empty one."""
    current = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        new = write_table(_stars(_stars(current.frame, larger=True), larger=False))
        seen = new.frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(current)
        current = new
        if seen == state:
            break
        state = seen
    # every edge now leads straight to a root
    stars = current.frame
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
