"""Shortest paths as one predecessor per source and node; paths are read back by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, drop_buckets, drop_round, write_buckets, write_round

SMALL_FRONTIER = 100_000  # nodes that a round extends whatever their distance


def _inner(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes (node) with one link in, one out, that are no start."""
    out = links.groupBy("node").agg(F.count("*").alias("_out")).filter("_out = 1")
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_in")).filter("_in = 1")
    return cut_lineage(out.join(into, "node").join(starts.withColumnRenamed("id", "node"), "node", "left_anti").select("node"))


def _chains(links: DataFrame, inner: DataFrame) -> DataFrame:
    """For each inner node the node its chain begins at, the weight and the links up to there, and the node just before it. Pointers double, so a chain of n nodes takes log2(n) rounds. Rings that no
    link enters stay open for ever and cannot be reached: they go once the number of open nodes no longer falls."""
    at_head = inner.select(F.col("node").alias("head"), F.lit(True).alias("open"))
    before = links.select(F.col("dst").alias("node"), F.col("node").alias("head"), F.col("node").alias("previous"), "weight", F.lit(1).cast("long").alias("hops"))
    chains, path = write_round(before.join(inner, "node", "left_semi").join(at_head, "head", "left").select(
        "node", "head", "previous", "weight", "hops", F.coalesce("open", F.lit(False)).alias("open")))
    last = None
    while (still := chains.filter("open").count()) and still != last:
        last = still
        further = chains.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("weight").alias("_weight"),
                                F.col("hops").alias("_hops"), F.col("open").alias("_open"))
        longer = chains.filter("open").join(further, "head").select(
            "node", F.col("_head").alias("head"), "previous", (F.col("weight") + F.col("_weight")).alias("weight"),
            (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_open").alias("open"))
        chains, fresh = write_round(chains.filter("NOT open").unionByName(longer))
        drop_round(chains.sparkSession, path)
        path = fresh
    return chains.filter("NOT open").drop("open")


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Least total weight from each source (id) to every node it reaches over edges (src, dst, weight): rows of source, node, distance,
    hops and previous, the node before it on the path (null for the source itself).

    Among paths of equal weight that with fewest links counts, then the least node before the end. Weights are not negative; edges without a weight,
    loops and all but the lightest of parallel edges do not matter. Chains count as one link while distances spread, and their inner
    nodes get theirs afterwards, so the rounds are as many as a path has branching nodes, or some more. The links are dealt out by node once and stay
    where they are. A round extends the nodes that got nearer and were not extended since: all of them while they are few, else those within half a mean
    weight of the nearest, as what lies behind will mostly get nearer still, so most links are followed once. It is one written table, and the table before it goes."""
    spark = edges.sparkSession
    # dealt out by node before they are grouped, so that grouping and bucketing share one shuffle
    given = edges.filter("src <> dst AND weight IS NOT NULL").select(F.col("src").alias("node"), "dst", "weight")
    dealt = given.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node")
    links, kept = write_buckets(dealt.groupBy("node", "dst").agg(F.min("weight").cast("double").alias("weight")), "node")
    starts = sources.select(F.col("id").cast(links.schema["node"].dataType).alias("id")).filter("id IS NOT NULL").distinct()
    inner = _inner(links, starts)
    steps = links.select("node", "dst", F.col("weight").alias("_weight"), F.lit(1).cast("long").alias("_hops"), F.col("node").alias("previous"))
    chains = None if inner.isEmpty() else _chains(links, inner)
    if chains is not None:
        to_branch = steps.join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
        through = to_branch.join(chains.select("node", "head", "weight", "hops"), "node").select(
            F.col("head").alias("node"), "dst", (F.col("weight") + F.col("_weight")).alias("_weight"), (F.col("hops") + 1).alias("_hops"), "previous")
        steps, branching = write_buckets(to_branch.join(inner, "node", "left_anti").unionByName(through), "node")
        chains = cut_lineage(chains)
        drop_buckets(spark, kept)
        kept = branching
    kind = links.schema["node"].dataType
    best, path = write_round(starts.select(
        F.col("id").alias("source"), F.col("id").alias("node"),
        F.struct(F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast(kind).alias("previous")).alias("way"), F.lit(True).alias("better")))
    width = (steps.agg(F.avg("_weight")).first()[0] or 0.0) / 2
    while (ahead := best.filter("better").agg(F.count("*").alias("n"), F.min("way.distance").alias("least")).first())["n"]:
        near = F.lit(True) if ahead["n"] <= SMALL_FRONTIER else F.col("way.distance") <= ahead["least"] + width
        reached = best.filter(F.col("better") & near).join(steps, "node").select("source", F.col("dst").alias("node"), F.struct(
            (F.col("way.distance") + F.col("_weight")).alias("distance"), (F.col("way.hops") + F.col("_hops")).alias("hops"), "previous").alias("_way"))
        shortest = reached.groupBy("source", "node").agg(F.min("_way").alias("_way"))
        better = F.col("_way").isNotNull() & (F.col("way").isNull() | (F.col("_way") < F.col("way")))
        nearer = better & (F.col("way").isNull() | (F.struct("_way.distance", "_way.hops") < F.struct("way.distance", "way.hops")))  # another node before it changes nothing behind
        waits = F.coalesce(F.col("better") & ~near, F.lit(False))
        best, fresh = write_round(best.join(shortest, ["source", "node"], "full").select(
            "source", "node", F.when(better, F.col("_way")).otherwise(F.col("way")).alias("way"), (nearer | waits).alias("better")))
        drop_round(spark, path)
        path = fresh
    drop_buckets(spark, kept)
    found = best.select("source", "node", "way.distance", "way.hops", "way.previous")
    if chains is None:
        return found
    inside = found.select("source", F.col("node").alias("head"), F.col("distance").alias("_distance"), F.col("hops").alias("_hops")).join(chains, "head")
    return found.unionByName(inside.select("source", "node", (F.col("_distance") + F.col("weight")).alias("distance"),
                                           (F.col("_hops") + F.col("hops")).alias("hops"), "previous"))


def path_steps(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes of the paths to the targets (source, node) that were reached: source, target, position from 0, node, one row each.

    ``paths`` come from ``shortest_paths``. Tables of the predecessors 1, 2, 4, ... links back are written; from the longest to the shortest, the nodes
    known so far stay and also jump, which gives every node of a path once, in log2(length) joins."""
    spark = paths.sparkSession
    paths = cut_lineage(paths)
    wanted = targets.select("source", "node").distinct().join(paths.select("source", "node", "hops"), ["source", "node"])
    longest = wanted.agg(F.max("hops")).first()[0] or 0
    jump, written, levels = paths.filter("previous IS NOT NULL").select("source", "node", F.col("previous").alias("up")), [], []
    while (1 << len(levels)) <= longest:
        jump, path = write_round(jump)
        written.append(path)
        levels.append(jump)
        jump = jump.join(jump.select("source", F.col("node").alias("up"), F.col("up").alias("_up")), ["source", "up"]).select(
            "source", "node", F.col("_up").alias("up"))
    rows = wanted.select("source", F.col("node").alias("target"), F.col("hops").alias("position"), "node")
    for k in reversed(range(len(levels))):
        both = F.array(F.struct("node", "position"), F.struct(F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position")))
        rows = rows.join(levels[k], ["source", "node"], "left").select("source", "target", F.explode(both).alias("_at")).select(
            "source", "target", "_at.position", "_at.node").filter("node IS NOT NULL")
    rows = cut_lineage(rows)
    for path in written:
        drop_round(spark, path)
    return rows


def path_between(edges: DataFrame, nodes: DataFrame, start: str, end: str) -> DataFrame:
    """Shortest path between two labels: distance and the labels in order; no row when there is none. ``nodes`` hold id and label."""
    steps = steps_between(edges, nodes, start, end)
    return steps.groupBy("source", "target").agg(F.max("distance").alias("distance"), F.array_sort(F.collect_list(F.struct("position", "label"))).alias("_p")).select(
        "distance", F.col("_p.label").alias("path"))


def steps_between(edges: DataFrame, nodes: DataFrame, start: str, end: str) -> DataFrame:
    """Shortest paths between two labels, one row per node: source, target, position, label and the distance from the start."""
    paths = cut_lineage(shortest_paths(edges, nodes.filter(F.col("label") == start).select("id")))
    ends = nodes.filter(F.col("label") == end).select(F.col("id").alias("node"))
    rows = path_steps(paths, paths.join(ends, "node", "left_semi"))
    named = rows.join(nodes.select(F.col("id").alias("node"), "label").distinct(), "node")
    return named.join(paths.select("source", "node", "distance"), ["source", "node"]).select("source", "target", "position", "label", "distance")
