"""Shortest paths against Dijkstra on small graphs, long chains, rings."""

import heapq
import random

import pytest

from shelfmark.operators import paths


def dijkstra(edges, source):
    """Least (distance, hops, previous) per node."""
    links = {}
    for a, b, w in edges:
        if a != b and w is not None:
            links.setdefault(a, {})[b] = min(w, links.get(a, {}).get(b, w))
    done, heap = {}, [((0.0, 0, -1), source)]
    while heap:
        way, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = way
        for other, w in links.get(node, {}).items():
            heapq.heappush(heap, ((way[0] + w, way[1] + 1, node), other))
    return done


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight double")


@pytest.mark.parametrize("seed", [1, 3])
def test_equals_dijkstra(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(0 if seed == 3 else 1, 6))) for _ in range(90)]
    edges += [(100 + i, 101 + i, 1.0) for i in range(12)] + [(5, 100, 2.0), (112, 7, 1.0), (3, 4, None), (60, 61, 1.0), (61, 60, 1.0)]
    sources = [0, 5, 104, 60, 999]
    got = paths.shortest_paths(frame(spark, edges), spark.createDataFrame([(s,) for s in sources + [0]], "id long")).collect()
    want = {(s, node): way for s in sources for node, way in dijkstra(edges, s).items()}
    assert {(r.source, r.node): (r.distance, r.hops, -1 if r.previous is None else r.previous) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("small", [0, 5])
def test_nearest_nodes_first(spark, monkeypatch, small):
    """Rounds that extend only the nearest of many nodes, over links that are dealt out once and shuffled in no round."""
    monkeypatch.setattr(paths, "SMALL_FRONTIER", small)
    written, write = [], paths.write_round
    monkeypatch.setattr(paths, "write_round", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(11)
        edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(0, 50))) for _ in range(400)] + [(i, i + 1, 1.0) for i in range(100, 110)] + [(7, 100, 0.0)]
        got = paths.shortest_paths(frame(spark, edges), spark.createDataFrame([(0,), (3,)], "id long")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(s, node): way for s in (0, 3) for node, way in dijkstra(edges, s).items()}
    assert {(r.source, r.node): (r.distance, r.hops, -1 if r.previous is None else r.previous) for r in got} == want
    rounds = [p for p in written if "_weight" in p and "_way" in p]
    assert len(rounds) > 3 and all("Bucketed: true" in p for p in rounds)


def test_steps_follow_predecessors(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 9))) for _ in range(70)]
    found = paths.shortest_paths(frame(spark, edges), spark.createDataFrame([(0,), (1,)], "id long"))
    steps = paths.path_steps(found, found).collect()
    for source in (0, 1):
        ways = dijkstra(edges, source)
        for target in ways:
            want, node = [], target
            while node != -1:
                want.append(node)
                node = ways[node][2]
            got = sorted((r.position, r.node) for r in steps if r.source == source and r.target == target)
            assert got == list(enumerate(reversed(want)))


def test_path_of_a_thousand_links(spark):
    chain = [(i, i + 1, 1.0) for i in range(1000)]
    branches = [(i, 5000 + i, 1.0) for i in (250, 500, 750)] + [(0, 1000, 5000.0)]
    rings = [(9000 + i, 9000 + (i + 1) % 37, 1.0) for i in range(37)]
    edges = frame(spark, chain + branches + rings)
    nodes = edges.selectExpr("src AS id").union(edges.selectExpr("dst")).distinct().selectExpr("id", "concat('n', id) AS label")
    row = paths.path_between(edges, nodes, "n0", "n1000").first()
    assert row.distance == 1000.0 and row.path == [f"n{i}" for i in range(1001)]
    assert paths.path_between(edges, nodes, "n1000", "n0").isEmpty() and paths.path_between(edges, nodes, "n0", "n9000").isEmpty()
    assert paths.path_between(edges, nodes, "n9001", "n9000").first().distance == 36.0
    assert paths.path_between(edges, nodes, "nobody", "n0").isEmpty()


def test_no_edges(spark):
    edges = frame(spark, [(1, 1, 2.0), (1, 2, None)])
    got = paths.shortest_paths(edges, spark.createDataFrame([(1,), (None,)], "id long")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0.0, 0, None)]
    assert [tuple(r) for r in paths.path_steps(paths.shortest_paths(edges, spark.createDataFrame([(1,)], "id long")), spark.createDataFrame([(1, 1), (1, 2)], "source long, node long")).collect()] == [(1, 1, 0, 1)]


def test_ranked_by_kind(spark):
    from shelfmark.operators import graph

    nodes = spark.createDataFrame([(f"n{i:02}", f"l{i}", ("document", "keyword", "author")[i % 3]) for i in range(60)], "id string, label string, type string")
    ranks = spark.createDataFrame([(f"n{i:02}", 1.0 - i // 2 / 100) for i in range(60)], "id string, rank double")
    got = sorted(tuple(r) for r in graph.ranked_by_kind(ranks, nodes, per_kind=5).collect())
    assert got == [(kind, p + 1, f"l{3 * p + k}", 1.0 - (3 * p + k) // 2 / 100) for k, kind in enumerate(("document", "keyword")) for p in range(5)]


def test_evidence_by_url(spark):
    from shelfmark.operators import search

    rows = [("u", 1, [(3,), None, (4,)]), ("u", 0, [(4,)]), (None, 2, [(4,), (4,)]), ("", 3, [(4,)]), ("v", 4, None), ("w", 5, [])]
    df = spark.createDataFrame(rows, "url string, position int, evidence array<struct<page:int>>")
    got = sorted((r.first_position, r.first_index, r.url, r.entry.page) for r in search.evidence_by_url(df).collect())
    assert got == [(0, 0, "u", 4), (1, 0, "u", 3), (2, 0, None, 4), (3, 0, None, 4)]
