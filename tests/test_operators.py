"""Operators against brute force on small frames, with hot keys and copies."""

import itertools
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import entities, evaluation, feedback, graph, grouping, inventory, ledger, retrieval, search, vector_search


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if n == 0 else float(np.dot(a, b) / n)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.25 * rng.normal(size=8)).astype("float32")) for i in range(240)]
    rows += [(240 + i, rows[3][1]) for i in range(80)]  # a hot group of copies
    rows.append((400, np.zeros(8, "float32")))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id long, embedding array<float>")
    return df, {i: v.astype("float64") for i, v in rows}


@pytest.mark.parametrize("rows", [4096, 64])
def test_similar_pairs_exact(vectors, rows):
    df, table = vectors
    got = {(r.id_a, r.id_b) for r in vector_search.similar_pairs(df, above=0.85, rows=rows).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(320), 2) if round(cos(table[a], table[b]), 9) > 0.85}


@pytest.mark.parametrize("blocks", [1, 5])
def test_similar_links_exact(spark, vectors, monkeypatch, blocks):
    """Links of each vector, copies counted; null and zero vectors have none. Only counts leave the tasks."""
    monkeypatch.setattr(vector_search, "grid_blocks", lambda count, dim: blocks)
    monkeypatch.setattr(vector_search, "SLICE_CELLS", 500)
    df, table = vectors
    df = df.unionByName(spark.createDataFrame([(401, None), (402, None)], df.schema))
    got = {r.id: (r.class_id, r.links) for r in vector_search.similar_links(df, above=0.3).collect()}
    near = {a: sum(round(cos(table[a], table[b]), 9) > 0.3 for b in table if b != a) for a in table}
    first = {a: min(b for b in table if (table[b] == table[a]).all()) for a in table}
    assert got == {**{a: (first[a], near[a]) for a in table}, 401: (401, 0), 402: (402, 0)}


def test_similar_pairs_take_the_grid_where_bounds_exclude_little(vectors, monkeypatch):
    """At a low threshold pivots would send a vector to most cells; the grid finds the same pairs."""
    taken = []
    grid = vector_search._grid_pairs
    monkeypatch.setattr(vector_search, "_grid_pairs", lambda reps, above, blocks: taken.append(blocks) or grid(reps, above, 3))
    monkeypatch.setattr(vector_search, "SLICE_CELLS", 500)
    df, table = vectors
    got = [(r.id_a, r.id_b) for r in vector_search.similar_pairs(df, above=0.1, rows=16).collect()]
    assert taken and len(got) == len(set(got))
    assert set(got) == {(a, b) for a, b in itertools.combinations(range(320), 2) if round(cos(table[a], table[b]), 9) > 0.1}


@pytest.mark.parametrize("blocks", [1, 4])
def test_directed_sums(vectors, monkeypatch, blocks):
    """Links to greater ids are counted, gifts of smaller ids added up, and no pairs are made."""
    monkeypatch.setattr(vector_search, "grid_blocks", lambda count, dim: blocks)
    monkeypatch.setattr(vector_search, "SLICE_CELLS", 500)
    monkeypatch.setattr(vector_search, "similar_classes", None)
    df, table = vectors
    got = {r.id: (r.ahead, r.received) for r in vector_search.directed_sums(df.withColumn("give", F.col("id").cast("double")), 0.3).collect()}
    near = {a: [b for b in table if b != a and round(cos(table[a], table[b]), 9) > 0.3] for a in table}
    assert got == {a: (sum(b > a for b in near[a]), sum(b for b in near[a] if b < a)) for a in table}


@pytest.mark.parametrize("blocks", [1, 4])
def test_listed_pairs_leave_the_tasks_in_slices(spark, vectors, monkeypatch, blocks):
    """All pairs of copies, too, with the labels of both ends; they are shuffled nowhere and no task holds those of a cell."""
    monkeypatch.setattr(vector_search, "grid_blocks", lambda count, dim: blocks)
    monkeypatch.setattr(vector_search, "SLICE_CELLS", 500)
    df, table = vectors
    df = df.unionByName(spark.createDataFrame([(401, None)], df.schema)).withColumn("label", F.concat(F.lit("doc"), 1000 - F.col("id")))
    found = vector_search.listed_pairs(df, above=0.3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and plan.index("FlatMapGroupsInPandas") < plan.index("Exchange") and plan.count("Exchange") == 1
    got = {(r.id_a, r.id_b): (r.label_a, r.label_b, r.score) for r in found.collect()}
    near = {(a, b): cos(table[a], table[b]) for a, b in itertools.combinations(table, 2) if round(cos(table[a], table[b]), 9) > 0.3}
    assert len(got) == found.count() and got == {p: (f"doc{1000 - p[0]}", f"doc{1000 - p[1]}", pytest.approx(c, abs=1e-9)) for p, c in near.items()}


def test_grid_sends_each_vector_a_bounded_number_of_times():
    assert [vector_search.grid_blocks(n, 64) for n in (1, 2000, 100_000, 600_000)] == [1, 2, 16, 16]


@pytest.mark.parametrize("block", [False, True])
def test_search_exact(vectors, monkeypatch, block):
    df, table = vectors
    if block:
        monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 0)
    queries = df.filter("id < 12").select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.id for r in vector_search.search(queries, df, k=7, exclude_self=True).collect()}
    for q in range(12):
        order = sorted((i for i in table if i != q), key=lambda i: (-round(cos(table[q], table[i]), 9), i))[:7]
        assert [got[(q, r + 1)] for r in range(7)] == order


@pytest.mark.parametrize("rows_only", [False, True])
def test_fused_search_exact(vectors, monkeypatch, rows_only):
    df, table = vectors
    if rows_only:
        monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 3 * 8 * 8 + 1)
    queries = df.filter("id in (0, 1, 2)").select(F.col("id").alias("query_id"), "embedding")
    fused = dict.fromkeys(table, 0.0)
    for q in (0, 1, 2):
        order = sorted(table, key=lambda i: (-round(cos(table[q], table[i]), 9), i))
        for rank, i in enumerate(order, 1):
            fused[i] += round(cos(table[q], table[i]), 9) / (rank + 60)
    want = sorted(fused, key=lambda i: (-round(fused[i], 12), i))[:5]
    assert [r.id for r in vector_search.fused_search(queries, df, 5).orderBy("rank").collect()] == want


def test_fusion_is_order_independent(spark):
    rows = [("g", i, r, 0.5) for i, r in [(1, 1), (2, 2), (3, 3), (2, 1), (1, 3)]]
    a = retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows, "q string, id int, rank int, score double"), "q", "id", 3)
    b = retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows[::-1], "q string, id int, rank int, score double"), "q", "id", 3)
    assert a.orderBy("rank").collect() == b.orderBy("rank").collect()


def test_concat_ordered_keeps_everything(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", 1), ("cold", 2)]
    df = spark.createDataFrame(rows, "k string, n long").withColumn("s", F.col("n").cast("string"))
    out = {r.k: r for r in grouping.concat_ordered(df.repartition(7), ["k"], ["n"], {"all": ("s", ",")}).collect()}
    assert out["hot"]["all"] == ",".join(map(str, range(5000))) and out["hot"].group_rows == 5000
    assert out["cold"]["all"] == "1,2"


def test_numbering_over_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("k"), "id", F.timestamp_seconds(F.col("id") * 300).alias("ts"))
    out = grouping.number_in_time(df, ["k"], "ts", "id").collect()
    assert all(r.number == (r.id + 1 if r.k == "hot" else r.id - 2899) for r in out)
    before = grouping.previous_in_time(df, ["k"], "id", "ts").collect()
    assert all(r.previous == (None if r.id in (0, 2900) else r.id - 1) for r in before)


@pytest.mark.parametrize("bins", [1, 7, 1000])
def test_exact_quantiles(spark, bins):
    rng = random.Random(1)
    data = {"a": [rng.expovariate(0.01) for _ in range(501)], "b": [5.0] * 40, "c": [1.0], "d": [1.0] * 30 + [1000.0]}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "g string, x double")
    for r in grouping.exact_quantiles(df, "g", "x", {"p50": 0.5, "p95": 0.95}, bins).collect():
        assert (r.p50, r.p95) == (pytest.approx(np.quantile(data[r.g], 0.5)), pytest.approx(np.quantile(data[r.g], 0.95)))


def test_exact_quantiles_of_a_hot_group_with_outliers(spark):
    """One value at 1e300 and many ties: brackets come from ranks, so they stay narrow and the result exact."""
    rng = random.Random(2)
    data = [round(rng.gauss(0, 1), 3) for _ in range(60_000)] + [7.0] * 30_000 + [1e300, float("-inf")]
    df = spark.createDataFrame([("hot", x) for x in data] + [("few", 1.0), ("few", 2.0), ("none", None)], "g string, x double").repartition(8)
    points = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.9999, "p100": 1.0}
    got = {r.g: r for r in grouping.exact_quantiles(df, "g", "x", points, 500).collect()}
    ordered = sorted(data)
    for name, p in points.items():
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert got["hot"][name] == (low if low == high else pytest.approx(low + (high - low) * (at - math.floor(at))))
        assert got["few"][name] == pytest.approx(1 + p)
    assert set(got) == {"hot", "few"}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, v int, s string")
    once = ledger.upsert(base, new, ["k"], "v")
    twice = ledger.upsert(once, new, ["k"], "v")
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 2, "z"), ("b", 1, "y")]


def test_excluded_roots_do_not_match_prefixes(spark):
    inv = spark.createDataFrame([("/a/b/c",), ("/a/bc/d",), ("/a/b",), ("/x",)], "path string")
    kept = inventory.without_excluded(inv, spark.createDataFrame([("/a/b",)], "root string"))
    assert {r.path for r in kept.collect()} == {"/a/bc/d", "/x"}


def test_collisions(spark):
    incoming = spark.createDataFrame([("/t/a.txt", "1"), ("/t/b.txt", "2"), ("/t/c.txt", "3")], "target_path string, sha256 string")
    existing = spark.createDataFrame([("/t/a.txt", "1"), ("/t/b.txt", "x")], "path string, sha256 string")
    got = {r.target_path: (r.action, r.final_path) for r in inventory.resolve_collisions(incoming, existing, "S").collect()}
    assert got == {"/t/a.txt": ("SKIPPED", None), "/t/b.txt": ("RESOLVED", "/t/b_CONFLICT_S.txt"), "/t/c.txt": ("MOVED", "/t/c.txt")}


def test_fuzzy_names_and_merge_match_brute_force(spark):
    rng = random.Random(5)
    words = ["Bauhaus", "Amazon", "Telekom", "Stadtwerke", "Allianz", "Abc", "Abcd", "Ab"]
    names = set(words)
    for _ in range(150):
        w = list(rng.choice(words))
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w.insert(i, rng.choice("abcdexyz "))
            elif i < len(w) and len(w) > 1:
                w.pop(i)
        if "".join(w).strip():
            names.add("".join(w).strip())
    ordered = sorted(names)
    ratio = {}
    for a, b in itertools.combinations(ordered, 2):
        if a[0].lower() == b[0].lower():
            r = SequenceMatcher(None, a.lower(), b.lower()).ratio()
            if r >= 0.85:
                ratio[(a, b)] = r
    df = spark.createDataFrame([(n,) for n in ordered], "name string")
    assert {(r.a, r.b) for r in entities.similar_names(df).collect()} == set(ratio)
    seen, leader = set(), {}
    for a in ordered:
        if a not in seen:
            for b in [a, *[b for b in ordered if (a, b) in ratio and b not in seen]]:
                seen.add(b)
                leader[b] = a
    assert {r.name: r.leader for r in entities.merge_entities(df).collect()} == leader


@pytest.mark.parametrize("at_once", [1 << 20, 40, 1])
def test_merging_needs_no_round_per_step_of_a_chain(spark, monkeypatch, at_once):
    """Chains of matches are followed in one pass a letter; rounds only thin out letters with many matches."""
    rng = random.Random(2)
    names = [f"{letter}{i:03d}" for letter in "aéZ" for i in range(70)]
    chain = {(a, b) for a, b in zip(names, names[1:]) if a[0] == b[0]}
    edges = sorted(chain | {tuple(sorted(rng.sample([n for n in names if n[0] == "Z"], 2))) for _ in range(30)})
    monkeypatch.setattr(entities, "similar_names", lambda *_: spark.createDataFrame(edges, "a string, b string"))
    monkeypatch.setattr(entities, "EDGES_AT_ONCE", at_once)
    written, cut = [], entities.cut_lineage
    monkeypatch.setattr(entities, "cut_lineage", lambda df: written.append(1) or cut(df))
    leaders, want = set(), {}
    for n in sorted(names):
        led = [a for a, b in edges if b == n and a in leaders]
        want[n] = min(led, default=n)
        leaders |= set() if led else {n}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.leader for r in entities.merge_entities(df).collect()} == want
    assert len(written) == 2 or at_once < 1000


def test_names_around_the_length_of_spellings(spark):
    """Names of common pieces, all with one first letter, on both sides of the length up to which they meet under spellings; a name has few of these."""
    from math import comb

    rng, names = random.Random(8), set()
    while len(names) < 260:
        w = list("E" + "".join(rng.choice(["ing", "tion", "sch", "er", "th", "o"]) for _ in range(rng.randint(1, 7))))
        names.add("".join(w))
        for _ in range(rng.randint(1, 4)):
            w.pop(rng.randrange(1, len(w))) if rng.random() < 0.6 and len(w) > 2 else w.insert(rng.randrange(1, len(w) + 1), rng.choice("inge"))
            names.add("".join(w))
    for ratio in (0.8, 0.85, 0.9):
        longest = entities._spelt_up_to(ratio)
        kept = entities._kept_lengths(ratio, longest)
        assert longest >= entities._short_bounds(ratio)[0] and all(sum(comb(m - 1, c - 1) for c in sizes) <= entities.SPELLINGS for m, sizes in kept.items())
        want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if SequenceMatcher(None, a.lower(), b.lower()).ratio() >= ratio}
        assert min(len(x) for p in want for x in p) <= longest < max(len(x) for p in want for x in p)
        df = spark.createDataFrame([(n,) for n in names], "name string")
        assert {(r.a, r.b) for r in entities.similar_names(df, ratio).collect()} == want


def test_shortest_path_fixture(spark):
    steps = [("Review_A", "Project_X"), ("Project_X", "Budget"), ("Budget", "Finance_Dept"), ("Review_A", "Finance_Dept")]
    weights = [1.0, 1.0, 1.0, 5.0]
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in zip(steps, weights)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(n, n) for n in {x for s in steps for x in s}], "id string, label string")
    row = graph.path_between(edges, nodes, "Review_A", "Finance_Dept").first()
    assert row.distance == 3.0 and row.path == ["Review_A", "Project_X", "Budget", "Finance_Dept"]
    assert graph.path_between(edges, nodes, "Budget", "Review_A").isEmpty()


def test_pagerank_sums_to_one(spark):
    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 40)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.range(45)
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, rounds=8).collect()}
    rank = dict.fromkeys(range(45), 1 / 45)
    out = {i: [d for s, d in pairs if s == i] for i in range(45)}
    for _ in range(8):
        dangling = sum(rank[i] for i in range(45) if not out[i])
        fresh = dict.fromkeys(range(45), 0.15 / 45 + 0.85 * dangling / 45)
        for i in range(45):
            for d in out[i]:
                fresh[d] += 0.85 * rank[i] / len(out[i])
        rank = fresh
    assert sum(got.values()) == pytest.approx(1.0)
    assert all(got[i] == pytest.approx(rank[i]) for i in rank)
    for _ in range(150):
        dangling = sum(rank[i] for i in range(45) if not out[i])
        rank = {i: 0.15 / 45 + 0.85 * dangling / 45 + sum(0.85 * rank[j] * out[j].count(i) / len(out[j]) for j in range(45) if out[j]) for i in range(45)}
    settled = {r.id: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    assert all(settled[i] == pytest.approx(rank[i], abs=1e-5) for i in rank)


def test_pagerank_of_edges_and_similar_vectors(spark, vectors, monkeypatch):
    """The same ranks as with the links of the vectors stored as edges, without any pairs."""
    df, table = vectors
    node = F.concat(F.lit("n"), 1000 - F.col("id"))
    near = [(f"n{1000 - a}", f"n{1000 - b}") for a, b in itertools.combinations(sorted(table), 2) if round(cos(table[a], table[b]), 9) > 0.3]
    other = [(f"n{1000 - i}", f"k{j}") for i in range(0, 300, 3) for j in range(i % 4)] + [("k0", "n1000")]
    columns = "src string, dst string"
    nodes = df.select(node.alias("id")).unionByName(spark.createDataFrame([(f"k{j}",) for j in range(5)], "id string"))
    want = {r.id: r["rank"] for r in graph.pagerank(nodes, spark.createDataFrame(near + other, columns), rounds=4).collect()}
    for name in ("similar_pairs", "similar_classes", "listed_pairs", "_cell_pairs"):
        monkeypatch.setattr(vector_search, name, None)
    got = {r.id: r["rank"] for r in graph.pagerank_with_similar(nodes, spark.createDataFrame(other, columns), df.withColumn("node", node), above=0.3, rounds=4).collect()}
    assert len(want) == 326 and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_median_sample(spark):
    rows = [("a", f"/p{i}", i * 10) for i in range(5)] + [("b", "/q", 7)] + [("c", f"/z{i}", 0) for i in range(4)]
    got = {(r.extension, r.path) for r in inventory.sample_per_extension(spark.createDataFrame(rows, "extension string, path string, size_bytes long")).collect()}
    assert got == {("a", "/p2"), ("a", "/p0"), ("b", "/q"), ("c", "/z0"), ("c", "/z2")}


def test_merge_by_url(spark):
    rows = [(1, "u", "a"), (2, None, "b"), (3, "u", "c"), (4, "v", "d")]
    got = {(r.url, r.content) for r in search.merge_by_url(spark.createDataFrame(rows, "position long, url string, content string")).collect()}
    assert got == {("u", "a\n\nc"), (None, "b"), ("v", "d")}


def test_pattern_review(spark):
    rows = [("Privat", "Arbeit")] * 3 + [("Medien", "Privat")]
    df = spark.createDataFrame(rows, "predicted_category string, actual_category string").withColumn("ts", F.current_timestamp())
    out = feedback.review_list(feedback.patterns(df)).collect()
    assert [r.suggestion for r in out] == ["Dateien in 'Privat' sollten auf 'Arbeit' geprüft werden"]


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "gamma")], "id long, text string")
    cache = texts.filter("id = 1").select(retrieval.cache_key(F.col("text"), "m").alias("key"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    out = {r.id: r.embedding for r in retrieval.embed(texts, cache, "m").collect()}
    assert out[1] == [1.0] and out[2] == out[3] and math.isclose(sum(x * x for x in out[2]), 1.0, rel_tol=1e-6)


def test_silhouette_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 7) for i in range(80)] + [(90, [1.0, 0.0, 0.0, 0.0], 99)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, label long")
    whole = {r.id: r.silhouette for r in evaluation.silhouette(df).collect()}
    monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 64)
    sliced = {r.id: r.silhouette for r in evaluation.silhouette(df).collect()}
    assert whole.keys() == sliced.keys() and all(sliced[i] == pytest.approx(whole[i]) for i in whole) and whole[90] == 0.0
