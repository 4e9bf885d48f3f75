"""Queries that take all of their input, against brute force or SQL."""

import itertools
import os
from difflib import SequenceMatcher
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.operators import vector_search
from shelfmark.plans.catalog import QUERIES
from shelfmark.plans.queries_graph import vendor_names

SF = "/root/testdata/sf0.001"


def test_vendor_names_of_all_lengths(spark):
    texts = ["Anna met Anne and Bo at Siemens; IBM and a did not come", "Élan, Elan. Bauhausen", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.name for r in vendor_names(SimpleNamespace(docs=docs)).collect()} == {"Anna", "Anne", "Bo", "Siemens", "Élan", "Elan", "Bauhausen"}


def test_fuzzy_names_and_merging_of_all_names(spark):
    names = sorted({n for (n,) in spark.read.parquet(f"{SF}/documents.parquet").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0)))).collect()})
    blocks = {k: list(v) for k, v in itertools.groupby(sorted(names, key=lambda n: (n[0].lower(), n)), key=lambda n: n[0].lower())}
    match = {(a, b) for block in blocks.values() for a, b in itertools.combinations(block, 2)
             if 2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b)) - 1e-9 and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.85}
    got = {(r.a, r.b) for r in QUERIES["j12_fuzzy_names"](spark, SF).collect()}
    assert got == match and any(len(a) < 8 and len(b) < 8 for a, b in got)
    leaders, leader = set(), {}
    earlier = {}
    for a, b in match:
        earlier.setdefault(b, []).append(a)
    for n in names:
        led = [a for a in sorted(earlier.get(n, [])) if a in leaders]
        leader[n] = led[0] if led else n
        if not led:
            leaders.add(n)
    assert {r.name: r.leader for r in QUERIES["g9_merge_entities"](spark, SF).collect()} == leader


def test_pagerank_converges(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.round(x @ x.T, 9) > 0.2
    links &= ids[:, None] < ids[None, :]
    used = links.any(axis=0) | links.any(axis=1)
    links, ids = links[np.ix_(used, used)], ids[used]
    n, degree = len(ids), links.sum(axis=1)
    rank, change = np.full(n, 1 / n), n
    while change >= V.PAGERANK_TOLERANCE * n:
        fresh = (1 - V.PAGERANK_ALPHA) / n + V.PAGERANK_ALPHA * (links.T @ (rank / np.maximum(degree, 1)) + rank[degree == 0].sum() / n)
        rank, change = fresh, np.abs(fresh - rank).sum()
    got = {r.id: r.rank for r in QUERIES["g5_pagerank"](spark, SF).collect()}
    assert set(got) == set(ids.tolist()) and max(abs(got[i] - r) for i, r in zip(ids.tolist(), rank)) < 2e-9


def test_catalog_profile_covers_every_table(spark):
    rows = QUERIES["s7_catalog_profile"](spark, SF).collect()
    assert {f"{r.table_name}.parquet" for r in rows} == set(os.listdir(SF))
    assert {r.table_name: r["columns"] for r in rows}["documents"].startswith("doc_id:bigint,text:string")


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    """A table may be a folder of files; each of its rows is read once."""
    for name in ("documents", "labels", "conversations", "events"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        table.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("s17_queue_batches", "st1_route_jobs", "st2_extract_handoff", "st8_pattern_counts", "st9_drain_to_index", "st3_once_per_job"):
        one, many = (QUERIES[query](spark, d).collect() for d in (SF, str(tmp_path)))
        assert one and sorted(map(str, one)) == sorted(map(str, many)), query


def test_graph_queries_write_no_similarity_edges(spark, monkeypatch):
    """Nodes, numbers and neighbours of the graph do without the pairs, whose number grows with the square of the vectors."""
    want = {q: sorted(map(str, QUERIES[q](spark, SF).collect())) for q in ("g1_graph_edges", "g1_graph_nodes", "g4_graph_stats", "g7_related_documents")}
    monkeypatch.setattr(vector_search, "similar_pairs", None)
    monkeypatch.setattr(vector_search, "similar_classes", None)
    monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 0)
    for q in ("g1_graph_nodes", "g4_graph_stats", "g7_related_documents"):
        assert sorted(map(str, QUERIES[q](spark, SF).collect())) == want[q], q
    assert int(want["g4_graph_stats"][0].split("edges=")[1].split(",")[0]) == len(want["g1_graph_edges"])


def test_corpus_ranks_write_no_similarity_edges(spark, monkeypatch):
    for name in ("similar_pairs", "similar_classes", "listed_pairs", "_cell_pairs"):
        monkeypatch.setattr(vector_search, name, None, raising=False)
    assert QUERIES["g5_pagerank_corpus"](spark, SF).count() == 20 and 0 < QUERIES["g5_ranked_by_kind"](spark, SF).count() <= 20


def test_similarity_joins_list_every_pair(spark, tmp_path):
    """A row per pair with its score, pairs of copies among them; rows that come twice meet twice, null vectors and equal ids never."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    table = [(i, (centres[i % 5] + 0.3 * rng.normal(size=8)).astype("float32").tolist(), i % 3) for i in range(60)]
    table += [(60, table[4][1], 0), (61, None, 1), (7, table[7][1], 1)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    own = [(i, np.array(v, float)) for i, v, _ in table if v is not None]
    moved = [(i + 1_000_000, np.concatenate([[v[0] + 0.05], v[1:]])) for i, v in own if i % 5 == 0]
    copies = [(i + k, v) for i, v in own if i % 7 == 0 for k in (2_000_000, 3_000_000)]
    for query, rows, above in (("j9_similar_pairs", own + moved + copies, 0.85), ("j9_similar_pairs_wide", own, 0.3), ("g3_similarity_edges", own, 0.35)):
        scored = [(a, b, float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))) for a, x in rows for b, y in rows if a < b]
        want = sorted((a, b, round(s, 6)) for a, b, s in scored if round(s, 9) > above)
        got = sorted((r.id_a, r.id_b, r.score) for r in QUERIES[query](spark, str(tmp_path)).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1.1e-6), query
        assert len(got) > 100, query
