import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import keyword_index, retrieval
from tests.test_queries import SF

WORDS = ["the", "of"] * 40 + [f"w{n}" for n in range(40)] * 3 + [f"rare{n}" for n in range(300)]


def corpus(seed, n, first=0, step=1):
    rng = random.Random(seed)
    return [(first + i * step, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 20, 60, 200])))) for i in range(n)]


def rows(frame):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in frame.collect())


@pytest.mark.parametrize("seed,window,step,k", [(2, 16, 1, 3), (3, 64, 977, 5)])
def test_search_equals_a_full_evaluation(spark, tmp_path, monkeypatch, seed, window, step, k):
    monkeypatch.setattr(keyword_index, "WINDOW", window)
    monkeypatch.setattr(keyword_index, "POSTINGS_A_PART", 2000)
    docs = corpus(seed, 400, -50 * step, step) + [(10 ** 12, None), (10 ** 12 + 1, ""), (10 ** 12 + 2, "w1 w1 w1 rare5")]
    path = str(tmp_path / "index")
    parts = [docs[::2], docs[1::2]]
    frames = [spark.createDataFrame(p, "id bigint, text string") for p in parts]
    rng = random.Random(seed)
    asked = [(q, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12)))) for q in range(25)] + [(90, ""), (91, None), (92, "nowhere"), (93, "the of"), (94, "w1 w1 the")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    seen = None
    for frame in frames:  # every batch is found as soon as it is added
        seen = frame if seen is None else seen.unionByName(frame)
        keyword_index.add_batch(frame, path)
        assert rows(keyword_index.search(spark, path, queries, k)) == rows(retrieval.bm25(seen, queries, k))
    assert len(keyword_index._batches(spark, path)) == 2


def test_ids_must_be_new_and_a_failed_batch_leaves_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "id bigint, text string")
    queries = spark.createDataFrame([(1, "beta gamma")], "query_id int, query string")
    assert keyword_index.search(spark, path, queries).count() == 0
    keyword_index.add_batch(docs, path)
    before = rows(keyword_index.search(spark, path, queries))
    for bad in ([(2, "beta")], [(5, "x y"), (5, "z")], [(None, "beta")]):
        with pytest.raises(ValueError):
            keyword_index.add_batch(spark.createDataFrame(bad, "id bigint, text string"), path)
    unfinished = spark.createDataFrame([("beta", 0, 1, 9, 1, [7], [9], [1], 0)], keyword_index._BLOCK)
    unfinished.write.partitionBy("part").parquet(f"{path}/postings/unfinished")  # a writer that was lost before its entry
    assert rows(keyword_index.search(spark, path, queries)) == before
    keyword_index.add_batch(docs.limit(0), path)
    assert rows(keyword_index.search(spark, path, queries)) == before


def test_a_search_reads_no_documents(spark):
    from shelfmark.plans.catalog import QUERIES

    QUERIES["rt2_bm25"](spark, SF).count()
    frame = QUERIES["rt2_bm25"](spark, SF)
    assert "documents.parquet" not in frame._jdf.queryExecution().toString()


def test_postings_are_not_shuffled(spark, tmp_path):
    """A window's blocks are made and written where its texts are, so they lie in one file a folder."""
    docs = spark.range(40_000).selectExpr("id", "concat('w', id % 7, ' w', id % 11, ' common') AS text").repartition(8)
    path, coalesce = str(tmp_path / "index"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        keyword_index.add_batch(docs, path)
    finally:
        spark.conf.set(coalesce, before)
    files = spark.read.parquet(f"{path}/postings/*").select("window", F.input_file_name().alias("file"))
    assert files.groupBy("window").agg(F.count_distinct("file").alias("n")).agg(F.max("n")).first()[0] == 1


def test_a_documents_scores_are_summed_in_one_task(spark):
    """Postings are dealt out by document once, before they are multiplied by the queries."""
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} common") for i in range(60)], "id bigint, text string")
    queries = spark.createDataFrame([(q, f"common w{q}") for q in range(5)], "query_id int, query string")
    found = retrieval.bm25(docs, queries, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(query_id#\d+, id#", plan)
    assert found.count() == 15
