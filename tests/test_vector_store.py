import random

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import vector_store as store

SCHEMA = "id string, embedding array<float>, label int"


def rows(frame):
    return {r.id: (list(r.embedding) if r.embedding is not None else None, r.label) for r in frame.collect()}


def test_versions_follow_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_BYTES", 2000)
    path, rng = str(tmp_path / "vectors"), random.Random(1)
    now: dict = {}
    history = {}
    for step in range(4):
        if step == 2:
            gone = rng.sample(sorted(now), 20)
            version = store.delete(spark.createDataFrame([(i,) for i in [*gone, "unknown"]], "id string"), path)
            now = {k: v for k, v in now.items() if k not in gone}
        else:
            new = {f"p{rng.randrange(90)}": ([float(step), rng.randrange(9) / 2], rng.randrange(5)) for _ in range(60)}
            new["nothing"] = (None, step)
            version = store.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()] + [(None, [1.0], 1)], SCHEMA).repartition(3), path)
            now = {**now, **new}
        history[version] = now
    compacted = store.compact(spark, path)
    history[compacted] = now
    assert sorted(history) == store.versions(spark, path) == [1, 2, 3, 4, 5]
    assert all(rows(store.read(spark, path, v)) == want for v, want in history.items())
    assert rows(store.read(spark, path)) == now and len(store._generations(spark, path, compacted)) == 1
    assert len(spark.read.parquet(f"{path}/data/*").inputFiles()) > 5  # generations of several ranges
    store.expire(spark, path)
    assert store.versions(spark, path) == [compacted] and rows(store.read(spark, path)) == now


def test_failed_and_late_writers_change_nothing(spark, tmp_path):
    path = str(tmp_path / "vectors")
    with pytest.raises(ValueError):
        store.read(spark, path)
    first = spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 2)], SCHEMA)
    assert store.upsert(first, path) == 1
    broken = first.withColumn("label", F.expr("IF(id = 'b', raise_error('lost'), 3)").cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken, path)
    assert store.versions(spark, path) == [1] and rows(store.read(spark, path)) == {"a": ([1.0], 1), "b": ([2.0], 2)}
    assert store.upsert(first.where("id = 'a'").withColumn("label", F.lit(7)), path, after=1) == 2
    with pytest.raises(store.Conflict):  # a writer that also began at version 1
        store.upsert(first, path, after=1)
    assert rows(store.read(spark, path)) == {"a": ([1.0], 7), "b": ([2.0], 2)}
    store.expire(spark, path)
    assert len(spark.read.parquet(f"{path}/data/*").select("id").collect()) == 3


def test_the_last_of_repeated_ids(spark, tmp_path):
    path = str(tmp_path / "vectors")
    repeated = spark.createDataFrame([("a", [float(n)], n, n) for n in range(20)], SCHEMA + ", order int").repartition(4)
    store.upsert(repeated, path)
    assert rows(store.read(spark, path)) == {"a": ([19.0], 19)}
    store.upsert(repeated.limit(0), path)
    assert rows(store.read(spark, path)) == {"a": ([19.0], 19)}
