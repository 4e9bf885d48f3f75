import math
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import ngram_scores as ns


def plain(docs, min_count=2):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    counts = Counter(tuple(w[i:i + n]) for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for (key, _), w in zip(docs, words):
        micros, orders = 0, [0, 0, 0]
        for i in range(len(w)):
            longest = min(i, 2) + 1
            for n in range(longest, 0, -1):
                gram = tuple(w[i - n + 1:i + 1])
                if n == 1 or counts[gram] >= min_count:
                    value = 0.4 ** (longest - n) * counts[gram] / (total if n == 1 else counts[gram[:-1]])
                    micros += round(math.log(value) * 1e6)
                    orders[n - 1] += 1
                    break
        out.append((key, len(w), micros, *orders))
    return out


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ns, "BLOCK_BYTES", size)
    monkeypatch.setattr(ns, "PART_BYTES", size // 2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    docs = [(i, t[:400] if t else t) for i, t in rows] + [(900, None), (901, ""), (902, "A"), (None, "the the The the"), (None, "the the The the"), (903, "x " * 50_000)]
    frame = spark.createDataFrame([(a, b, 1, "q") for a, b in docs], "doc_id bigint, text string, block int, part string")
    got = sorted(tuple(r) for r in frame.transform(ns.scores).na.fill(-1).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *r[1:]) for r in plain(docs))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ns.scores(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in ns.scores(blank).collect()} == {(0, 0, 0, 0, 0)}


def test_packing():
    values = np.array([0, 1, 2**63 + 5, 2**64 - 1], dtype=np.uint64)
    assert (ns.unpack(ns.pack(values), np.uint64) == values).all() and len(ns.unpack(ns.pack(values[:0]), np.uint64)) == 0


def test_repeated_rows_spread(spark, monkeypatch):
    rows = [(None, "the same text")] * 400 + [(7, "another one here")] * 400
    frame = spark.createDataFrame(rows, "key bigint, text string").select("key", *ns.document())
    sizes = [r["count"] for r in frame.select("key", ns._block(8).alias("block")).groupBy("key", "block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 100
    monkeypatch.setattr(ns, "BLOCK_BYTES", 1500)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in ns.scores(docs).na.fill(-1).collect()) == sorted((-1 if r[0] is None else r[0], *r[1:]) for r in plain(rows))


@pytest.mark.parametrize("min_count", [1, 2])
def test_relational_form(spark, min_count):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    docs = [(i, t[:300] if t else t) for i, t in rows] + [(900, None), (901, ""), (902, "A"), (None, "the the The the"), (None, "the the The the"), (903, "x " * 5000)]
    frame = spark.createDataFrame([(a, b, 1, "q", "w") for a, b in docs], "doc_id bigint, text string, i int, gram string, d string")
    got = sorted(tuple(r) for r in ns.relational_scores(frame, min_count=min_count).na.fill(-1).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *r[1:]) for r in plain(docs, min_count))
    if min_count == 2:
        assert got == sorted(tuple(r) for r in ns.scores(frame).na.fill(-1).collect())
    assert ns.relational_scores(frame.limit(0)).count() == 0
