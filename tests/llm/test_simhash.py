import random
import re

import numpy as np
import pytest
import xxhash

from shelfmark.llm import simhash
from shelfmark.llm.components import components
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_classes(prints):
    """component per row by comparing all rows with all rows"""
    n = len(prints)
    least = list(range(n))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return [root(i) for i in range(n)]


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    prints = [plain_fingerprint(t) for _, t in docs]
    want = {d[0]: (f"{p:016x}", docs[c][0]) for d, p, c in zip(docs, prints, plain_classes(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, SF).collect()}
    assert got == want


def neighbours(value, rng, most=6):
    for bit in rng.sample(range(64), rng.randrange(most + 1)):
        value ^= 1 << bit
    return value


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_bit_sliced_distances(n):
    rng = random.Random(n)
    centre = rng.getrandbits(64)
    values = np.array([neighbours(centre, rng) for _ in range(n)] + [rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)
    a, b = simhash.within(values, simhash.planes_of(values), len(values))
    got = set(zip(a.tolist(), b.tolist()))
    assert got == {(i, j) for i in range(2 * n) for j in range(2 * n) if bin(int(values[i]) ^ int(values[j])).count("1") <= 4}


def test_links_of_every_key_layout_and_small_pieces(spark, monkeypatch):
    rng = random.Random(5)
    values = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        values += [neighbours(centre, rng) for _ in range(25)]
    values = sorted(set(values))
    want = plain_classes(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    for key_rows in (4096, 0):
        monkeypatch.setattr(simhash, "key_ranges", lambda n, radius, k=key_rows, f=simhash.key_ranges: f(n, radius, k))
        edges = simhash.links(frame, piece=7)
        found = {r.node % (1 << 64): r.root for r in components(edges).collect()}
        for i, v in enumerate(values):
            for j in range(i):
                together = want[i] == want[j]
                assert together == (v in found and found[v] == found.get(values[j])), (v, values[j])
        monkeypatch.undo()


def test_odd_rows(spark):
    long_text = "word " * 200_000
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n ", "z"), (None, "a b c", "q"), (4, "a b c", "q"), (4, "a b c", "q"), (5, long_text, None), (6, long_text + "tail", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("1", 1), ("2", 1), ("3", 1), ("None", 4), ("4", 4), ("4", 4), ("5", 5), ("6", 5)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    nulls = spark.createDataFrame([(None, "p q"), (None, "p q"), (None, "r s t u")], "doc_id bigint, text string")
    assert simhash.keep_one(nulls).count() == 2
