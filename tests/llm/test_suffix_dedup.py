import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import suffix_dedup
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    """(removed bytes, runs, kept) per text, from a dictionary of all strings of that length"""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, x in zip(t, gone) if not x)))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (len(t), n, runs, hashlib.sha256(kept).hexdigest()) for (d, t), (n, runs, kept) in zip(docs, plain([t for _, t in docs], 200))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op11_suffix_dedup"](spark, SF).collect()}
    assert got == want and any(v[1] for v in want.values())


def corpus(seed, letters):
    """short texts with planted passages, near the length and beyond, some of them with letters before and behind that also agree"""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    planted = [make(rng.randrange(10, 60)) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(planted)
            a = rng.randrange(len(p) // 2)
            parts += [make(rng.randrange(30)), p[a:a + rng.randrange(8, 60)]]
        texts.append("".join([*parts, make(rng.randrange(40))]))
    return [*texts, *texts[:3], None, "", "a", "\0" * 50, "\0" * 13, "ab" * 40, "abc" * 9, "é" * 30]


@pytest.mark.parametrize("seed,letters,length,bucket", [(1, "abcdefghijklmnop", 14, 1 << 20), (2, "ab", 14, 1 << 20), (3, "abcdefgh", 14, 300), (4, "ab", 12, 200),
                                                        (5, "abcdefghijklmnop", 21, 400), (6, "abcdef", 13, 100), (7, "abc\0", 9, 150), (8, "ab", 20, 250)])
def test_planted_passages(spark, monkeypatch, seed, letters, length, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)  # small buckets: most groups cross boundaries
    texts = corpus(seed, letters)
    docs = spark.createDataFrame([(n, t, "clash", n) for n, t in enumerate(texts)], "id int, text string, row string, t1 int")
    got = {r.row.id: (sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in suffix_dedup.without_repeats(docs, ["id"], length=length).collect()}
    want = dict(enumerate(plain([(t or "").encode() for t in texts], length)))
    assert got == want and sum(v[0] for v in want.values())


def test_one_long_text_and_empty_table(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    texts = [long + "x" * 1000 + long[1000:1300], "y" * 1500, long[5000:5200], long[7000:7199]]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r.row.doc_id: [(s.start, s.end) for s in r.removed] for r in suffix_dedup.without_repeats(docs, ["doc_id"]).collect()}
    assert got == {0: [(1000, 1300), (5000, 5200), (300_000, 301_300)], 1: [(0, 1500)], 2: [(0, 200)], 3: []}
    assert suffix_dedup.without_repeats(docs.limit(0), ["doc_id"]).count() == 0


def test_multikey_quicksort():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(25))) for _ in range(500)]
    rows, sizes = suffix_dedup._padded(strings, 25)
    order = suffix_dedup.multikey_order(rows, sizes)
    assert [strings[i] for i in order] == sorted(strings)
    common = suffix_dedup._common(rows, sizes, order)
    ordered = sorted(strings)
    assert list(common[1:]) == [suffix_dedup._shared(a, b) for a, b in zip(ordered, ordered[1:])]


def test_anchors_of_equal_strings_lie_alike():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 101, 40).astype(np.uint8)
    data = np.concatenate((rng.integers(97, 101, 33).astype(np.uint8), passage, rng.integers(97, 101, 11).astype(np.uint8), passage))
    found = set(suffix_dedup.anchors(data, np.array([len(data)]), 20)[0].tolist())
    inner = range(14, 21)  # places that any 20 bytes within the passage choose are the same in both copies
    assert {p - 33 for p in found if p - 33 in inner} == {p - 84 for p in found if p - 84 in inner}
    for start in range(len(data) - 19):
        assert any(start <= p < start + 15 for p in found)
