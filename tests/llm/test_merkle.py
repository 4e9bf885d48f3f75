import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import merkle
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, width=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + width]) for i in range(0, len(out[-1]), width)])
    return out


def plain(rows, found_of, width=16):
    """(key, leaf, subroot, root, proof, folded) of rows (key, group, values), one leaf after the other"""
    groups = {}
    for key, group, values in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, digest(*map(coded, values)), key, digest(*map(coded, found_of(key, values)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3] + x[4:]),) for g in order}
    trees = {g: (ls, levels([x[2] for x in ls], width)) for g, (ls,) in trees.items()}
    top = levels([t[-1][0] for _, t in trees.values()], width)
    out = []
    for number, g in enumerate(order):
        leaves, tree = trees[g]
        for i, (*_, key, found) in enumerate(leaves):
            folded, proof, at = found, [], i
            for nodes, place in [(n, i // width ** k) for k, n in enumerate(tree[:-1])] + [(n, number // width ** k) for k, n in enumerate(top[:-1])]:
                run = nodes[place - place % width:][:width]
                proof += [x for j, x in enumerate(run) if j != place % width]
                folded = digest(*(folded if j == place % width else x for j, x in enumerate(run)))
            out.append((key, leaves[i][2], tree[-1][0], top[-1][0], digest(*proof), folded))
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def found(key, values):
        return [*values[:4], values[4].translate(lower)] if values[4] and zlib.crc32(str(key).encode()) % 5 == 0 else values

    want = sorted(plain([(r.doc_id, r.source, [r.doc_id, r.source, r.lang, r.n_chars, r.text]) for r in docs], found))
    rows = QUERIES["op12_merkle_manifest"](spark, SF).collect()
    assert sorted(tuple(r)[:6] for r in rows) == want
    assert all(r.verified == (r.folded_root == r.root) for r in rows) and len({r.verified for r in rows}) == 2


@pytest.mark.parametrize("sizes", [[1], [5], [16], [17], [1, 1], [1, 300], [257, 1, 16, 33], [3] * 20, [1] * 18, [2000, 1, 40]])
def test_shapes(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_A_COPY", 3)  # runs near the root lie in several copies
    rng = random.Random(1)
    rows = [(k if rng.random() > 0.1 else None, None if not g else f"g{g:02}é", rng.choice([None, "", "Text", "x" * 50])) for g, n in enumerate(sizes) for k in range(n)]
    rows += rows[:1] if len(rows) > 1 else []
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "a int, b string, c string, leaf string, pos int")
    values = [F.col("a"), F.col("b"), F.col("c")]
    manifest = merkle.build(frame, F.col("a"), F.col("b"), values, [*values[:2], F.lower("c")])
    got = [tuple(r) for r in merkle.climb(manifest).collect()]
    want = plain([(a, b, [a, b, c]) for a, b, c in rows], lambda k, v: [*v[:2], v[2] and v[2].lower()])
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert {r[5] == r[3] for r in got} <= {True, False}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "a int, b string")
    manifest = merkle.build(frame, F.col("a"), F.col("b"), [F.col("a"), F.col("b")])
    assert manifest.root is None and merkle.climb(manifest).count() == 0
