import random

import pytest

from shelfmark.llm import line_runs


def plain(docs, min_words):
    """Longest earlier match of every suffix by comparing all pairs; runs that share a line together, those long enough gone."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    places = []
    for at, (_, text) in enumerate(order):
        seq = [(i, x) for i, x in enumerate(text.split("\n")) if x.split()] if text is not None else []
        places += [(at, p, seq) for p in range(len(seq))]
    runs = {at: [] for at in range(len(order))}
    for n, (at, p, seq) in enumerate(places):
        best = 0
        for _, q, other in places[:n]:
            size = 0
            while p + size < len(seq) and q + size < len(other) and seq[p + size][1] == other[q + size][1]:
                size += 1
            best = max(best, size)
        if best:
            if runs[at] and p < runs[at][-1][1]:
                runs[at][-1][1] = max(runs[at][-1][1], p + best)
            else:
                runs[at].append([p, p + best, seq])
    out = {}
    for at, d in enumerate(order):
        gone = {seq[i][0] for a, b, seq in runs[at] if sum(len(x.split()) for _, x in seq[a:b]) >= min_words for i in range(a, b)}
        out[d] = None if d[1] is None else "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone)
    return out


def check(spark, docs, min_words, seed):
    got = line_runs.without_later_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), min_words=min_words).collect()
    want = plain(docs, min_words)
    assert len(got) == len(docs)
    for r in got:
        assert r.text == want[(r.row.doc_id, r.row.text)], (seed, r.row.doc_id, r.row.text)


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(25):
        lines = [" ".join(rng.choice("ab") for _ in range(rng.randrange(3))) for _ in range(rng.randrange(30))]
        docs.append((i, "\n".join(lines)))
    base = docs[0][1] + "\nq\nr\ns\nt"
    docs += [(100 + k, base + f"\n{k}\n" + base) for k in range(3)]
    check(spark, docs, 3 + 2 * seed, seed)


def test_odd_rows(spark):
    run = "one two\nthree four five\n\nsix"
    docs = [(3, run), (1, run + "\nown"), (3, run), (None, run), (4, None), (None, None), (5, ""), (6, "\n\n"), (7, "x\n" * 40), (8, " \t\nsix")]
    check(spark, docs, 5, "odd")
    frame = spark.createDataFrame([(2, "a", "k", 1), (1, "a", "k", 2)], "doc_id bigint, text string, gone string, rank int")
    rows = line_runs.without_later_copies(frame, min_words=1).collect()
    assert sorted((r.row.doc_id, r.text, r.n_deleted, r.row.gone) for r in rows) == [(1, "a", 0, "k"), (2, "", 1, "k")]
    assert line_runs.without_later_copies(frame.limit(0)).count() == 0
    unique = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id bigint, text string")
    assert {r.n_deleted for r in line_runs.without_later_copies(unique).collect()} == {0}


def test_long_runs(spark):
    body = "\n".join(f"line number {i} of the long text" for i in range(700))
    docs = [(1, body), (2, "head\n" + body), (3, body.replace("number 300 ", "number x "))]
    got = {r.row.doc_id: r.text for r in line_runs.without_later_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: body, 2: "head", 3: "line number x of the long text"}
