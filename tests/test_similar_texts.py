"""Similar texts against all pairs."""

import itertools
import random

import pytest

from shelfmark.operators import similar_texts


@pytest.fixture(scope="module")
def rows():
    """A large group of near copies, small groups, texts that share a passage only, short, blank, equal and null texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, texts = [word() for _ in range(30)], []

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = word()
        return words

    for copies, size, edits in ((25, 120, 3), (4, 60, 1), (3, 300, 8), (2, 12, 1)):
        base = [word() for _ in range(size)]
        texts += [edited(base, rng.randrange(edits + 1)) for _ in range(copies)]
    base = [word() for _ in range(100)]
    texts += [base[:k] for k in (100, 90, 85, 83, 80, 70)]
    texts += [[word() for _ in range(150)] + passage for _ in range(30)]
    texts += [["a"], ["a", "b"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"], ["x"] * 40, ["x"] * 50, []]
    texts = [" ".join(t) for t in texts] + ["a  b", " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts + texts[:10] + [None, None]))


def wanted(rows, above):
    sets = {}
    for i, t in rows:
        if t is not None and t not in (u for u, _ in sets.values()):
            w = t.split()
            sets[i] = t, {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    scores = {(a, b): len(x & y) / len(x | y) for (a, (_, x)), (b, (_, y)) in itertools.combinations(sets.items(), 2) if x and y}
    return {p: round(s, 9) for p, s in scores.items() if s >= above - 1e-9}


@pytest.mark.parametrize(("above", "limits"), [(0.8, {}), (0.8, {"PIECE_TEXTS": 4, "SENT_IDS": 0}), (0.3, {"PIECE_SHINGLES": 500})])
def test_similar_texts_are_all_pairs(spark, rows, monkeypatch, above, limits):
    for name, value in limits.items():
        monkeypatch.setattr(similar_texts, name, value)
    pairs, copies = similar_texts.similar_texts(spark.createDataFrame(rows, "id long, text string"), above)
    found = [((r.id_a, r.id_b), round(r.jaccard, 9)) for r in pairs.collect()]
    assert len(found) == len(dict(found)) and dict(found) == wanted(rows, above)
    least = {}
    for i, t in rows:
        least.setdefault(t, i)
    assert {(r.id, r.representative) for r in copies.collect()} == {(i, least[t]) for i, t in rows if t is not None and least[t] != i}


def test_whole_sets_are_kept_of_texts_with_a_similar_one_only(spark, rows, monkeypatch):
    """Texts that are unlike all others, or share no more than a passage with them, do not get their shingles stored and shuffled."""
    stored = []

    def store(df, cut=similar_texts.cut_lineage):
        stored.append(cut(df))
        return stored[-1]

    monkeypatch.setattr(similar_texts, "cut_lineage", store)
    pairs, _ = similar_texts.similar_texts(spark.createDataFrame(rows, "id long, text string"))
    similar = {i for p in pairs.collect() for i in (p.id_a, p.id_b)}
    kept = {r.id for t in stored if "s" in t.columns for r in t.select("id").collect()}
    assert similar <= kept and len(kept) < len(similar) + 12  # of 74 different texts
