import random
import re
from itertools import combinations

from shelfmark.llm import decontaminate as dc


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c for c in low if c not in dc.PUNCTUATION)) if w]


def plain(docs, items):
    """best window per key and item, all windows at all places"""
    out = {}
    for key, text in docs:
        w = plain_words(text)
        for item, other in items:
            v = plain_words(other)
            size = min(len(v), 16)
            if size < dc.SHORTEST:
                continue
            for a in range(len(v) - size + 1):
                for at in range(a - len(v) - size, len(w) + size):
                    same = sum(0 <= at + o < len(w) and w[at + o] == v[a + o] for o in range(size))
                    if same >= -(-size * 4 // 5):
                        out[(key, item)] = max(out.get((key, item), (0, 0, 0)), (same, -at, size))
    return {(k, i, m, s, -b) for (k, i), (m, b, s) in out.items()}


def test_masks_leave_a_hit_for_every_three_substitutions():
    places = [frozenset(s + o for o in mask) for mask in dc.MASKS for s in range(16 - mask[-1])]
    assert all(any(not p & set(lost) for p in places) for lost in combinations(range(16), 3))
    for n in range(dc.SHORTEST, 16):
        run = dc.run_of(n)
        assert all(any(not set(range(s, s + run)) & set(lost) for s in range(n - run + 1)) for lost in combinations(range(n), n - dc.needed(n)))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "alpha", "beta", "gamma", "x1", "y2", "z3", "w", "v"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 16, 17, 15, 12, 10, 9, 8, 7, 6, 5, 4, 1])]
    items += [(100, None), (101, ""), (None, " ".join(f"n{i}" for i in range(20))), (0, items[0][1])]
    docs = []
    for n in range(40):
        text = [word() for _ in range(rng.randrange(25))]
        lies = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(5)):
            if lies:
                lies[rng.randrange(len(lies))] = "SUB"
        docs.append((n, " ".join(text + [w.title() + "," for w in lies] + text)))
    docs += [(200, None), (201, ""), (None, items[1][1]), (3, docs[3][1]), (202, items[0][1][: len(items[0][1]) // 2]), (203, "pad " * 30_000 + items[2][1])]
    frame = spark.createDataFrame([(a, b, 1, "q") for a, b in docs], "doc_id bigint, text string, h int, item_id string")
    bench = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id bigint, text string, words int")
    got = {tuple(r) for r in dc.leaks(frame, bench).collect()}
    small = [d for d in docs if d[0] != 203]
    assert {g for g in got if g[0] != 203} == plain(small, items)
    assert (203, 2, 16, 16, 30_000) in got
    kept = dc.clean(frame, bench)
    assert kept.columns == frame.columns
    guilty = {g[0] for g in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in guilty)
    assert dc.leaks(frame.limit(0), bench).count() == 0 and dc.leaks(frame, bench.limit(0)).count() == 0
    assert dc.clean(frame, bench.limit(0)).count() == len(docs)


def test_slices_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"{i}w{j}" for j in range(20))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, "a b " + t) for i, t in items[::2]], "doc_id bigint, text string")
    monkeypatch.setattr(dc, "SLICE_SEEDS", 200)
    assert {(r.doc_id, r.item_id, r.start) for r in dc.leaks(docs, bench).collect()} == {(i, i, 2) for i in range(0, 9, 2)}


def test_items_of_the_same_words_are_searched_once_and_slices_in_turn(spark, monkeypatch):
    """Copies of an item under other ids cost no seeds, and each slice ends before the next begins."""
    text = " ".join(f"w{j}" for j in range(20))
    bench = spark.createDataFrame([(i, text.title() if i % 2 else text) for i in range(9)] + [(50, text + " x"), (None, text)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b " + text), (2, "a b"), (None, text)], "doc_id bigint, text string")
    monkeypatch.setattr(dc, "SLICE_SEEDS", 200)
    written, write = [], dc.write_table
    monkeypatch.setattr(dc, "write_table", lambda *a, **b: written.append(1) or write(*a, **b))
    got = sorted((r.item_id is None, r.item_id or 0, r.doc_id is None, r.matched, r.start) for r in dc.leaks(docs, bench).collect())
    assert not written and got == sorted((i is None, i or 0, d, 16, 0 if d else 2) for i in [*range(9), 50, None] for d in (False, True))
    monkeypatch.setattr(dc, "SLICE_SEEDS", 100)
    assert sorted((r.item_id is None, r.item_id or 0, r.doc_id is None, r.matched, r.start) for r in dc.leaks(docs, bench).collect()) == got and len(written) == 2


def test_pieces_of_documents_give_the_same(spark, monkeypatch):
    """Passages that lie across two pieces, at the ends of a text or in a text shorter than a piece."""
    monkeypatch.setattr(dc, "PIECE", 7)
    test_equals_brute_force(spark)


def test_a_long_document_of_nothing_but_hits(spark):
    """Hits carry the words around them alone; whole documents at each of 75,000 hits would be 18 GB."""
    item = " ".join(f"w{j}" for j in range(30))
    docs = spark.createDataFrame([(1, f"{item} " * 1000)], "doc_id bigint, text string")
    assert [tuple(r) for r in dc.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()] == [(1, 7, 16, 16, 0)]


def test_twin_and_operator_agree_on_short_items(spark):
    import duckdb

    from shelfmark.llm import decontaminate
    from shelfmark.llm.queries import ORACLES

    items = [(1, "one two three four five"), (2, "alpha beta gamma delta"), (3, "a b c d e f"), (4, "red green blue black white grey")]
    texts = ["x one two NINE four five y", "one two three four", "one two three four FIVE!", "one x three x five", "alpha beta gamma delta", "a b c d x f", "a x c d x f",
             "one two three x five", "red green x black white grey", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    names = [d[0] for d in con.execute(ORACLES["op4_decontaminate"]).description]
    rows = [dict(zip(names, r)) for r in con.execute(ORACLES["op4_decontaminate"]).fetchall()]
    assert got == {(r["doc_id"], r["item_id"], r["matched"]) for r in rows} and {(0, 1, 4), (2, 1, 5), (7, 1, 4)} <= got
