import random
import re

from shelfmark.llm import licenses
from shelfmark.llm.license_texts import TEMPLATES


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[^0-9a-z\x80-\U0010FFFF]+", low) if w]
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def plain(docs, templates):
    """containment in every window of every class size"""
    out = {}
    for key, text in docs:
        own = shingles(text)
        for name, other in templates:
            want = set(shingles(other))
            if not want:
                continue
            c = 1
            while c < len(want):
                c *= 2
            for start in range(0, max(1, len(own)), c):
                part = own[start:start + 2 * c]
                same = set(part) & want
                if len(same) >= 0.8 * len(want):
                    first = start + min(i for i, s in enumerate(part) if s in want)
                    out[(key, name)] = max(out.get((key, name), (0, 0)), (len(same) / len(want), -first))
    return {(k, n, v, -b) for (k, n), (v, b) in out.items()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    templates = list(TEMPLATES.items()) + [("tiny", "two words"), ("none", None), (None, "no name for these words"), ("twice", "a b c d e f g a b c d e f g h"), ("same", "a b c d e f g a b c d e f g h")]
    docs = []
    for n in range(60):
        words = rng.choice([t for _, t in templates if t]).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["X", "the", "license"])
        lead = ["pad"] * rng.randrange(70)
        docs.append((n, " ".join(lead + words + lead + rng.choice(["", TEMPLATES["mit-short"]]).split())))
    docs += [(100, None), (101, ""), (None, TEMPLATES["isc"]), (1, docs[1][1]), (102, TEMPLATES["mit-permission"].upper().replace(" ", "\n*  ")), (103, "w " * 40_000 + TEMPLATES["gpl-header"])]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id bigint, text string, license string, c int")
    got = {tuple(r) for r in licenses.scan(frame, spark.createDataFrame(templates, "license string, text string")).collect()}
    assert got == plain(docs, [t for t in templates if t[0]])
    assert (103, "gpl-header", 1.0, 40_000) in got
    assert licenses.scan(frame.limit(0)).count() == 0
    assert licenses.scan(frame, spark.createDataFrame([], "license string, text string")).count() == 0
    nothing = spark.createDataFrame([(1, "no licence in here at all")], "doc_id bigint, text string")
    assert licenses.scan(nothing).count() == 0
