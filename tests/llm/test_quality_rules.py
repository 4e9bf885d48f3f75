import random
import re

from shelfmark.llm import quality_rules as qr


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), dup, len(covered)


def test_measures_equal_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice(["a", "b", "é𝄞", " ", "\n", "\t", "#", "<", "\x0b", "\x1c", "\x85", " word "]) for _ in range(rng.randrange(60)))) for i in range(200)]
    docs += [(300, None), (301, ""), (None, "x " * 12), (0, docs[0][1]), (302, "long " * 100_000)]
    frame = spark.createDataFrame([(a, b, 1, False) for a, b in docs], "doc_id bigint, text string, n_words int, kept boolean")
    got = qr.ledger(frame).collect()
    key = lambda r: str((r[0], *r[1:]))
    small = [d for d in docs if d[0] != 302]
    assert sorted((key((r.doc_id, *(r[m] for m in qr.MEASURES))) for r in got if r.doc_id != 302)) == sorted(key((a, *plain(b))) for a, b in small)
    long = next(r for r in got if r.doc_id == 302)
    assert (long.n_words, long.n_repeat_words) == (100_000, 100_000)
    for r in got:
        want = sum(1 << rule.bit for rule in qr.RULES if eval(rule.fails, {m: r[m] for m in qr.MEASURES}))
        assert r.failed_bits == want
    kept = qr.keep(frame)
    assert kept.columns == frame.columns
    mask = qr.mask_of(qr.POLICIES[-1])
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.failed_bits & mask)
    assert qr.ledger(frame.limit(0)).count() == 0 and qr.keep(frame.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    rules = (qr.Rule("a", 0, "x > 0"), qr.Rule("b", 1, "y > 0"), qr.Rule("c", 5, "z > 0"))
    rows = spark.createDataFrame([(b,) for b in [0, 0, 1, 1, 2, 3, 33, 32, 35]], "failed_bits bigint")
    policy = qr.Policy("v", ("a", "c"))
    assert qr.mask_of(policy, rules) == 33
    applied = qr.apply_policies(rows, (policy, qr.Policy("none", ())), rules).collect()
    assert [r.kept_v for r in applied] == [r.failed_bits & 33 == 0 for r in applied] and all(r.kept_none for r in applied)
    found = {r.rule: (r.n_failed, r.n_only_this_rule, r.n_rows) for r in qr.ablations(rows, policy, rules).collect()}
    assert found == {"a": (5, 3, 9), "c": (3, 1, 9)}
