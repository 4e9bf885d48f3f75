import math
import zlib
from collections import Counter

from shelfmark.llm import language_id
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(docs[i].lang, r.lang_pred) for i, r in got.items() if r.held_out and docs[i].lang]
    assert len(held) > 200 and sum(a == b for a, b in held) >= 0.97 * len(held)


def plain_posterior(text, texts_by_lang):
    """naive Bayes as the textbook writes it, over the same buckets"""
    counts = {lang: sum((Counter(dict(enumerate(language_id.bucket_counts(t).tolist()))) for t in ts), Counter()) for lang, ts in texts_by_lang.items()}
    n_texts = sum(map(len, texts_by_lang.values()))
    logs = {}
    for lang, c in counts.items():
        total = sum(c.values()) + 0.1 * language_id.BUCKETS
        grams = language_id.bucket_counts(text)
        logs[lang] = math.log(len(texts_by_lang[lang]) / n_texts) + sum(int(grams[b]) * math.log((c[b] + 0.1) / total) for b in grams.nonzero()[0].tolist())
    top = max(logs.values())
    return max(sorted(logs), key=logs.get), 1 / sum(math.exp(v - top) for v in logs.values())


def test_textbook_bayes_and_odd_rows(spark):
    rows = [(1, "the cat of the house", "en", "a"), (2, "the dog and the hat", "en", "b"), (3, "der hund und das haus", "de", "c"), (4, None, "de", "d"), (5, "x y z", None, "e"), (None, "die katze", "de", "f")]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    model = language_id.fit(train)
    assert model.languages == ("de", "en")
    texts = ["the", "das und", "  ", None, "123 !!", "h", "the " * 400_000, "the"]
    docs = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(texts)] + [(None, "der", "q")], "doc_id bigint, text string, lang_pred string")
    got = language_id.predict(docs, model).collect()
    by = {"en": [rows[0][1], rows[1][1]], "de": [rows[2][1], rows[5][1]]}
    for r in got:
        text = "der" if r.doc_id is None else texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(text) < 100:
            lang, score = plain_posterior(text, by)
            assert r.lang_pred == lang and abs(r.score - score) < 1e-4
        else:
            assert r.lang_pred == "en"
    nothing = language_id.fit(train.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_slices_do_not_change_counts(monkeypatch):
    text = "Ein langer Text, in kurzen Stücken gezählt. " * 5
    whole = language_id.bucket_counts(text)
    monkeypatch.setattr(language_id, "SLICE", 7)
    assert (language_id.bucket_counts(text) == whole).all()
