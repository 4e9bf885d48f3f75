"""The pipeline against plain Python, and each stage's contract."""

import sentencepiece

import corpus_pipeline
from shelfmark.llm import decontaminate as dc
from shelfmark.llm import quality_rules as qr
from shelfmark.llm.queries import MODEL
from tests.llm.test_decontaminate import plain_words
from tests.llm.test_line_runs import plain as plain_lines
from tests.llm.test_quality_rules import plain as plain_measures
from tests.llm.test_simhash import plain_classes, plain_fingerprint

SF = "/root/testdata/sf0.001"


def leaks(text, items):
    words = plain_words(text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    for other in items:
        size = min(16, len(other))
        for diagonal in {i - j for j in range(len(other) - 2) for i in at.get(tuple(other[j:j + 3]), [])}:
            for a in range(len(other) - size + 1):
                same = sum(0 <= diagonal + a + o < len(words) and words[diagonal + a + o] == other[a + o] for o in range(size))
                if same >= dc.needed(size):
                    return True
    return False


def plain_pipeline(docs, items):
    names = dict(n_words=0, word_chars=1, n_symbols=2, n_lines=3, n_dup_lines=4, n_repeat_words=5)
    kept = []
    for d in docs:
        m = plain_measures(d[1])
        if not any(eval(r.fails, {k: m[i] for k, i in names.items()}) for r in qr.RULES):
            kept.append(d)
    new = plain_lines(kept, 20)
    lined = [(d[0], new[d]) for d in kept if new[d] == d[1] or new[d].split()]
    classes = plain_classes([plain_fingerprint(t) for _, t in lined])
    single = [d for i, d in enumerate(lined) if classes[i] == i]
    left = [d for d in single if not leaks(d[1], items)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return {d[0]: model.encode(d[1]) for d in left}


def test_run_equals_plain_python(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    items = [plain_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == plain_pipeline(docs, items)
    assert 0 < len(got) < len(docs)


def test_stages_keep_columns_and_bear_odd_tables(spark):
    rows = [(1, None, None, "s", 0, "x"), (2, "", "en", None, None, None), (None, "a clean line of ten words and then some more of them", "en", "s", 3, "y"),
            (3, "word " * 50, "en", "s", 250, "z"), (4, "a clean line of ten words and then some more of them", "en", "s", 51, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, gone string")
    for frame in (docs, docs.limit(0), docs.drop("n_chars")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns, name
            assert out.dtypes == frame.dtypes, name
            assert out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encoding"]
