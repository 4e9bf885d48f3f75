"""Column functions on small literal rows."""

import html
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions import chunking, headers, naming, quality, scoring, text
from shelfmark.functions.binary import file_health, file_type
from shelfmark.functions.evidence import cited_ordinals, valid_ordinals
from shelfmark.functions.matching import matching_ratio
from shelfmark.functions.pii import mask_pii
from shelfmark.functions.vectors import cosine
from shelfmark.operators import classify, gates


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_markdown_rules(spark):
    page = ("<script>x</script><h1>Title</h1><ul><li>a</li><li>b</li></ul><p>one\ntwo</p>"
            "<table><tr><th>h</th><td>c</td></tr></table>&lt;&amp;lt;&#228;&copy;&nope;")
    out = one(spark, text.html_to_markdown(F.col("h")), h=page)
    assert out.startswith("# Title\n- a\n- b\none\ntwo")
    assert "| h | c | |" in out
    assert out.endswith("<&lt;ä©&nope;")


@pytest.mark.parametrize("sample", ["plain", "a &amp; b", "&lt;p&gt; &#x41;&#66;", "x&y", "&&amp;&", "&auml;&Ouml;&euro;", "caf&eacute; &hellip;"])
def test_unescape_matches_the_standard(spark, sample):
    assert one(spark, text.unescape(F.col("s")), s=sample) == html.unescape(sample)


def test_header_round_trip(spark):
    body = "line one\nline two"
    wrapped = headers.block_header(F.col("t"), F.lit("PDF"), F.lit("a.pdf"), F.lit("Page 3"), F.lit("Finanzen"), F.lit(0.9))
    assert one(spark, wrapped, t=body) == "[SOURCE: Type: PDF | File: a.pdf | Location: Page 3 | Category: Finanzen | Confidence: 90%]\nline one\nline two\n[/SOURCE]"
    assert one(spark, headers.unwrap_text(wrapped), t=body) == body
    assert one(spark, headers.unwrap_fields(wrapped), t=body)["Location"] == "Page 3"
    assert one(spark, headers.unwrap_text(F.col("t")), t=body) == body


def test_clock(spark):
    assert one(spark, headers.clock(F.lit(59.9))) == "00:59"
    assert one(spark, headers.clock(F.lit(3661.0))) == "01:01:01"
    assert one(spark, headers.vtt_clock(F.lit(3661.25))) == "01:01:01.250"


def test_masking_is_idempotent_and_hides_iban(spark):
    raw = "Anna, DE89 3704 0044 0532 0130 00, anna@example.com, +1 (743) 555-3824, 24.12.2023"
    masked = one(spark, mask_pii(F.col("t")), t=raw)
    assert masked == "Anna, [IBAN], [EMAIL], [PHONE], [DATE]"
    assert one(spark, mask_pii(F.col("t")), t=masked) == masked


def test_smart_filename(spark):
    name = naming.smart_filename(F.lit("scan 1.PDF"), F.lit("Finanzen|Rechnung"), F.lit("Bau: haus"), F.lit("2024-12-26"))
    assert one(spark, name) == "2024-12-26_Finanzen_Bau_haus.pdf"


def test_paths(spark):
    assert one(spark, naming.translate_path(F.lit("F:\\_Inbox\\a.txt"))) == "/mnt/data/_Inbox/a.txt"
    assert one(spark, naming.translate_path(F.lit("/mnt/data/a"))) == "/mnt/data/a"
    assert one(spark, naming.category_from_path(F.lit("/x/Finanzen 2024/y"))) == "Finanzen 2024"
    assert one(spark, naming.paths_match(F.lit("D:\\X\\A.pdf"), F.lit("/other/a.pdf")))


def test_priority_bounds_and_size(spark):
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    hot = scoring.submit_priority(F.lit("Rechnung.eml"), F.lit(".eml"), F.lit(10), F.to_timestamp(F.lit("2024-01-01 11:30:00")), now)
    cold = scoring.submit_priority(F.lit("a.iso"), F.lit(".iso"), F.lit(600 * 1024 * 1024), F.to_timestamp(F.lit("2020-01-01 00:00:00")), now)
    assert one(spark, hot) == 100 and one(spark, cold) == 20


@pytest.mark.parametrize("message,source,retry", [
    ("File is EMPTY", "SOURCE_FILE", False), ("timed out", "INFRASTRUCTURE", True), ("OCR error", "PROCESSING", True),
    ("invalid header, connection refused", "SOURCE_FILE", False), ("odd", "UNKNOWN", True)])
def test_error_order(spark, message, source, retry):
    got = one(spark, scoring.classify_error(F.col("m")), m=message)
    assert (got["error_source"], got["retry"]) == (source, retry)


def test_monday_week(spark):
    import datetime
    days = [datetime.datetime(2023, 12, 25) + datetime.timedelta(days=i) for i in range(400)]
    rows = spark.createDataFrame([(d,) for d in days], "ts timestamp").select("ts", scoring.monday_week(F.col("ts")).alias("w")).collect()
    assert all(r.w == r.ts.strftime("%Y-W%W") for r in rows)


def gate_row(spark, **change):
    base = dict(category="Finanzen", content_type="application/pdf", new_filename="2024-12-26_Finanzen_Bauhaus_Gartenmaterial.pdf",
                target_folder="/archive/Finanzen", target_taken=False, confidence=0.85, text_length=80, meta_description="", is_duplicate=False, id=1)
    base.update(change)
    return gates.run_gates(spark.createDataFrame([base])).first()


@pytest.mark.parametrize("confidence,passed,warnings", [(0.85, True, 0), (0.7, True, 0), (0.69, True, 1), (0.5, True, 1), (0.49, False, 0)])
def test_confidence_gate(spark, confidence, passed, warnings):
    row = gate_row(spark, confidence=confidence)
    assert (row.passed, row.warnings) == (passed, warnings)
    if not passed:
        assert row.quarantine_folder == "_low_confidence"


def test_first_failing_gate_decides(spark):
    assert gate_row(spark, is_duplicate=True).quarantine_folder == "_duplicates"
    assert gate_row(spark, is_duplicate=True, category="Quatsch").quarantine_folder == "_review_needed"
    assert gate_row(spark, new_filename="bad:name?.pdf").passed  # an off-pattern name only warns
    assert not gate_row(spark, target_taken=True).passed


def test_classifier_order(spark):
    labels = F.array(F.lit("iban"), F.lit("email"))
    assert one(spark, classify.category(F.lit("Mein Vertrag"), labels)) == "Arbeit"
    assert one(spark, classify.category(F.lit("nichts"), labels)) == "Finanzen"
    assert one(spark, classify.category(F.lit("beim Arzt"), F.array().cast("array<string>"))) == "Gesundheit"


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, cosine(a, a)) == pytest.approx(1.0) and one(spark, cosine(a, b)) == 0.0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, cosine(a, F.array(F.lit(1.0))))


def test_chunks_keep_all_text_and_end(spark):
    body = "One. Two is longer. " + "word" * 900 + "! Last. "
    parts = one(spark, chunking.chunks(F.col("t"), budget=16, overlap=0), t=body)
    assert "".join(parts) == body
    overlapped = one(spark, chunking.chunks(F.col("t"), budget=8, overlap=4), t="Aaaa bbb. Cccc ddd. Eeee fff. Gggg hhh. ")
    assert overlapped[1].startswith("Cccc ddd. ") or overlapped[1].startswith("Aaaa bbb. ")


def test_word_error_rate(spark):
    rows = spark.createDataFrame([("a b c", "a x c"), ("", "y"), ("", "")], "r string, h string")
    got = [r[0] for r in rows.select(quality.word_error_rate("r", "h")).collect()]
    assert got == [pytest.approx(1 / 3), 1.0, 0.0]


def test_sequence_ratio(spark):
    rows = spark.createDataFrame([("Hello World", "help word")], "a string, b string")
    assert rows.select(quality.sequence_ratio("a", "b")).first()[0] == pytest.approx(SequenceMatcher(None, "hello world", "help word").ratio())


def test_matching_ratio_equals_brute_force(spark):
    """Random pairs: short ones, long ones with frequent characters, edited copies, characters of four bytes, nulls."""
    r = random.Random(3)

    def noise(size: int) -> str:
        return "".join(r.choice("abcäß😀 ") for _ in range(size))

    def edited(given: str) -> str:
        out = list(given)
        for _ in range(r.randint(0, 8)):
            at = r.randint(0, len(out))
            out[at:at + r.randint(0, 3)] = r.choice(["", "x", "ab", "😀"])
        return "".join(out)

    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(r.randint(1, 8))) for _ in range(60)]
    pairs = [(None, None), ("a", None), ("", ""), ("ab" * 150, "ab" * 150), ("a" * 300, "a" * 299)]
    for n in range(400):
        left = noise(r.choice([0, 1, 3, 8, 20, 60])) if n % 2 else " ".join(r.choice(words) for _ in range(r.randint(20, 90)))
        pairs.append((left, edited(left) if r.random() < 0.7 else noise(r.randint(0, 250))))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = dict(rows.select("i", matching_ratio("a", "b")).collect())
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(SequenceMatcher(None, a or "", b or "").ratio()), (a, b)


def test_information_loss_and_score(spark):
    loss = quality.information_loss(F.lit("12,50 am 1.2.2024 und 2024"), F.array(F.lit("12,50 EUR")), F.array().cast("array<string>"))
    assert 0 < one(spark, loss) < 1
    assert one(spark, quality.quality_score(*[F.lit(1.0)] * 2, F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(1.0)
    assert math.isinf(one(spark, quality.real_time_factor(F.lit(1.0), F.lit(0.0))))


def test_citations(spark):
    assert one(spark, cited_ordinals(F.lit("so ¹ und ³"))) == [1, 3]
    assert one(spark, valid_ordinals(F.array(*[F.lit(i) for i in (2, 0, 2, 9)]), F.lit(3))) == [2]


def test_follow_ups(spark):
    out = one(spark, text.follow_ups(F.lit("Das Projekt Bauhaus, in Berlin. Garten")))
    assert out[0] == "Wann wurde Projekt zuletzt aktualisiert?" and len(out) <= 4


@pytest.mark.parametrize("content,ext,kind,method", [
    (b"%PDF-1.7 x", "bin", "pdf", "magic"), (b"RIFF\x00\x00\x00\x00WAVEfmt ", "x", "wav", "container"), (b"RIFF\x00\x00\x00\x00ABCD", "x", "riff", "magic"),
    (b"\x00\x00\x00\x18ftypqt  ", "", "mov", "container"), (b"PK\x03\x04zz", "docx", "zip", "magic"), (b"hello", "txt", "txt", "extension"), (b"hello", "", "unknown", "unknown")])
def test_file_type(spark, content, ext, kind, method):
    row = spark.createDataFrame([(bytearray(content), ext)], "c binary, e string").select(file_type(F.col("c"), F.col("e")).alias("t")).first()["t"]
    assert (row["extension"], row["method"]) == (kind, method)


@pytest.mark.parametrize("content,ext,health,errors", [
    (b"", "pdf", "empty", ["EMPTY_FILE"]), (b"%PDF-1.4 hello %%EOF", "pdf", "healthy", []), (b"%PDF-1.4 /Encrypt %%EOF", "pdf", "corrupted", ["PDF_ENCRYPTED"]),
    (b"%PDF-1.4 cut", "pdf", "corrupted", ["PDF_TRUNCATED"]), (b"not a png at all", "png", "mislabeled", [])])
def test_file_health(spark, content, ext, health, errors):
    row = spark.createDataFrame([(bytearray(content), len(content), ext)], "c binary, n long, e string").select(
        file_health(F.col("c"), F.col("n"), F.col("e")).alias("h")).first()["h"]
    assert (row["health"], row["errors"]) == (health, errors)


def test_fixed_tables_are_consistent():
    assert len(V.SUBMIT_KEYWORDS) == 23 and len(V.ROUTER_KEYWORDS) == 7 and len(V.CATEGORIES) == 9
    assert sum(V.QUALITY_WEIGHTS.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("ext,want", [
    (".PDF", ("documents", "tika_html", "html_to_md")), ("gif", ("video_animation", "ffmpeg", "metadata")), ("ts", ("code", "parser_code", "text")),
    ("sql", ("database", "parser_database", "structure")), ("tar.gz", ("archive", "parser_archive", "listing")), ("asc", ("encrypted", "skip", "skip")),
    ("xyz", ("unknown", "strings", "binary")), ("", ("unknown", "strings", "binary")), (None, ("unknown", "strings", "binary"))])
def test_format_spec(spark, ext, want):
    rows = spark.createDataFrame([(ext,)], "e string")
    assert tuple(rows.select(scoring.format_spec(F.col("e")).alias("s")).first()["s"]) == want
