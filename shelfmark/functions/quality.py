"""Extraction quality columns: error rates, grounding, loss, preservation, weighted score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .matching import matching_ratio
from .text import code_point, number_set, word_set


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the length of the reference."""
    empty = F.when(F.length(hypothesis) > 0, 1.0).otherwise(0.0)
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def word_error_rate_by_chars(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of the space-normalised texts over the reference length, at most 1."""
    r, h = squeeze(reference), squeeze(hypothesis)
    empty = F.when(F.length(h) > 0, 1.0).otherwise(0.0)
    return F.when(F.length(r) == 0, empty).otherwise(F.least(F.lit(1.0), F.levenshtein(r, h) / F.length(r)))


#: First of the code points that stand for words; 983,040 follow, one for each distinct word of a pair.
WORD_MARKS = 0x20000


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word-level edit distance over the number of reference words. Each distinct word of the pair becomes one character, so
    that the built-in edit distance of texts counts words."""
    def words(text: Column) -> Column:
        return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def rate(pair: Column) -> Column:
        def marked(side: Column) -> Column:
            return F.array_join(F.transform(side, lambda w: code_point(F.array_position(pair["known"], w) + WORD_MARKS)), "")

        size = F.size(pair["r"])
        empty = F.when(F.size(pair["h"]) > 0, 1.0).otherwise(0.0)
        return F.when(size == 0, empty).otherwise(F.levenshtein(marked(pair["r"]), marked(pair["h"])) / size)

    r, h = words(_column(reference)), words(_column(hypothesis))
    pair = F.struct(r.alias("r"), h.alias("h"), F.array_distinct(F.concat(r, h)).alias("known"))
    return F.get(F.transform(F.array(pair), rate), 0)  # the lambda holds the words, so they are split once


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sequence_ratio(left: Column | str, right: Column | str) -> Column:
    """Matching-block similarity of two strings, case-insensitive; null counts as empty."""
    return matching_ratio(F.lower(_column(left)), F.lower(_column(right)))


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both == 0, 0.0).otherwise(2 * precision * recall / both)


def real_time_factor(processing: Column, duration: Column) -> Column:
    return F.when(duration == 0, F.lit(float("inf"))).otherwise(processing / duration)


def grounding_rate(entities: Column, text: Column, name: Column) -> Column:
    """Share of entities found whole, or by any of their words, in text or name; 1 for none."""
    body = F.lower(F.concat(text, F.lit(" "), name))
    found = F.filter(entities, lambda e: body.contains(F.lower(e)) | F.exists(
        F.filter(F.split(F.lower(e), r"\s+"), lambda w: w != ""), lambda w: body.contains(w)))
    return F.when(F.size(entities) == 0, 1.0).otherwise(F.size(found) / F.size(entities))


def hallucination_score(facts: Column, amounts: Column, text: Column, name: Column) -> Column:
    """Ungrounded claims over all claims: facts by their words, amounts by each number in them."""
    body = F.lower(F.concat(text, F.lit(" "), name))

    def ungrounded(fact: Column) -> Column:
        words = F.regexp_extract_all(F.lower(fact), F.lit(V.WORD + "{4,}"), F.lit(0))
        return F.size(F.filter(words, lambda w: body.contains(w))) < F.size(words) * F.lit(0.3).cast("double")

    numbers = F.flatten(F.transform(amounts, lambda a: F.regexp_extract_all(a, F.lit("[0-9.,]+"), F.lit(0))))
    bad = F.size(F.filter(facts, ungrounded)) + F.size(F.filter(numbers, lambda n: ~body.contains(n)))
    total = F.size(facts) + F.size(amounts)
    return F.when(total == 0, 0.0).otherwise(bad / total)


DOCUMENT_EXTENSIONS = [".pdf", ".docx", ".doc", ".xlsx", ".txt", ".md", ".html"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".tiff", ".gif"]


def completeness(text: Column, metadata: Column, ext: Column) -> Column:
    """Struct of the share of passed checks and the names of the failed ones."""
    keys = F.map_keys(metadata)
    image_data = F.exists(F.map_entries(metadata), lambda e: e["key"].contains("Image") | e["value"].contains("Image"))
    def check(name: str, used: Column, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), used.alias("used"), ok.alias("ok"))

    always = F.lit(True)
    checks = F.array(
        check("text_extracted", always, F.length(text) > 50),
        check("has_metadata", always, F.size(keys) > 0),
        check("readable_content", always, text.rlike("[a-zA-Z]{3,}")),
        check("substantial_text", F.lower(ext).isin(DOCUMENT_EXTENSIONS), F.length(text) > 200),
        check("image_metadata", F.lower(ext).isin(IMAGE_EXTENSIONS), image_data | (F.size(keys) > 2)))
    used = F.filter(checks, lambda c: c["used"])
    failed = F.filter(used, lambda c: ~c["ok"])
    return F.struct(
        ((F.size(used) - F.size(failed)) / F.size(used)).alias("score"),
        F.transform(failed, lambda c: c["check"]).alias("missing"))


def information_loss(text: Column, amounts: Column, dates: Column) -> Column:
    """Share of the original numbers and dates that the extraction lost, between 0 and 1."""
    original_dates = F.array_distinct(F.regexp_extract_all(text, F.lit(V.LOST_DATE_PATTERN), F.lit(0)))
    kept_numbers = F.array_distinct(F.flatten(F.transform(amounts, number_set)))
    total = F.size(number_set(text)) + F.size(original_dates)
    kept = F.size(kept_numbers) + F.size(F.array_distinct(dates))
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - kept / total)))


def lost_numbers(text: Column, amounts: Column) -> Column:
    """Numbers of the original that no extracted amount holds."""
    return F.array_except(number_set(text), F.flatten(F.transform(amounts, number_set)))


def key_terms_preserved(text: Column, summary: Column) -> Column:
    """Shared words over at most twenty original words, at most 1."""
    words = word_set(text)
    share = F.size(F.array_intersect(words, word_set(summary))) / F.least(F.size(words), F.lit(20))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.lit(1.0), share))


def quality_score(extraction: Column, grounding: Column, hallucination: Column, loss: Column, semantic: Column) -> Column:
    """Weighted sum; hallucination and loss count inverted."""
    w = V.QUALITY_WEIGHTS
    return (extraction * w["extraction"] + grounding * w["grounding"] + (1 - hallucination) * w["hallucination"]
            + (1 - loss) * w["info_loss"] + semantic * w["semantic"])


def keyword_ratio(text: Column, keywords: Column) -> Column:
    """Struct of found count, total, ratio and the missing keywords (case-insensitive)."""
    missing = F.filter(keywords, lambda k: ~F.lower(text).contains(F.lower(k)))
    total = F.size(keywords)
    found = total - F.size(missing)
    return F.struct(found.alias("found"), total.alias("total"),
                    F.when(total == 0, 0.0).otherwise(found / total).alias("ratio"), missing.alias("missing"))
