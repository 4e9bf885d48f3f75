"""Priority, path, queue, error class, source type and other rule columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .lookup import bare_ext, contains_any, first_case, lookup

MB = 1024 * 1024


def recency(modified: Column, as_of: Column) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(modified)
    hour = 3600 * 1_000_000
    return F.when(age < hour, 30).when(age < 24 * hour, 20).when(age < 168 * hour, 10).otherwise(0)


def clamp(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int")


def submit_priority(name: Column, ext: Column, size: Column, modified: Column, as_of: Column) -> Column:
    """Priority of a submitted file, 0 to 100."""
    score = (F.lit(50) + recency(modified, as_of) + lookup(bare_ext(ext), V.SUBMIT_WEIGHTS, 0)
             + F.when(contains_any(F.lower(name), V.SUBMIT_KEYWORDS), 15).otherwise(0))
    score = F.when((size > 50 * MB) & (score < 70), score - 10).otherwise(score)
    score = F.when(size > 500 * MB, F.greatest(score - 20, F.lit(0))).otherwise(score)
    return clamp(score)


def submit_path(ext: Column, size: Column) -> Column:
    deep = (size > 50 * MB) | (bare_ext(ext).isin(V.SUBMIT_DEEP_TYPES) & (size > 10 * MB))
    return F.when(deep, "deep").otherwise("fast")


def router_priority(name: Column, ext: Column, size: Column, modified: Column, as_of: Column) -> Column:
    """Priority of a routed file: smaller weight and keyword tables, one size rule."""
    score = (F.lit(50) + recency(modified, as_of) + lookup(bare_ext(ext), V.ROUTER_WEIGHTS, 0)
             + F.when(contains_any(F.lower(name), V.ROUTER_KEYWORDS), 15).otherwise(0))
    return clamp(F.when((size > 100 * MB) & (score < 70), score - 10).otherwise(score))


def router_path(ext: Column, size: Column, priority: Column, force_deep: Column | None = None) -> Column:
    forced = F.lit(False) if force_deep is None else force_deep
    return (F.when(forced | (size > 50 * MB), "deep").when((priority >= 70) & (size < 10 * MB), "fast")
            .when(bare_ext(ext).isin(V.ROUTER_DEEP_TYPES), "deep").otherwise("fast"))


def intake_queue(priority: Column) -> Column:
    return F.when(priority >= 75, "intake:priority").when(priority >= 40, "intake:normal").otherwise("intake:bulk")


def submit_queue(ext: Column) -> Column:
    """Queue of a submitted file."""
    return lookup(bare_ext(ext), V.SUBMIT_QUEUES, V.DEFAULT_QUEUE)


def router_queue(ext: Column) -> Column:
    """Queue of a routed file: text formats share one, others have their own, unknown ones the last."""
    plain = bare_ext(ext)
    return F.when(plain.isin(V.ROUTER_DOCUMENTS), V.DEFAULT_QUEUE).otherwise(lookup(plain, V.ROUTER_QUEUES, V.ROUTER_DEFAULT_QUEUE))


def parser(ext: Column) -> Column:
    return lookup(bare_ext(ext), V.EXTENSION_PARSERS, V.DEFAULT_PARSER)


def parser_chain(ext: Column) -> Column:
    return lookup(parser(ext), V.PARSER_CHAINS)


def format_spec(ext: Column, rules: list[tuple[str, str, str, str]] | None = None) -> Column:
    """Struct of category, processor and strategy of an extension: the last rule that lists it decides, unknown ones and null have
    the default."""
    def spec(category: str, processor: str, strategy: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(processor).alias("processor"), F.lit(strategy).alias("strategy"))

    plain = bare_ext(ext)
    listed = reversed(V.FORMAT_RULES if rules is None else rules)
    return first_case([(plain.isin(names.split()), spec(*found)) for *found, names in listed], spec(*V.DEFAULT_FORMAT))


def registered_formats(rules: list[tuple[str, str, str, str]] | None = None) -> list[str]:
    """Extensions the rules know, in their order."""
    return list(dict.fromkeys(" ".join(names for *_, names in (V.FORMAT_RULES if rules is None else rules)).split()))


def triage_status(ext: Column) -> Column:
    return F.when(F.lower(ext).isin(V.READY_EXTENSIONS), "READY_FOR_INGEST").otherwise("IGNORED")


def classify_error(message: Column) -> Column:
    """Struct of source, type and retry flag; the first pattern group that matches decides."""
    text = F.lower(F.coalesce(message, F.lit("")))

    def verdict(source: str, kind: str, retry: bool) -> Column:
        return F.struct(F.lit(source).alias("error_source"), F.lit(kind).alias("error_type"), F.lit(retry).alias("retry"))

    return first_case([(contains_any(text, words), verdict(source, kind, retry))
                       for source, kind, retry, words in V.ERROR_PATTERNS], verdict(*V.UNKNOWN_ERROR))


def retryable(message: Column) -> Column:
    return classify_error(message)["retry"]


def source_type(mime: Column, ext: Column) -> Column:
    """Source type from the MIME type, then from the extension."""
    low = F.lower(mime)
    cases = [(low.contains(n) if how == "contains" else low.startswith(n), kind) for how, n, kind in V.MIME_SOURCE_TYPES]
    by_ext = F.when(F.coalesce(ext, F.lit("")) == "", "unknown").otherwise(
        lookup(bare_ext(ext), V.EXTENSION_SOURCE_TYPES, "text_file"))
    return first_case(cases, by_ext)


def hit_type(ext: Column) -> Column:
    return lookup(bare_ext(ext), V.HIT_SOURCE_TYPES, "text")


def result_type(ext: Column) -> Column:
    return lookup(bare_ext(ext), V.RESULT_SOURCE_TYPES, "document")


def index_type(ext: Column) -> Column:
    return lookup(bare_ext(ext), V.INDEX_SOURCE_TYPES, "other")


def extractor(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return first_case([(low.contains(n), name) for n, name in V.EXTRACTORS], V.DEFAULT_EXTRACTOR)


def correction_type(predicted: Column, actual: Column, predicted_path: Column, actual_path: Column) -> Column:
    both = (F.coalesce(predicted_path, F.lit("")) != "") & (F.coalesce(actual_path, F.lit("")) != "")
    return F.when(both & (predicted != actual), "both").when(both, "path").otherwise("category")


def date_bucket(ts: Column, as_of: Column) -> Column:
    """Narrowest age bucket of a timestamp."""
    days = (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000)
    return F.when(days <= 1, "today").when(days <= 7, "7").when(days <= 30, "30").otherwise("older")


def monday_week(ts: Column) -> Column:
    """``yyyy-Www`` with weeks starting on Monday and days before the first Monday in week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def compression_ratio(packed: Column, total: Column) -> Column:
    return F.lit(1) - packed / F.greatest(F.lit(1), total)


def positional_confidence(index: Column) -> Column:
    """99 down to 70 in steps of three by zero-based position."""
    return F.least(F.lit(99), F.greatest(F.lit(70), F.lit(100) - index * 3))


def any_word(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.lower(text).contains(F.lower(w)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
