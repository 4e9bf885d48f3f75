"""Personal data: spans and masks. Masking fails closed: a null result never falls back to raw text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V


def pii_counts(text: Column) -> Column:
    """Struct with the number of matches of each label, counted on what earlier labels left over."""
    fields, rest = [], text
    for label, pattern in V.PII_PATTERNS:
        fields.append(F.regexp_count(rest, F.lit(pattern)).cast("bigint").alias(label.lower()))
        rest = F.regexp_replace(rest, pattern, f"[{label}]")
    return F.struct(*fields)


def pii_values(text: Column, label: str) -> Column:
    """All matches of one label."""
    return F.regexp_extract_all(text, F.lit(dict(V.PII_PATTERNS)[label]), F.lit(0))


def mask_pii(text: Column) -> Column:
    """Every match replaced by its bracketed label."""
    for label, pattern in V.PII_PATTERNS:
        text = F.regexp_replace(text, pattern, f"[{label}]")
    return text
