"""Evidence arrays, citation markers and claims."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V


def merge_evidence(existing: Column, incoming: Column) -> Column:
    """Both arrays in order, without nulls and repeats."""
    empty = F.array().cast("array<struct<page:int,totalPages:int,bbox:array<double>,timestampStart:double,timestampEnd:double>>")
    joined = F.concat(F.coalesce(existing, empty), F.coalesce(incoming, empty))
    return F.array_distinct(F.filter(joined, lambda e: e.isNotNull()))


def evidence_from_metadata(page: Column, pages: Column, bbox: Column, start: Column, end: Column) -> Column:
    """One-element evidence array, or an empty one when no field is known; boxes need four numbers."""
    box = F.when(F.size(bbox) == 4, bbox.cast("array<double>"))
    entry = F.struct(
        page.cast("int").alias("page"), pages.cast("int").alias("totalPages"), box.alias("bbox"),
        start.cast("double").alias("timestampStart"), end.cast("double").alias("timestampEnd"))
    known = F.coalesce(page.cast("string"), pages.cast("string"), box.cast("string"), start.cast("string"), end.cast("string"))
    return F.when(known.isNotNull(), F.array(entry)).otherwise(F.slice(F.array(entry), 1, 0))


def cited_ordinals(answer: Column) -> Column:
    """Source numbers whose superscript marker occurs in the answer."""
    marks = F.array(*[F.lit(mark) for mark in V.SUPERSCRIPTS])
    return F.filter(F.sequence(F.lit(1), F.lit(len(V.SUPERSCRIPTS))), lambda i: answer.contains(F.get(marks, i - 1)))


def valid_ordinals(ids: Column, sources: Column) -> Column:
    """Distinct ordinals between 1 and the number of sources, in order."""
    return F.array_distinct(F.filter(ids, lambda i: (i > 0) & (i <= sources)))
