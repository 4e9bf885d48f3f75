"""Search results: source records, facets, context, citations, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import valid_ordinals
from ..functions.lookup import parent_dir, suffix
from ..functions.scoring import (date_bucket, extractor, hit_type, index_type, positional_confidence, result_type)
from ..functions.headers import block_header
from ..functions.text import snippet
from .grouping import concat_ordered, top_k_per


def faceted(results: DataFrame, as_of: Column, types: list[str] = (), folders: list[str] = (), tags: list[str] = (),
            match_all_tags: bool = False, buckets: list[str] = ()) -> DataFrame:
    """Results that meet every facet in use: type, folder, tags (any or all), age bucket. ``older``
    is more than thirty days; the other buckets are upper limits, as wider ones hold narrower ones."""
    keep = F.lit(True)
    if types:
        keep &= F.col("extension").isin(list(types))
    if folders:
        keep &= F.col("folder").isin(list(folders))
    if tags:
        wanted = F.array(*[F.lit(tag) for tag in tags])
        keep &= (F.size(F.array_except(wanted, "tags")) == 0) if match_all_tags else F.arrays_overlap("tags", wanted)
    if buckets:
        order = ["today", "7", "30"]
        allowed = {b for wanted in buckets for b in (order[: order.index(wanted) + 1] if wanted in order else ["older"])}
        keep &= date_bucket(F.col("uploaded_at"), as_of).isin(sorted(allowed))
    return results.filter(keep)


def facet_values(results: DataFrame) -> DataFrame:
    """Distinct types, folders and tags."""
    def values(name: str, column: Column) -> DataFrame:
        return results.select(F.lit(name).alias("facet"), column.alias("value")).filter("value IS NOT NULL AND value <> ''").distinct()

    return (values("type", F.col("extension")).unionByName(values("folder", F.col("folder")))
            .unionByName(values("tag", F.explode("tags"))).orderBy("facet", "value"))


def of_source_types(results: DataFrame, wanted: list[str], order: list[Column], limit: int) -> DataFrame:
    """First results of the wanted source types; the filter comes before the limit."""
    typed = results.withColumn("source_type", result_type(F.col("extension")))
    return typed.filter(F.col("source_type").isin(wanted)).orderBy(*order).limit(limit)


def source_records(hits: DataFrame) -> DataFrame:
    """Hits with position, payload fields and their older names turned into uniform source records."""
    name = F.coalesce("filename", "title", F.concat(F.lit("Document "), (F.col("position") + 1).cast("string")))
    path = F.coalesce("path", "file_path", F.lit(""))
    kind = hit_type(F.coalesce("extension", suffix(name)))
    return hits.select(
        "id", kind.alias("type"), name.alias("filename"), path.alias("path"),
        F.when(path != "", parent_dir(path)).alias("folder"), F.coalesce("extension", suffix(name)).alias("file_extension"),
        F.coalesce(F.col("confidence"), positional_confidence(F.col("position")).cast("double")).alias("confidence"),
        F.substring(F.coalesce("content", "text", F.lit("")), 1, 500).alias("excerpt"),
        F.when(kind == "pdf", F.coalesce("page", "page_number")).alias("page"),
        F.when(kind == "audio", F.coalesce("timestamp", "start_time")).alias("timestamp"),
        extractor(F.coalesce("extractor", "extracted_via")).alias("extracted_via"))


def index_rows(files: DataFrame, created: str = "ingested_at") -> DataFrame:
    """Projection written to an index: epoch seconds, calendar parts, flat entities, source type, header."""
    flat = F.array_join(F.flatten(F.map_values("entities")), " ")
    headed = block_header(F.col("extracted_text"), index_type(F.col("extension")), F.col("original_filename"),
                          F.lit(None).cast("string"), F.col("category"), F.col("confidence"))
    return files.select(
        "id", F.unix_timestamp(created).alias("file_created_timestamp"), F.year(created).alias("year_created"),
        F.month(created).alias("month_created"), F.weekday(created).alias("weekday_created"), F.hour(created).alias("hour_created"),
        flat.alias("entities_flat"), index_type(F.col("extension")).alias("source_type"), headed.alias("extracted_text"))


def merge_by_url(results: DataFrame, url: str = "url", position: str = "position", content: str = "content") -> DataFrame:
    """One row per URL at its first position, later contents appended after a blank line; rows without
    URL pass through. ``group_rows`` counts the results behind a row."""
    with_url = results.filter(F.coalesce(F.col(url), F.lit("")) != "")
    first = with_url.groupBy(url).agg(F.min(position).alias("first_position"))
    merged = concat_ordered(with_url, [url], [position], {content: (content, "\n\n")}).join(first, url)
    alone = results.filter(F.coalesce(F.col(url), F.lit("")) == "").select(
        url, F.lit(1).cast("bigint").alias("group_rows"), content, F.col(position).alias("first_position"))
    return merged.unionByName(alone)


def evidence_by_url(results: DataFrame, url: str = "url", position: str = "position", evidence: str = "evidence") -> DataFrame:
    """Evidence of merged results: the distinct entries of all results of a URL, each with the place it was first seen at (url, entry,
    first_position, first_index; reading a URL's rows in that order gives the union). One row per entry, so a URL may have any number.
    A result without URL stands alone and keeps its own entries; null entries and null arrays give no row."""
    own = F.when(F.coalesce(F.col(url), F.lit("")) == "", F.col(position))
    entries = results.select(F.nullif(F.col(url), F.lit("")).alias("url"), F.col(position).alias("_position"), own.alias("_own"),
                             F.posexplode(evidence).alias("_index", "entry")).filter("entry IS NOT NULL")
    seen = entries.groupBy("url", "_own", "entry").agg(F.min(F.struct("_position", "_index")).alias("_first"))
    return seen.select("url", "entry", F.col("_first._position").alias("first_position"), F.col("_first._index").alias("first_index"))


def merge_by_id(results: DataFrame, key: str, position: str) -> DataFrame:
    """One row per id: its first position, the values of its last occurrence."""
    row = F.struct(*[F.col(c) for c in results.columns if c != position])
    best = results.groupBy(key).agg(F.min(position).alias("_first"), F.max_by(row, position).alias("_row"))
    return best.select("_row.*", F.col("_first").alias(position))


def distinct_feed(pages: DataFrame, url: str, *order: str) -> DataFrame:
    """First row of each URL, compared without case and outer blanks."""
    row = F.struct(*[F.col(c) for c in pages.columns])
    return pages.groupBy(F.lower(F.trim(url)).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def rag_context(hits: DataFrame, query: str, order: list[Column], k: int, name: str = "filename", excerpt: str = "excerpt") -> DataFrame:
    """Numbered context block of the ``k`` best hits of each query."""
    ranked = top_k_per(hits, [query], order, k)
    block = F.concat(F.lit("[Quelle "), F.col("rank").cast("string"), F.lit("] ("), name, F.lit("):\n"), excerpt, F.lit("\n"))
    lines = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("_b"))
    return lines.select(query, F.array_join(F.col("_b.block"), "\n").alias("context"))


def result_context(hits: DataFrame, query: str, order: list[Column], k: int, title: str = "filename", content: str = "excerpt") -> DataFrame:
    """The ``k`` best hits of each query as ``<result>`` elements."""
    ranked = top_k_per(hits, [query], order, k)
    element = F.concat(F.lit("<result index="), F.col("rank").cast("string"), F.lit(" title="), title, F.lit(">"), content, F.lit("</result>"))
    lines = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", element.alias("element")))).alias("_b"))
    return lines.select(query, F.array_join(F.col("_b.element"), "\n").alias("context"))


def link_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claim rows joined to their sources by ordinal; ``claims`` hold id, group, evidence_ids (array),
    ``sources`` group, ordinal, source_id. Ordinals without a source find no partner."""
    wanted = claims.select("claim_id", "group", F.explode(F.array_distinct("evidence_ids")).alias("ordinal"))
    return wanted.join(sources, ["group", "ordinal"])


def checked_claims(claims: DataFrame) -> DataFrame:
    """Claims with valid evidence only; verified needs at least one; empty texts are dropped.
    Rows hold claim_id, text, evidence_ids, verified and n_sources."""
    valid = valid_ordinals(F.col("evidence_ids"), F.col("n_sources"))
    out = claims.withColumn("evidence_ids", valid).withColumn("text", F.trim("text"))
    return out.withColumn("verified", F.col("verified") & (F.size("evidence_ids") > 0)).filter(F.length("text") > 0)


def first_chunks(chunks: DataFrame, n: int = 3) -> DataFrame:
    """First chunks of each file joined by a rule."""
    head = chunks.filter(F.col("idx") < n)
    return head.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("_c")).select(
        "file_id", F.array_join(F.col("_c.content"), "\n---\n").alias("initial_content"))


def snippets(files: DataFrame, text: str, size: int) -> DataFrame:
    return files.withColumn("snippet", snippet(F.col(text), size))


def transcripts(messages: DataFrame) -> DataFrame:
    """Chat history as ``User:``/``AI:`` lines, one row per chat."""
    speaker = F.when(F.col("role") == "assistant", "AI").otherwise("User")
    lines = messages.select("conv_id", "turn", F.concat(speaker, F.lit(": "), "text").alias("line"))
    return lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("_l")).select(
        "conv_id", F.array_join(F.col("_l.line"), "\n").alias("transcript"))


def restart_chats(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages left after each edited chat is cut behind the edited turn (``edits``: conv_id, turn)."""
    last = edits.groupBy("conv_id").agg(F.max("turn").alias("_edited"))
    joined = messages.join(last, "conv_id", "left")
    return joined.filter(F.col("_edited").isNull() | (F.col("turn") <= F.col("_edited"))).drop("_edited")


def speaker_segments(segments: DataFrame) -> DataFrame:
    """Segments, characters and first and last position of each speaker."""
    who = F.coalesce("speaker", F.lit("UNKNOWN"))
    return segments.groupBy(who.alias("speaker")).agg(
        F.count("*").alias("segments"), F.sum(F.length("text")).alias("characters"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))
