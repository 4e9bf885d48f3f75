"""Context headers, time codes, transcripts and OCR layouts as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def clock(seconds: Column) -> Column:
    """``MM:SS``, with hours in front only when there are any."""
    whole = F.floor(seconds).cast("bigint")
    hours, minutes, secs = F.floor(whole / 3600).cast("bigint"), F.floor(whole % 3600 / 60).cast("bigint"), whole % 60
    short = F.concat_ws(":", two(minutes), two(secs))
    shown = F.when(hours > 0, F.concat_ws(":", two(hours), short)).otherwise(short)
    return F.when(seconds.isNotNull(), shown)


def vtt_clock(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    millis = F.round(seconds.cast("double") * 1000).cast("bigint")
    whole = F.floor(millis / 1000).cast("bigint")
    return F.concat(
        two(F.floor(whole / 3600).cast("bigint")), F.lit(":"), two(F.floor(whole % 3600 / 60).cast("bigint")),
        F.lit(":"), two(whole % 60), F.lit("."), F.lpad((millis % 1000).cast("string"), 3, "0"))


def labelled(label: str, value: Column) -> Column:
    """``label: value``, null when the value is null."""
    return F.concat(F.lit(label + ": "), value.cast("string"))


def span(start: Column, end: Column) -> Column:
    return F.concat(start, F.coalesce(F.concat(F.lit("-"), end), F.lit("")))


def line_header(text: Column, source_type: Column, name: Column, page: Column, pages: Column, sheet: Column,
                start: Column, end: Column, line_start: Column, line_end: Column, category: Column,
                confidence: Column) -> Column:
    """Text under a bracketed header of one or two lines and a rule."""
    total = F.when(pages != 0, F.concat(F.lit("/"), pages.cast("string")))
    first = F.concat_ws(
        " | ", labelled("SOURCE", name), labelled("TYPE", source_type),
        labelled("PAGE", F.concat(page.cast("string"), F.coalesce(total, F.lit("")))),
        labelled("SHEET", F.when(sheet != "", sheet)), labelled("TIME", span(clock(start), clock(end))),
        labelled("LINES", span(line_start.cast("string"), line_end.cast("string"))))
    shown = F.when(confidence.isNotNull(), F.format_string("%.2f", confidence))
    second = F.concat_ws(" | ", labelled("CATEGORY", F.when(category != "", category)), labelled("CONFIDENCE", shown))
    return F.concat(
        F.lit("["), first, F.lit("]\n"), F.when(second != "", F.concat(F.lit("["), second, F.lit("]\n"))).otherwise(""),
        F.lit("---\n"), text)


def block_header(text: Column, source_type: Column, name: Column, location: Column, category: Column,
                 confidence: Column) -> Column:
    """Text between ``[SOURCE: ...]`` and ``[/SOURCE]``; ``location`` is null for whole documents."""
    percent = F.when(confidence.isNotNull(), F.concat(F.round(confidence * 100).cast("bigint").cast("string"), F.lit("%")))
    parts = F.concat_ws(
        " | ", labelled("Type", source_type), labelled("File", name), labelled("Location", location),
        labelled("Category", F.when(category != "", category)), labelled("Confidence", percent))
    return F.concat(F.lit("[SOURCE: "), parts, F.lit("]\n"), text, F.lit("\n[/SOURCE]"))


def location_text(page: Column, line_start: Column, line_end: Column, start: Column, end: Column, sheet: Column,
                  cells: Column) -> Column:
    """Readable position inside a file; null when nothing is known."""
    several = line_end.isNotNull() & (line_end != 0) & (line_end != line_start)
    lines = F.when(several, F.concat(F.lit("Lines "), line_start.cast("string"), F.lit("-"), line_end.cast("string"))).otherwise(
        F.concat(F.lit("Line "), line_start.cast("string")))
    time = F.concat(F.lit("Time "), span(clock(start), F.when(end != 0, clock(end))))
    joined = F.concat_ws(
        " | ", F.concat(F.lit("Page "), page.cast("string")), lines, time, labelled("Sheet", sheet), labelled("Cells", cells))
    return F.when(joined != "", joined)


BLOCK = r"(?s)\[SOURCE:\s*([^\]]+)\]\n(.*?)\n\[/SOURCE\]"


def unwrap_text(wrapped: Column) -> Column:
    """Original text of a block header, or the input when there is no header."""
    return F.when(wrapped.rlike(BLOCK), F.regexp_extract(wrapped, BLOCK, 2)).otherwise(wrapped)


def unwrap_fields(wrapped: Column) -> Column:
    """Header fields as a map; empty without a header."""
    parts = F.filter(F.split(F.regexp_extract(wrapped, BLOCK, 1), r" \| "), lambda p: p.contains(": "))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(
        F.trim(F.regexp_extract(p, r"^(.*?): ", 1)), F.trim(F.regexp_extract(p, r"(?s)^.*?: (.*)$", 1)))))


def transcript_text(segments: Column) -> Column:
    """``[start-end] (speaker) text`` lines of an array of segments."""
    return F.array_join(F.transform(segments, lambda s: F.concat(
        F.lit("["), clock(s["start"]), F.lit("-"), clock(s["end"]), F.lit("]"),
        F.coalesce(F.concat(F.lit(" ("), s["speaker"], F.lit(")")), F.lit("")), F.lit(" "), s["text"])), "\n")


def transcript_vtt(segments: Column) -> Column:
    """WebVTT captions of an array of segments."""
    cues = F.transform(segments, lambda s, i: F.concat(
        (i + 1).cast("string"), F.lit("\n"), vtt_clock(s["start"]), F.lit(" --> "), vtt_clock(s["end"]), F.lit("\n"),
        s["text"], F.lit("\n")))
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n"))


def layout_text(blocks: Column) -> Column:
    """Headings, tables and plain lines of a page layout ``array<struct<kind,lines array<string>>>``."""
    def section(b: Column) -> Column:
        table = F.concat_ws("\n", F.lit("[TABLE]"), F.transform(b["lines"], lambda t: F.concat(F.lit("  "), t)), F.lit("[/TABLE]"))
        return (F.when(b["kind"] == "header", F.concat(F.lit("## "), F.array_join(b["lines"], " ")))
                .when(b["kind"] == "table", table).otherwise(F.array_join(b["lines"], "\n")))

    return F.array_join(F.transform(blocks, section), "\n")


def region_text(lines: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Lines whose box overlaps the region; lines are ``struct<text,x1,y1,x2,y2>``."""
    inside = F.filter(lines, lambda b: (b["x1"] < x2) & (b["x2"] > x1) & (b["y1"] < y2) & (b["y2"] > y1))
    return F.array_join(F.transform(inside, lambda b: b["text"]), "\n")


def tables_only(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["kind"] == "table")
