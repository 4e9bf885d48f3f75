"""Checked queries over column functions: text, names, headers, scores, personal data, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import chunking, headers, naming, quality, scoring, text
from ..functions.evidence import cited_ordinals, evidence_from_metadata, merge_evidence
from ..functions.pii import mask_pii, pii_counts
from ..functions.vectors import cosine
from ..operators import classify, reports, search
from ..operators.grouping import hashed_sample, number_rows, top_k_per
from .queries_ledger import TS, rounded, sql_list
from .registry import query
from .tables import FILES, Tables


def sql_map(table: dict, key: str, default: str | None) -> str:
    """CASE over a fixed table."""
    by_value: dict = {}
    for name, value in table.items():
        by_value.setdefault(value, []).append(name)
    arms = " ".join(f"WHEN {key} IN ({sql_list(names)}) THEN {repr(value)}" for value, names in by_value.items())
    return f"CASE {arms} ELSE {default if default is not None else 'NULL'} END"


def replaced(expr: str, steps) -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


BLANK = r"[ \t\r\f\x{A0}]"
TIDY = [(r"\n{3,}", "\n\n"), (rf"{BLANK}*\n{BLANK}*", "\n"), (r" {2,}", " "), (r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")]
ENTITIES = f"MAP {{{', '.join(f'''{sql_list([k])}: {sql_list([v])}''' for k, v in text.ENTITY_NAMES.items())}}}"
REF = r"regexp_extract(p, '^(#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z][A-Za-z0-9]*);', 1)"
UNESCAPED = f"""array_to_string(list_transform(string_split(x, '&'), lambda p, i: CASE WHEN i = 1 THEN p
    WHEN regexp_matches({REF}, '^#[0-9]') THEN chr(CAST(substr({REF}, 2) AS INT)) || substr(p, length({REF}) + 2)
    WHEN regexp_matches({REF}, '^#[xX]') THEN chr(CAST('0x' || substr({REF}, 3) AS INT)) || substr(p, length({REF}) + 2)
    WHEN names[{REF}] IS NOT NULL THEN names[{REF}] || substr(p, length({REF}) + 2) ELSE '&' || p END), '')"""
HTML_STEPS = [
    (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?i)<h1[^>]*>([^\n]*?)</h1>", "# \\1\n"), (r"(?i)<h2[^>]*>([^\n]*?)</h2>", "## \\1\n"), (r"(?i)<h3[^>]*>([^\n]*?)</h3>", "### \\1\n"),
    (r"(?is)<li[^>]*>(.*?)</li>", "- \\1\n"), (r"(?is)<p[^>]*>(.*?)</p>", "\\1\n\n"), (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<tr[^>]*>", "| "), (r"(?i)</tr>", " |\n"), (r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", "\\1 | "), (r"<[^>]+>", "")]


@query("c1_html_to_markdown", f"""WITH s AS (SELECT page_id, {replaced('html', HTML_STEPS)} AS x, {ENTITIES} AS names FROM pages),
  u AS (SELECT page_id, {UNESCAPED} AS x FROM s) SELECT page_id, {replaced('x', TIDY)} AS markdown FROM u""")
def _(t: Tables):
    return t.html.select("page_id", text.html_to_markdown(F.col("html")).alias("markdown"))


@query("c2_tidy_markdown", f"SELECT doc_id, {replaced('text', TIDY)} AS tidy FROM documents")
def _(t: Tables):
    return t.docs.select("doc_id", text.tidy_markdown(F.col("text")).alias("tidy"))


@query("c3_query_keywords", f"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[?!]', '', 'g'), '\\s+'),
  lambda w: length(w) > 2 AND NOT list_contains([{sql_list(V.QUERY_STOPWORDS)}], w))[1:6], ' ') AS keywords FROM benchmark""")
def _(t: Tables):
    return t.benchmark.select("item_id", F.array_join(text.query_keywords(F.col("text")), " ").alias("keywords"))


RUNS = r'[<>:"/\\|?*\s]+'


@query("c4_smart_filename", f"""WITH {FILES} SELECT id, '2024-01-31_' || regexp_replace(trim(split_part(split_part(category || ' neu|x', '|', 1), '/', 1)), '{RUNS}', '', 'g') || '_'
  || substr(regexp_replace(CASE WHEN language = 'en' THEN split_part(extracted_text, '.', 1) ELSE left(original_filename, length(original_filename) - length(extension)) END, '{RUNS}', '_', 'g'), 1, 30)
  || extension AS smart_name FROM files""")
def _(t: Tables):
    entity = F.when(F.col("language") == "en", F.split_part("extracted_text", F.lit("."), F.lit(1))).otherwise("")
    return t.files().select("id", naming.smart_filename(
        F.col("original_filename"), F.concat("category", F.lit(" neu|x")), entity, F.lit("2024-01-31")).alias("smart_name"))


@query("c5_translate_path", f"""WITH {FILES} SELECT id, CASE WHEN language = 'en' THEN '/mnt/data' || replace(original_path, '\\', '/')
  WHEN language = 'de' THEN '/mnt/data' || substr(original_path, 7) ELSE 'rel' || original_path END AS mounted FROM files""")
def _(t: Tables):
    path = (F.when(F.col("language") == "en", F.concat(F.lit("F:"), F.replace("original_path", F.lit("/"), F.lit("\\"))))
            .when(F.col("language") == "de", F.col("original_path")).otherwise(F.concat(F.lit("rel"), "original_path")))
    return t.files().select("id", naming.translate_path(path, host_prefix="/inbox").alias("mounted"))


@query("c6_category_from_path", f"""WITH {FILES} SELECT id, CASE WHEN category IN ({sql_list(V.PATH_CATEGORIES)}) THEN category ELSE 'Sonstiges' END AS path_category FROM files""")
def _(t: Tables):
    return t.files().select("id", naming.category_from_path(F.col("current_path")).alias("path_category"))


def sql_clock(x: str) -> str:
    return (f"CASE WHEN floor({x} / 3600) > 0 THEN printf('%02d:%02d:%02d', floor({x} / 3600)::BIGINT, (floor({x})::BIGINT % 3600) // 60, floor({x})::BIGINT % 60) "
            f"ELSE printf('%02d:%02d', (floor({x})::BIGINT % 3600) // 60, floor({x})::BIGINT % 60) END")


@query("c7_line_header", f"""WITH {FILES} SELECT id, '[SOURCE: ' || original_filename || ' | TYPE: text_file'
   || CASE WHEN language = 'en' THEN ' | PAGE: ' || (n_chars % 9) || CASE WHEN n_chars % 3 <> 0 THEN '/' || (n_chars % 3) ELSE '' END ELSE '' END
   || CASE WHEN language = 'de' THEN ' | SHEET: ' || author ELSE '' END
   || CASE WHEN language = 'fr' THEN ' | TIME: ' || {sql_clock('n_chars')} || '-' || {sql_clock('(n_chars + 70)')} ELSE '' END
   || CASE WHEN language = 'es' THEN ' | LINES: ' || n_chars ELSE '' END || ']' || chr(10)
   || '[CATEGORY: ' || category || CASE WHEN status = 'indexed' THEN ' | CONFIDENCE: ' || printf('%.2f', round(confidence, 2)) ELSE '' END || ']' || chr(10) || '---' || chr(10) || extracted_text AS wrapped FROM files""")
def _(t: Tables):
    def only(lang: str, value):
        return F.when(F.col("language") == lang, value)

    n = F.col("n_chars")
    return t.files().select("id", headers.line_header(
        F.col("extracted_text"), F.lit("text_file"), F.col("original_filename"), only("en", n % 9), only("en", n % 3),
        only("de", F.col("author")), only("fr", n), only("fr", n + 70), only("es", n), F.lit(None).cast("int"), F.col("category"),
        F.when(F.col("status") == "indexed", F.col("confidence"))).alias("wrapped"))


@query("c8_block_header_roundtrip", f"""WITH {FILES} SELECT id, extracted_text AS body, original_filename AS file_field,
   'Page ' || (n_chars % 9) || ' | Line ' || n_chars AS location, round(confidence * 100)::BIGINT || '%' AS confidence_field FROM files""")
def _(t: Tables):
    none = F.lit(None)
    place = headers.location_text(F.col("n_chars") % 9, F.col("n_chars"), none.cast("bigint"), none.cast("double"), none.cast("double"),
                                  none.cast("string"), none.cast("string"))
    joined = F.replace(place, F.lit(" | "), F.lit(" ¦ "))
    wrapped = t.files().withColumn("wrapped", headers.block_header(
        F.col("extracted_text"), F.lit("Document"), F.col("original_filename"), joined, F.col("category"), F.col("confidence")))
    fields = headers.unwrap_fields(F.col("wrapped"))
    return wrapped.select(
        "id", headers.unwrap_text(F.col("wrapped")).alias("body"), fields["File"].alias("file_field"),
        F.replace(fields["Location"], F.lit(" ¦ "), F.lit(" | ")).alias("location"), fields["Confidence"].alias("confidence_field"))


@query("c9_clocks", f"""WITH s AS (SELECT event_id, value * 37.5 AS x FROM events), m AS (SELECT *, round(x * 1000)::BIGINT AS ms FROM s)
  SELECT event_id, {sql_clock('x')} AS clock, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS vtt FROM m""")
def _(t: Tables):
    x = F.col("value") * F.lit(37.5)
    return t.events.select("event_id", headers.clock(x).alias("clock"), headers.vtt_clock(x).alias("vtt"))


SEGMENT_LIST = "list_transform(string_split(text, chr(10)), lambda l, i: {{'s': (i - 1) * 45, 'e': (i - 1) * 45 + 40, 'who': CASE WHEN i % 2 = 1 THEN 'A' END, 't': l}})"


def segments_of(t: Tables):
    parts = F.transform(F.split("text", "\n"), lambda l, i: F.struct(
        (i * 45).cast("double").alias("start"), (i * 45 + 40).cast("double").alias("end"),
        F.when(i % 2 == 0, "A").alias("speaker"), l.alias("text")))
    return t.docs.select("doc_id", parts.alias("segments"))


@query("c10_transcript_text", f"""WITH s AS (SELECT doc_id, {SEGMENT_LIST.format()} AS segs FROM documents)
  SELECT doc_id, array_to_string(list_transform(segs, lambda g: '[' || {sql_clock('g.s')} || '-' || {sql_clock('g.e')} || ']' || coalesce(' (' || g.who || ')', '') || ' ' || g.t), chr(10)) AS transcript FROM s""")
def _(t: Tables):
    return segments_of(t).select("doc_id", headers.transcript_text(F.col("segments")).alias("transcript"))


@query("c10_transcript_vtt", f"""WITH s AS (SELECT doc_id, {SEGMENT_LIST.format()} AS segs FROM documents)
  SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || array_to_string(list_transform(segs, lambda g, i: i || chr(10)
    || printf('%02d:%02d:%02d.000', g.s // 3600, (g.s // 60) % 60, g.s % 60) || ' --> ' || printf('%02d:%02d:%02d.000', g.e // 3600, (g.e // 60) % 60, g.e % 60)
    || chr(10) || g.t || chr(10)), chr(10)) AS vtt FROM s""")
def _(t: Tables):
    return segments_of(t).select("doc_id", headers.transcript_vtt(F.col("segments")).alias("vtt"))


@query("c11_layout_text", """WITH b AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
  SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE i % 3 WHEN 1 THEN '## ' || x WHEN 2 THEN '[TABLE]' || chr(10) || '  ' || x || chr(10) || '[/TABLE]' ELSE x END), chr(10)) AS layout,
    array_to_string(list_filter(l, lambda x, i: (i - 1) * 20 < 95 AND (i - 1) * 20 + 15 > 30), chr(10)) AS region, len(list_filter(l, lambda x, i: i % 3 = 2)) AS tables FROM b""")
def _(t: Tables):
    lines = F.split("text", "\n")
    blocks = F.transform(lines, lambda l, i: F.struct(
        F.when(i % 3 == 0, "header").when(i % 3 == 1, "table").otherwise("text").alias("kind"), F.array(l).alias("lines")))
    boxes = F.transform(lines, lambda l, i: F.struct(l.alias("text"), F.lit(0).alias("x1"), (i * 20).alias("y1"), F.lit(50).alias("x2"), (i * 20 + 15).alias("y2")))
    return t.docs.select("doc_id", headers.layout_text(blocks).alias("layout"), headers.region_text(boxes, 10, 30, 40, 95).alias("region"),
                              F.size(headers.tables_only(blocks)).alias("tables"))


EXT = "lower(ltrim(extension, '.'))"
MIME_ARMS = " ".join(f"WHEN {'contains' if how == 'contains' else 'starts_with'}(lower(content_type), '{n}') THEN '{kind}'" for how, n, kind in V.MIME_SOURCE_TYPES)


@query("c12_source_type", f"""WITH {FILES} SELECT id, CASE {MIME_ARMS} ELSE {sql_map(V.EXTENSION_SOURCE_TYPES, EXT, "'text_file'")} END AS source_type FROM files""")
def _(t: Tables):
    return t.files().select("id", scoring.source_type(F.col("content_type"), F.col("extension")).alias("source_type"))


@query("c13_url_extension", r"SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(?i)\.([a-z0-9]+)$', 1)) AS ext FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", text.url_extension(F.col("url")).alias("ext"))


@query("c14_extractor", """SELECT doc_id, CASE lang WHEN 'en' THEN 'Docling' WHEN 'de' THEN 'Surya' WHEN 'fr' THEN 'WhisperX' ELSE 'Tika' END AS extractor FROM documents""")
def _(t: Tables):
    label = F.when(F.col("lang") == "en", "IBM-Docling 2").when(F.col("lang") == "de", "surya ocr").when(F.col("lang") == "fr", "fast-Whisper")
    return t.documents.select("doc_id", scoring.extractor(label).alias("extractor"))


@query("c15_smart_context", """SELECT doc_id, substr('Filename: ' || source || chr(10) || 'Content: ' || substr(text, 1, 800) || ' ... '
  || CASE WHEN length(text) > 1600 THEN substr(text, length(text) // 2 + 1, 800) ELSE '' END, 1, 2000) AS context FROM documents""")
def _(t: Tables):
    return t.docs.select("doc_id", text.smart_context(F.col("source"), F.col("text")).alias("context"))


@query("c16_name_tags", f"""WITH {FILES} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(replace(original_path, '/', ' - '), '[ \\-_]+'),
  lambda w: lower(trim(w))), lambda w: length(w) > 2))), ',') AS tags FROM files""")
def _(t: Tables):
    named = F.replace("original_path", F.lit("/"), F.lit(" - "))
    return t.files().select("id", F.array_join(F.array_sort(text.name_tags(named)), ",").alias("tags"))


def sql_priority(weights, keywords, submit: bool) -> str:
    age = "epoch_us((SELECT max(ingested_at) FROM files)) - epoch_us(ingested_at)"
    words = " OR ".join(f"contains(lower(original_filename), '{k}')" for k in keywords)
    base = (f"50 + CASE WHEN {age} < 3600000000 THEN 30 WHEN {age} < 86400000000 THEN 20 WHEN {age} < 604800000000 THEN 10 ELSE 0 END "
            f"+ {sql_map(weights, EXT, '0')} + CASE WHEN {words} THEN 15 ELSE 0 END")
    mb = 1048576
    if submit:
        return (f"(SELECT least(100, greatest(0, CASE WHEN file_size_bytes > {500 * mb} THEN greatest(b - 20, 0) ELSE b END)) FROM "
                f"(SELECT CASE WHEN file_size_bytes > {50 * mb} AND a < 70 THEN a - 10 ELSE a END AS b FROM (SELECT {base} AS a)))")
    return f"(SELECT least(100, greatest(0, CASE WHEN file_size_bytes > {100 * mb} AND a < 70 THEN a - 10 ELSE a END)) FROM (SELECT {base} AS a))"


@query("c17_priority", f"""WITH {FILES}, p AS (SELECT id, {sql_priority(V.SUBMIT_WEIGHTS, V.SUBMIT_KEYWORDS, True)} AS submit_priority,
    {sql_priority(V.ROUTER_WEIGHTS, V.ROUTER_KEYWORDS, False)} AS router_priority FROM files)
  SELECT id, submit_priority, router_priority, CASE WHEN submit_priority >= 75 THEN 'intake:priority' WHEN submit_priority >= 40 THEN 'intake:normal' ELSE 'intake:bulk' END AS queue FROM p""")
def _(t: Tables):
    files = t.files()
    args = [F.col(c) for c in ("original_filename", "extension", "file_size_bytes", "ingested_at")] + [t.as_of(files, "ingested_at")]
    out = files.select("id", scoring.submit_priority(*args).alias("submit_priority"), scoring.router_priority(*args).alias("router_priority"))
    return out.withColumn("queue", scoring.intake_queue(F.col("submit_priority")))


DEEP = f"{EXT} IN ({sql_list(V.ROUTER_DEEP_TYPES)})"


@query("c18_path", f"""WITH {FILES}, p AS (SELECT *, {sql_priority(V.ROUTER_WEIGHTS, V.ROUTER_KEYWORDS, False)} AS priority FROM files)
  SELECT id, CASE WHEN file_size_bytes > 52428800 OR ({EXT} IN ({sql_list(V.SUBMIT_DEEP_TYPES)}) AND file_size_bytes > 10485760) THEN 'deep' ELSE 'fast' END AS submit_path,
    CASE WHEN language = 'es' OR file_size_bytes > 52428800 THEN 'deep' WHEN priority >= 70 AND file_size_bytes < 10485760 THEN 'fast' WHEN {DEEP} THEN 'deep' ELSE 'fast' END AS router_path FROM p""")
def _(t: Tables):
    files = t.files()
    ext, size = F.col("extension"), F.col("file_size_bytes")
    priority = scoring.router_priority(F.col("original_filename"), ext, size, F.col("ingested_at"), t.as_of(files, "ingested_at"))
    return files.select("id", scoring.submit_path(ext, size).alias("submit_path"),
                        scoring.router_path(ext, size, priority, F.col("language") == "es").alias("router_path"))


@query("l5_priority_order", f"""WITH {FILES}, p AS (SELECT id, {sql_priority(V.SUBMIT_WEIGHTS, V.SUBMIT_KEYWORDS, True)} AS priority, ingested_at FROM files)
  SELECT id, priority FROM p ORDER BY priority DESC, ingested_at, id LIMIT 100""")
def _(t: Tables):
    files = t.files()
    args = [F.col(c) for c in ("original_filename", "extension", "file_size_bytes", "ingested_at")] + [t.as_of(files, "ingested_at")]
    jobs = files.select("id", scoring.submit_priority(*args).alias("priority"), "ingested_at")
    return jobs.orderBy(F.desc("priority"), "ingested_at", "id").limit(100).drop("ingested_at")


ROUTER_SQL = f"CASE WHEN {EXT} IN ({sql_list(V.ROUTER_DOCUMENTS)}) THEN 'extract:documents' ELSE {sql_map(V.ROUTER_QUEUES, EXT, "'extract:unknown'")} END"


@query("j7_routing", f"""WITH {FILES}, p AS (SELECT id, {sql_map(V.SUBMIT_QUEUES, EXT, "'extract:documents'")} AS queue, {ROUTER_SQL} AS router_queue,
    {sql_map(V.EXTENSION_PARSERS, EXT, "'tika'")} AS parser FROM files)
  SELECT *, CASE parser WHEN 'docling' THEN 'docling,tika' WHEN 'surya' THEN 'surya,tika' ELSE parser END AS chain FROM p""")
def _(t: Tables):
    ext = F.col("extension")
    return t.files().select("id", scoring.submit_queue(ext).alias("queue"), scoring.router_queue(ext).alias("router_queue"), scoring.parser(ext).alias("parser"), scoring.parser_chain(ext).alias("chain"))


ROUTED = [*V.ROUTER_DOCUMENTS, *V.ROUTER_QUEUES, "no such format"]


@query("j7_router_formats", f"""WITH f AS (SELECT doc_id, [{sql_list(ROUTED)}][doc_id % {len(ROUTED)} + 1] AS extension FROM documents)
  SELECT doc_id, extension, {ROUTER_SQL} AS queue FROM f""")
def _(t: Tables):
    return router_formats(t)


def router_formats(t: Tables) -> DataFrame:
    """Every format of the router's table in turn, over all documents."""
    formats = F.array(*map(F.lit, ROUTED))
    docs = t.docs.select("doc_id", F.get(formats, (F.col("doc_id") % len(ROUTED)).cast("int")).alias("extension"))
    return docs.withColumn("queue", scoring.router_queue(F.col("extension")))


@query("a26_format_counts", f"""WITH f AS (SELECT doc_id, [{sql_list(ROUTED)}][doc_id % {len(ROUTED)} + 1] AS extension FROM documents)
  SELECT {ROUTER_SQL} AS queue, count(*) AS files, count(DISTINCT extension) AS formats, string_agg(DISTINCT extension, ',' ORDER BY extension) AS extensions FROM f GROUP BY 1""")
def _(t: Tables):
    return router_formats(t).groupBy("queue").agg(
        F.count("*").alias("files"), F.countDistinct("extension").alias("formats"), F.array_join(F.array_sort(F.collect_set("extension")), ",").alias("extensions"))


REGISTERED = [*scoring.registered_formats(), "no such format"]
FORMAT_ROWS = f"""f AS (SELECT doc_id, [{sql_list(REGISTERED)}][doc_id % {len(REGISTERED)} + 1] AS extension FROM documents),
  r AS (SELECT unnest(string_split(names, ' ')) AS extension, n, category, processor, strategy
        FROM (VALUES {', '.join(f"({n}, '{c}', '{p}', '{s}', '{names}')" for n, (c, p, s, names) in enumerate(V.FORMAT_RULES))}) v(n, category, processor, strategy, names)),
  known AS (SELECT extension, arg_max(category, n) AS category, arg_max(processor, n) AS processor, arg_max(strategy, n) AS strategy FROM r GROUP BY extension)"""


def registered_files(t: Tables) -> DataFrame:
    """Every registered format in turn, over all documents, with its category, processor and strategy."""
    formats = F.array(*map(F.lit, REGISTERED))
    docs = t.docs.select("doc_id", F.get(formats, (F.col("doc_id") % len(REGISTERED)).cast("int")).alias("extension"))
    return docs.withColumn("_s", scoring.format_spec(F.col("extension"))).select("doc_id", "extension", "_s.*")


@query("j7_format_registry", f"""WITH {FORMAT_ROWS} SELECT doc_id, extension, coalesce(category, 'unknown') AS category, coalesce(processor, 'strings') AS processor,
  coalesce(strategy, 'binary') AS strategy FROM f LEFT JOIN known USING (extension)""")
def _(t: Tables):
    return registered_files(t)


@query("a26_category_counts", f"""WITH {FORMAT_ROWS}, kinds AS (SELECT category, count(*) AS formats FROM known GROUP BY 1),
  seen AS (SELECT coalesce(category, 'unknown') AS category, count(*) AS files, count(DISTINCT f.extension) AS formats_seen FROM f LEFT JOIN known USING (extension) GROUP BY 1)
  SELECT category, coalesce(formats, 0) AS formats, coalesce(files, 0) AS files, coalesce(formats_seen, 0) AS formats_seen FROM kinds FULL JOIN seen USING (category)""")
def _(t: Tables):
    return reports.category_formats(registered_files(t).select("extension"))


@query("a26_routing_counts", f"""WITH {FILES} SELECT {sql_map(V.EXTENSION_PARSERS, EXT, "'tika'")} AS parser, count(*) AS files,
  string_agg(DISTINCT extension, ',' ORDER BY extension) AS extensions FROM files GROUP BY 1""")
def _(t: Tables):
    return t.files().groupBy(scoring.parser(F.col("extension")).alias("parser")).agg(
        F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("extension")), ",").alias("extensions"))


MASKS = {label: pattern for label, pattern in V.PII_PATTERNS}


def masked_before(label: str) -> str:
    steps = []
    for name, pattern in V.PII_PATTERNS:
        if name == label:
            break
        steps.append((pattern, f"[{name}]"))
    return replaced("text", steps)


@query("c24_pii_counts", "SELECT doc_id, " + ", ".join(
    f"len(regexp_extract_all({masked_before(label)}, '{pattern}')) AS {label.lower()}" for label, pattern in V.PII_PATTERNS) + " FROM documents")
def _(t: Tables):
    return t.docs.select("doc_id", pii_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("c25_mask_pii", f"SELECT doc_id, {replaced('text', [(p, f'[{n}]') for n, p in V.PII_PATTERNS])} AS masked FROM documents")
def _(t: Tables):
    return t.docs.select("doc_id", mask_pii(F.col("text")).alias("masked"))


@query("c26_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("sha256"))


@query("c23_rule_classifier", f"""WITH {FILES}, n AS (SELECT id, lower(text) AS low, {', '.join(f"len(regexp_extract_all({masked_before(label)}, '{p}')) AS {label.lower()}" for label, p in V.PII_PATTERNS)}
    FROM (SELECT id, extracted_text AS text FROM files))
  SELECT id, CASE WHEN contains(low, 'vertrag') OR contains(low, 'contract') OR contains(low, 'arbeits') OR contains(low, 'salary') OR contains(low, 'gehalt') THEN 'Arbeit'
    WHEN iban > 0 THEN 'Finanzen' WHEN email > 0 OR phone > 0 THEN 'Arbeit' WHEN date > 3 THEN 'Dokumente' WHEN contains(low, 'arzt') OR contains(low, 'diagnose') THEN 'Gesundheit'
    WHEN contains(low, 'versicher') THEN 'Finanzen' ELSE 'Sonstiges' END AS category FROM n""")
def _(t: Tables):
    counted = t.text_files().withColumn("c", pii_counts(F.col("extracted_text")))
    labels = F.flatten(F.array(*[F.array_repeat(F.lit(n), F.col(f"c.{n}").cast("int")) for n in ("email", "iban", "phone", "date")]))
    return counted.select("id", classify.category(F.col("extracted_text"), labels).alias("category"))


@query("c27_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"
SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("c28_error_rates", f"""WITH p AS (SELECT conv_id, turn, {ASCII} AS r, replace({ASCII}, 'th', 'd') AS h FROM conversations)
  SELECT conv_id, turn, CASE WHEN length(r) = 0 THEN (length(h) > 0)::INT::DOUBLE ELSE round(levenshtein(r, h) / length(r), 6) END AS cer,
    CASE WHEN length({SQUEEZED.format('r')}) = 0 THEN (length({SQUEEZED.format('h')}) > 0)::INT::DOUBLE
      ELSE round(least(1.0, levenshtein({SQUEEZED.format('r')}, {SQUEEZED.format('h')}) / length({SQUEEZED.format('r')})), 6) END AS wer_char FROM p""")
def _(t: Tables):
    r = F.regexp_replace("text", "[^ -~]", "")
    pairs = t.conversations.select("conv_id", "turn", r.alias("r"), F.replace(r, F.lit("th"), F.lit("d")).alias("h"))
    return rounded(pairs.select("conv_id", "turn", quality.char_error_rate(F.col("r"), F.col("h")).alias("cer"),
                                quality.word_error_rate_by_chars(F.col("r"), F.col("h")).alias("wer_char")), "cer", "wer_char")


@query("c28_word_error_rate")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", quality.word_error_rate(
        F.col("text"), F.regexp_replace("text", r"\bth", "d")).alias("wer"))


@query("c29_f1_rtf", """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE 2 * l_discount * l_tax / (l_discount + l_tax) END, 6) AS f1,
  round(l_discount / l_quantity, 6) AS rtf FROM lineitem""")
def _(t: Tables):
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", quality.f1(F.col("l_discount"), F.col("l_tax")).alias("f1"),
                                     quality.real_time_factor(F.col("l_discount"), F.col("l_quantity")).alias("rtf")), "f1", "rtf")


GROUND = "lower(text || ' ' || source)"


@query("c30_grounding", f"""WITH e AS (SELECT doc_id, {GROUND} AS body, [source, 'the Zzqq', 'Qqzz', upper(lang)] AS ents FROM documents)
  SELECT doc_id, round(len(list_filter(ents, lambda x: contains(body, lower(x)) OR len(list_filter(string_split(lower(x), ' '), lambda w: w <> '' AND contains(body, w))) > 0)) / 4.0, 6)::DOUBLE AS rate FROM e""")
def _(t: Tables):
    ents = F.array(F.col("source"), F.lit("the Zzqq"), F.lit("Qqzz"), F.upper("lang"))
    return rounded(t.docs.select("doc_id", quality.grounding_rate(ents, F.col("text"), F.col("source")).alias("rate")), "rate")


@query("c31_hallucination", f"""WITH e AS (SELECT doc_id, {GROUND} AS body, ['that which there', 'quux zonk ' || source, 'nothing'] AS facts, [CAST(n_chars AS VARCHAR) || ' EUR', '12,50'] AS amounts FROM documents),
  w AS (SELECT doc_id, amounts, facts, len(list_filter(facts, lambda f: len(list_filter(regexp_extract_all(lower(f), '[\\p{{L}}\\p{{N}}_]{{4,}}'), lambda w: contains(body, w))) < len(regexp_extract_all(lower(f), '[\\p{{L}}\\p{{N}}_]{{4,}}')) * 0.3::DOUBLE))
     + len(list_filter(flatten(list_transform(amounts, lambda a: regexp_extract_all(a, '[0-9.,]+'))), lambda n: NOT contains(body, n))) AS bad FROM e)
  SELECT doc_id, round(bad / 5.0, 6)::DOUBLE AS score FROM w""")
def _(t: Tables):
    facts = F.array(F.lit("that which there"), F.concat(F.lit("quux zonk "), "source"), F.lit("nothing"))
    amounts = F.array(F.concat(F.col("n_chars").cast("string"), F.lit(" EUR")), F.lit("12,50"))
    return rounded(t.docs.select("doc_id", quality.hallucination_score(facts, amounts, F.col("text"), F.col("source")).alias("score")), "score")


@query("c32_completeness", f"""WITH {FILES}, k AS (SELECT id, [CASE WHEN length(extracted_text) <= 50 THEN 'text_extracted' END, CASE WHEN language = 'es' THEN 'has_metadata' END,
     CASE WHEN NOT regexp_matches(extracted_text, '[a-zA-Z]{{3,}}') THEN 'readable_content' END,
     CASE WHEN extension IN ({sql_list(quality.DOCUMENT_EXTENSIONS)}) AND length(extracted_text) <= 200 THEN 'substantial_text' END,
     CASE WHEN extension IN ({sql_list(quality.IMAGE_EXTENSIONS)}) AND NOT language = 'fr' THEN 'image_metadata' END] AS c,
     3 + (extension IN ({sql_list(quality.DOCUMENT_EXTENSIONS)}))::INT + (extension IN ({sql_list(quality.IMAGE_EXTENSIONS)}))::INT AS n FROM files),
   m AS (SELECT id, n, list_filter(c, lambda x: x IS NOT NULL) AS missing FROM k)
  SELECT id, round((n - len(missing)) / n::DOUBLE, 6) AS score, array_to_string(missing, ',') AS missing FROM m""")
def _(t: Tables):
    meta = F.when(F.col("language") == "es", F.create_map().cast("map<string,string>")).when(
        F.col("language") == "fr", F.create_map(F.lit("Image Width"), F.lit("10"))).otherwise(F.create_map(F.lit("lang"), F.col("language")))
    out = t.files().select("id", quality.completeness(F.col("extracted_text"), meta, F.col("extension")).alias("c"))
    return rounded(out.select("id", "c.score", F.array_join("c.missing", ",").alias("missing")), "score")


NUMBERS = f"list_distinct(regexp_extract_all(text, '{V.NUMBER_PATTERN}'))"
DATES = f"list_distinct(regexp_extract_all(text, '{V.LOST_DATE_PATTERN}'))"
AMOUNTS = "regexp_extract_all(text, '[0-9]{12,}')"


@query("c33_information_loss", f"""WITH e AS (SELECT doc_id, {NUMBERS} AS nums, {DATES} AS dates, list_distinct(flatten(list_transform({AMOUNTS}, lambda a: regexp_extract_all(a, '{V.NUMBER_PATTERN}')))) AS kept FROM documents)
  SELECT doc_id, CASE WHEN len(nums) + len(dates) = 0 THEN 0.0::DOUBLE ELSE round(greatest(0, least(1, 1 - len(kept) / (len(nums) + len(dates))::DOUBLE)), 6) END AS loss FROM e""")
def _(t: Tables):
    amounts = F.regexp_extract_all("text", F.lit("[0-9]{12,}"), F.lit(0))
    none = F.array().cast("array<string>")
    return rounded(t.docs.select("doc_id", quality.information_loss(F.col("text"), amounts, none).alias("loss")), "loss")


@query("u4_lost_numbers", f"""SELECT doc_id, array_to_string(list_sort(list_filter({NUMBERS}, lambda n: NOT list_contains(flatten(list_transform({AMOUNTS}, lambda a: regexp_extract_all(a, '{V.NUMBER_PATTERN}'))), n))), ',') AS lost FROM documents""")
def _(t: Tables):
    amounts = F.regexp_extract_all("text", F.lit("[0-9]{12,}"), F.lit(0))
    return t.docs.select("doc_id", F.array_join(F.array_sort(quality.lost_numbers(F.col("text"), amounts)), ",").alias("lost"))


WORDS4 = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"


@query("c34_key_terms", f"""WITH w AS (SELECT conv_id, turn, {WORDS4.format('text')} AS a, {WORDS4.format("split_part(text, '.', 1)")} AS b FROM conversations)
  SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE round(least(1, len(list_intersect(a, b)) / least(len(a), 20)::DOUBLE), 6) END AS kept FROM w""")
def _(t: Tables):
    summary = F.split_part("text", F.lit("."), F.lit(1))
    return rounded(t.conversations.select("conv_id", "turn", quality.key_terms_preserved(F.col("text"), summary).alias("kept")), "kept")


@query("c34_sequence_ratio")
def _(t: Tables):
    summary = F.split_part("text", F.lit("."), F.lit(1))
    return t.conversations.select("conv_id", "turn", quality.sequence_ratio(F.col("text"), summary).alias("ratio"))


@query("c35_quality_score", """SELECT l_orderkey, l_linenumber, round(0.2 * l_discount + 0.25 * l_tax + 0.25 * (1 - l_discount) + 0.15 * (1 - l_tax) + 0.15 * (l_quantity / 50), 6)::DOUBLE AS score FROM lineitem""")
def _(t: Tables):
    d, x = F.col("l_discount"), F.col("l_tax")
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", quality.quality_score(d, x, d, x, F.col("l_quantity") / 50).alias("score")), "score")


@query("c36_normal_name", "SELECT c_custkey, lower(c_name) AS name FROM customer")
def _(t: Tables):
    titled = F.concat(F.when(F.col("c_nationkey") < 8, "Dr. ").when(F.col("c_nationkey") < 16, "Frau  ").otherwise(""), "c_name", F.lit("  "))
    return t.customer.select("c_custkey", text.normalise_person(titled).alias("name"))


@query("c37_merge_evidence", """SELECT doc_id, CASE WHEN lang = 'en' THEN 1 WHEN lang = 'de' THEN 2 ELSE 1 END + 0 AS entries, n_chars % 7 AS first_page FROM documents""")
def _(t: Tables):
    page = (F.col("n_chars") % 7).cast("int")
    none = F.lit(None)
    first = evidence_from_metadata(page, none, none.cast("array<int>"), none, none)
    second = (F.when(F.col("lang") == "en", first)
              .when(F.col("lang") == "de", evidence_from_metadata(page + 1, none, F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), none, none))
              .otherwise(evidence_from_metadata(none, none, F.array(F.lit(1)), none, none)))
    merged = merge_evidence(first, second)
    return t.documents.select("doc_id", F.size(merged).alias("entries"), F.get(merged, F.lit(0))["page"].cast("bigint").alias("first_page"))


HITS = "len(list_intersect(list_distinct(w), [{0}]))"


@query("c38_language_guess", f"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')[1:100] AS w FROM documents),
  h AS (SELECT doc_id, {HITS.format(sql_list(V.GERMAN_WORDS))} AS de, {HITS.format(sql_list(V.ENGLISH_WORDS))} AS en FROM s)
  SELECT doc_id, CASE WHEN de > en THEN 'de' WHEN en > de THEN 'en' ELSE 'unknown' END AS language FROM h""")
def _(t: Tables):
    return t.docs.select("doc_id", text.guess_language(F.col("text")).alias("language"))


@query("u3_word_overlap", f"""WITH w AS (SELECT conv_id, turn, {WORDS4.format('text')} AS a, {WORDS4.format("split_part(text, '.', 1)")} AS b FROM conversations)
  SELECT conv_id, turn, len(list_intersect(a, b)) AS shared FROM w""")
def _(t: Tables):
    shared = F.array_intersect(text.word_set(F.col("text")), text.word_set(F.split_part("text", F.lit("."), F.lit(1))))
    return t.conversations.select("conv_id", "turn", F.size(shared).alias("shared"))


@query("c40_golden_answers", """SELECT doc_id, (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND length(text) >= 200 AS any_ok,
  contains(lower(text), 'the') AND contains(lower(text), 'and') AND length(text) >= 200 AS all_ok FROM documents""")
def _(t: Tables):
    size = F.lit(200)
    return t.docs.select("doc_id", text.golden_check(F.col("text"), F.array(F.lit("The"), F.lit("der")), "any", size).alias("any_ok"),
                              text.golden_check(F.col("text"), F.array(F.lit("the"), F.lit("AND")), "all", size).alias("all_ok"))


@query("c43_follow_ups")
def _(t: Tables):
    return t.docs.select("doc_id", text.follow_ups(F.col("text")).alias("questions"))


@query("c44_prompt", f"""WITH {FILES} SELECT id, 'Datei: ' || original_filename || ' (' || content_type || ')' || chr(10) || CASE WHEN language = 'es' THEN '{V.NO_TEXT}' ELSE substr(extracted_text, 1, 3000) END AS prompt FROM files""")
def _(t: Tables):
    body = F.when(F.col("language") == "es", "").otherwise(F.col("extracted_text"))
    return t.files().select("id", text.render_prompt("Datei: %s (%s)\n%s", F.col("original_filename"), F.col("content_type"), body).alias("prompt"))


@query("c45_compression", "SELECT l_orderkey, l_linenumber, round(1 - l_quantity / greatest(1, l_extendedprice), 6) AS ratio FROM lineitem")
def _(t: Tables):
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", scoring.compression_ratio(F.col("l_quantity"), F.col("l_extendedprice")).alias("ratio")), "ratio")


@query("c46_date_bucket", f"""WITH {FILES}, d AS (SELECT id, (epoch_us((SELECT max(ingested_at) FROM files)) - epoch_us(ingested_at)) / 86400000000.0 AS days FROM files)
  SELECT id, CASE WHEN days <= 1 THEN 'today' WHEN days <= 7 THEN '7' WHEN days <= 30 THEN '30' ELSE 'older' END AS bucket FROM d""")
def _(t: Tables):
    files = t.files()
    return files.select("id", scoring.date_bucket(F.col("ingested_at"), t.as_of(files, "ingested_at")).alias("bucket"))


SUPER = f"list_filter(range(1, 10), lambda i: contains(text || translate(CAST(n_chars AS VARCHAR), '0123456789', '⁰{V.SUPERSCRIPTS}'), substr('{V.SUPERSCRIPTS}', i, 1)))"


@query("c47_cited_ordinals", f"SELECT doc_id, array_to_string({SUPER}, ',') AS cited FROM documents")
def _(t: Tables):
    answer = F.concat("text", F.translate(F.col("n_chars").cast("string"), "0123456789", "⁰" + V.SUPERSCRIPTS))
    return t.docs.select("doc_id", F.array_join(cited_ordinals(answer).cast("array<string>"), ",").alias("cited"))


@query("c48_chunks")
def _(t: Tables):
    return t.docs.select("doc_id", F.posexplode(chunking.chunks(F.col("text"))).alias("idx", "content"))


@query("e9_keyword_ratio", """WITH k AS (SELECT doc_id, lower(text) AS low, ['The', 'der', lang, source] AS keys FROM documents),
  m AS (SELECT doc_id, list_filter(keys, lambda x: NOT contains(low, lower(x))) AS missing FROM k)
  SELECT doc_id, 4 - len(missing) AS found, (4 - len(missing)) / 4.0::DOUBLE AS ratio, (4 - len(missing)) / 4.0 >= 0.5 AS passed, array_to_string(missing, ',') AS missing FROM m""")
def _(t: Tables):
    keys = F.array(F.lit("The"), F.lit("der"), F.col("lang"), F.col("source"))
    out = t.docs.select("doc_id", quality.keyword_ratio(F.col("text"), keys).alias("k"))
    return out.select("doc_id", F.col("k.found").cast("bigint").alias("found"), "k.ratio", (F.col("k.ratio") >= 0.5).alias("passed"), F.array_join("k.missing", ",").alias("missing"))


@query("p14_long_texts", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 100")
def _(t: Tables):
    return t.documents.filter(F.length("text") > V.MIN_GRAPH_TEXT).select("doc_id", "n_chars")


@query("p15_by_id", f"WITH {FILES} SELECT id, original_filename, current_path FROM files WHERE id = 42")
def _(t: Tables):
    return t.files().filter(F.col("id") == 42).select("id", "original_filename", "current_path")


@query("p16_snippets", """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS snippet FROM documents""")
def _(t: Tables):
    return search.snippets(t.documents, "text", 300).select("doc_id", "snippet")


@query("s6_text_corpus", "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text)) > 50")
def _(t: Tables):
    return t.docs.select("doc_id", F.length(F.trim("text")).alias("n")).filter("n > 50")


RESULTS = f"{FILES}, results AS (SELECT id, extension, '/archive/' || category AS folder, tags, ingested_at AS uploaded_at FROM files)"


def results(t: Tables):
    return t.files().select("id", "extension", F.concat(F.lit("/archive/"), "category").alias("folder"), "tags", F.col("ingested_at").alias("uploaded_at"))


@query("p12_faceted", f"""WITH {RESULTS} SELECT id FROM results WHERE extension IN ('.pdf', '.docx', '.txt', '.md') AND folder IN ('/archive/Finanzen', '/archive/Arbeit', '/archive/Dokumente')
  AND (list_contains(tags, 'en') OR list_contains(tags, 'src0')) AND epoch_us((SELECT max(uploaded_at) FROM results)) - epoch_us(uploaded_at) <= 7 * 86400000000""")
def _(t: Tables):
    found = results(t)
    return search.faceted(found, t.as_of(found, "uploaded_at"), [".pdf", ".docx", ".txt", ".md"],
                          ["/archive/Finanzen", "/archive/Arbeit", "/archive/Dokumente"], ["en", "src0"], False, ["7"]).select("id")


@query("p12_faceted_all_tags", f"""WITH {RESULTS} SELECT id FROM results WHERE list_contains(tags, 'en') AND list_contains(tags, 'src0')""")
def _(t: Tables):
    found = results(t)
    return search.faceted(found, t.as_of(found, "uploaded_at"), tags=["en", "src0"], match_all_tags=True).select("id")


@query("a27_facet_values", f"""WITH {RESULTS} SELECT DISTINCT 'type' AS facet, extension AS value FROM results UNION SELECT 'folder', folder FROM results UNION SELECT 'tag', unnest(tags) FROM results""")
def _(t: Tables):
    return search.facet_values(results(t))


@query("p13_source_types", f"""WITH {RESULTS} SELECT id, {sql_map(V.RESULT_SOURCE_TYPES, EXT, "'document'")} AS source_type FROM results
  WHERE {sql_map(V.RESULT_SOURCE_TYPES, EXT, "'document'")} IN ('video', 'audio') ORDER BY uploaded_at DESC, id LIMIT 20""")
def _(t: Tables):
    return search.of_source_types(results(t), ["video", "audio"], [F.desc("uploaded_at"), F.col("id")], 20).select("id", "source_type")


@query("p17_source_records", f"""WITH {FILES}, h AS (SELECT *, {sql_map(V.HIT_SOURCE_TYPES, EXT, "'text'")} AS type FROM files)
  SELECT id, type, CASE WHEN language = 'en' THEN original_filename WHEN language = 'de' THEN current_filename ELSE 'Document ' || (id + 1) END AS filename,
    CASE WHEN status = 'indexed' THEN current_path ELSE '' END AS path, CASE WHEN status = 'indexed' THEN regexp_extract(current_path, '^(.*)/[^/]*$', 1) END AS folder, extension AS file_extension,
    CASE WHEN language = 'fr' THEN round(confidence, 6) ELSE least(99, greatest(70, 100 - id * 3))::DOUBLE END AS confidence, substr(extracted_text, 1, 500) AS excerpt,
    CASE WHEN type = 'pdf' THEN n_chars END AS page, CASE WHEN type = 'audio' THEN n_chars END AS timestamp, CASE WHEN language = 'en' THEN 'Docling' ELSE 'Tika' END AS extracted_via FROM h""")
def _(t: Tables):
    lang = F.col("language")
    hits = t.files().select(
        "id", F.col("id").alias("position"), F.when(lang == "en", F.col("original_filename")).alias("filename"), F.when(lang == "de", F.col("current_filename")).alias("title"),
        F.when(F.col("status") == "indexed", F.col("current_path")).alias("path"), F.lit(None).cast("string").alias("file_path"), "extension",
        F.when(lang == "fr", F.round("confidence", 6)).alias("confidence"), F.lit(None).cast("string").alias("content"), F.col("extracted_text").alias("text"),
        F.lit(None).cast("bigint").alias("page"), F.col("n_chars").alias("page_number"), F.lit(None).cast("bigint").alias("timestamp"), F.col("n_chars").alias("start_time"),
        F.when(lang == "en", "docling").alias("extractor"), F.lit(None).cast("string").alias("extracted_via"))
    return search.source_records(hits)


@query("p18_index_rows", f"""WITH {FILES} SELECT id, epoch(ingested_at)::BIGINT AS file_created_timestamp, year(ingested_at) AS year_created, month(ingested_at) AS month_created,
  isodow(ingested_at) - 1 AS weekday_created, hour(ingested_at) AS hour_created, author || ' ' || language || ' ' || category AS entities_flat,
  {sql_map(V.INDEX_SOURCE_TYPES, EXT, "'other'")} AS source_type,
  '[SOURCE: Type: ' || {sql_map(V.INDEX_SOURCE_TYPES, EXT, "'other'")} || ' | File: ' || original_filename || ' | Category: ' || category || ' | Confidence: ' || round(confidence * 100)::BIGINT || '%]'
    || chr(10) || extracted_text || chr(10) || '[/SOURCE]' AS extracted_text FROM files""")
def _(t: Tables):
    entities = F.create_map(F.lit("org"), F.array("author", "language"), F.lit("topic"), F.array("category"))
    return search.index_rows(t.files().withColumn("entities", entities))


@query("c41_transcripts", """SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'AI' ELSE 'User' END || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def _(t: Tables):
    return search.transcripts(t.conversations)


@query("w10_restart_chats", """WITH e AS (SELECT conv_id, max(turn) AS edited FROM conversations WHERE role = 'user' AND length(text) > 150 GROUP BY 1)
  SELECT c.conv_id, turn FROM conversations c LEFT JOIN e ON e.conv_id = c.conv_id WHERE edited IS NULL OR turn <= edited""")
def _(t: Tables):
    edits = t.conversations.filter((F.col("role") == "user") & (F.length("text") > 150))
    return search.restart_chats(t.conversations, edits).select("conv_id", "turn")


@query("a28_speaker_segments", """SELECT coalesce(CASE WHEN role = 'system' THEN NULL ELSE role END, 'UNKNOWN') AS speaker, count(*) AS segments, sum(length(text))::BIGINT AS characters,
  min(turn) AS first_start, max(turn + 1) AS last_end FROM conversations GROUP BY 1""")
def _(t: Tables):
    segs = t.conversations.select(F.when(F.col("role") != "system", F.col("role")).alias("speaker"), "text", F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"))
    return search.speaker_segments(segs)


HOSTS = "hits AS (SELECT page_id AS position, CASE WHEN url LIKE '%.html%' THEN NULL ELSE split_part(url, '/', 3) END AS url, html AS content FROM pages)"


@query("w3_merge_by_url", f"""WITH {HOSTS} SELECT url, count(*) AS group_rows, min(position) AS first_position, string_agg(content, chr(10) || chr(10) ORDER BY position) AS content FROM hits WHERE url IS NOT NULL GROUP BY url
  UNION ALL SELECT url, 1, position, content FROM hits WHERE url IS NULL""")
def _(t: Tables):
    url = F.when(~F.col("url").contains(".html"), F.split_part("url", F.lit("/"), F.lit(3)))
    return search.merge_by_url(t.pages.select(F.col("page_id").alias("position"), url.alias("url"), F.col("html").alias("content")))


@query("w3_merge_evidence", f"""WITH {HOSTS}, e AS (SELECT url, position, CASE WHEN url IS NULL THEN position END AS own, i, [position % 5, length(content) % 3][i + 1] AS page FROM hits, (VALUES (0), (1)) v(i))
  SELECT url, page, position AS first_position, i AS first_index FROM e QUALIFY row_number() OVER (PARTITION BY url, own, page ORDER BY position, i) = 1""")
def _(t: Tables):
    url = F.when(~F.col("url").contains(".html"), F.split_part("url", F.lit("/"), F.lit(3)))
    page = [F.struct((n % F.lit(m)).cast("int").alias("page")) for n, m in ((F.col("page_id"), 5), (F.length("html"), 3))]
    hits = t.pages.select(F.col("page_id").alias("position"), url.alias("url"), F.array(*page).alias("evidence"))
    return search.evidence_by_url(hits).select("url", "entry.page", "first_position", "first_index")


@query("w4_merge_by_id", f"""WITH {HOSTS} SELECT url, min(position) AS position, arg_max(content, position) AS content FROM hits WHERE url IS NOT NULL GROUP BY url""")
def _(t: Tables):
    url = F.when(~F.col("url").contains(".html"), F.split_part("url", F.lit("/"), F.lit(3)))
    hits = t.pages.select(F.col("page_id").alias("position"), url.alias("url"), F.col("html").alias("content"))
    return search.merge_by_id(hits.filter("url IS NOT NULL"), "url", "position")


@query("u5_distinct_feed", """SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (SELECT page_id, upper(split_part(url, '/', 3)) || ' ' AS url FROM pages) GROUP BY lower(trim(url))""")
def _(t: Tables):
    feed = t.pages.select("page_id", F.concat(F.upper(F.split_part("url", F.lit("/"), F.lit(3))), F.lit(" ")).alias("url"))
    return search.distinct_feed(feed, "url", "page_id")


@query("u1_supported_extensions", f"""WITH {FILES} SELECT DISTINCT extension FROM (SELECT extension FROM files WHERE language = 'en' UNION SELECT extension FROM files WHERE status = 'indexed')""")
def _(t: Tables):
    files = t.files()
    return files.filter("language = 'en'").select("extension").union(files.filter("status = 'indexed'").select("extension")).distinct()


@query("rt7_first_chunks", """WITH l AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)
  SELECT file_id, string_agg(content, chr(10) || '---' || chr(10) ORDER BY idx) AS initial_content FROM l WHERE idx < 3 GROUP BY file_id""")
def _(t: Tables):
    return search.first_chunks(t.docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("idx", "content")))


CLAIMS = """sources AS (SELECT conv_id AS "group", row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, conv_id * 1000 + turn AS source_id FROM conversations WHERE role = 'user'),
  n AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n_sources FROM conversations GROUP BY 1),
  claims AS (SELECT c.conv_id * 1000 + turn AS claim_id, c.conv_id AS "group", text, [turn, turn - 2, turn, 0, 99] AS ids, length(text) > 300 AS verified, n_sources FROM conversations c JOIN n USING (conv_id) WHERE role = 'assistant')"""


def claim_tables(t: Tables):
    conv = t.conversations
    users = conv.filter("role = 'user'")
    ordinal = number_rows(users.select("conv_id", "turn"), ["conv_id"], F.floor(F.col("turn") / 1000), ["turn"], name="ordinal")
    sources = ordinal.select(F.col("conv_id").alias("group"), "ordinal", (F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"))
    n = conv.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_sources"))
    claims = conv.filter("role = 'assistant'").join(n, "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.col("conv_id").alias("group"), "text",
        F.array("turn", F.col("turn") - 2, "turn", F.lit(0), F.lit(99)).alias("evidence_ids"), (F.length("text") > 300).alias("verified"), "n_sources")
    return claims, sources


@query("j13_link_claims", f"""WITH {CLAIMS}, w AS (SELECT DISTINCT claim_id, "group", unnest(ids) AS ordinal FROM claims) SELECT claim_id, ordinal, source_id FROM w JOIN sources USING ("group", ordinal)""")
def _(t: Tables):
    return search.link_claims(*claim_tables(t)).select("claim_id", "ordinal", "source_id")


@query("j13_checked_claims", f"""WITH {CLAIMS}, v AS (SELECT claim_id, verified, list_sort(list_distinct(list_filter(ids, lambda i: i > 0 AND i <= n_sources))) AS ids FROM claims WHERE length(trim(text)) > 0)
  SELECT claim_id, array_to_string(ids, ',') AS evidence_ids, verified AND len(ids) > 0 AS verified FROM v""")
def _(t: Tables):
    claims, _ = claim_tables(t)
    out = search.checked_claims(claims)
    return out.select("claim_id", F.array_join(F.array_sort("evidence_ids").cast("array<string>"), ",").alias("evidence_ids"), "verified")


@query("w11_random_sample", "SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 100")
def _(t: Tables):
    return hashed_sample(t.documents.select("doc_id", "source"), "doc_id", 100, seed=42)


@query("w7_positional_confidence", f"""WITH {FILES}, r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, id) AS rank FROM files)
  SELECT id, category, rank, least(99, greatest(70, 100 - (rank - 1) * 3)) AS shown FROM r WHERE rank <= 20""")
def _(t: Tables):
    ranked = top_k_per(t.files().select("id", "category", "confidence"), ["category"], [F.desc("confidence"), F.col("id")], 20)
    return ranked.select("id", "category", "rank", scoring.positional_confidence(F.col("rank") - 1).alias("shown"))
