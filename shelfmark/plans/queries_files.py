"""Checked queries over file sources. Their files and bytes are derived from the driver tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binary import file_health, file_type
from ..sources import files, tables as table_sources
from ..streaming.jobs import drain_to_index, run_folder, watch_inbox
from .queries_ledger import rounded
from .registry import query
from .tables import FILES, INVENTORY, Tables

# --- bytes ------------------------------------------------------------------------------------

HEADERS = [b"%PDF-1.4\n", b"\xff\xd8\xff\xe0", b"PK\x03\x04", b"RIFF\x00\x00\x00\x00WAVE", b"\x00\x00\x00\x18ftypqt  ", b""]
KINDS = ["pdf", "jpg", "zip", "wav", "mov", ""]


def signature(n: Column) -> Column:
    """One of the file signatures in turn."""
    return F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (n % 6 + 1).cast("int"))


def byte_files(t: Tables) -> DataFrame:
    """Every document as bytes behind one of several file signatures; some PDFs are cut or encrypted."""
    tail = F.when(F.col("lang") == "en", "%%EOF").when(F.col("lang") == "de", "/Encrypt %%EOF").otherwise("")
    content = F.concat(signature(F.col("n_chars")), F.col("text").cast("binary"), tail.cast("binary"))
    return t.docs.select(F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "doc_id", content.alias("content"),
                         F.length(content).cast("bigint").alias("length"), F.timestamp_seconds(F.col("doc_id")).alias("modificationTime"))


@query("c20_file_types", f"""SELECT doc_id, CASE n_chars % 6 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS[:5]))} ELSE 'pdf' END AS kind,
  CASE n_chars % 6 WHEN 3 THEN 'container' WHEN 4 THEN 'container' WHEN 5 THEN 'extension' ELSE 'magic' END AS method FROM documents""")
def _(t: Tables):
    typed = byte_files(t).select("doc_id", file_type(F.col("content"), F.lit(".pdf")).alias("t"))
    return typed.select("doc_id", F.col("t.extension").alias("kind"), "t.method")


@query("c21_file_health", """WITH c AS (SELECT doc_id, n_chars % 6 <> 0 AS no_head, lang = 'de' AS enc, lang NOT IN ('en', 'de') AS cut FROM documents)
  SELECT doc_id, NOT (no_head OR enc OR cut) AS valid, array_to_string(list_filter([CASE WHEN no_head THEN 'PDF_INVALID_HEADER' END, CASE WHEN enc THEN 'PDF_ENCRYPTED' END, CASE WHEN cut THEN 'PDF_TRUNCATED' END], lambda x: x IS NOT NULL), ',') AS errors,
    CASE WHEN no_head OR enc OR cut THEN 'corrupted' ELSE 'healthy' END AS health FROM c""")
def _(t: Tables):
    checked = byte_files(t).select("doc_id", file_health(F.col("content"), F.col("length"), F.lit(".pdf")).alias("h"))
    return checked.select("doc_id", "h.valid", F.array_join("h.errors", ",").alias("errors"), "h.health")


@query("s19_hash_manifest", """SELECT '/in/' || source || '/' || doc_id || '.pdf' AS path, sha256(text) AS hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(t: Tables):
    every = byte_files(t).drop("content").join(t.docs.select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id")
    done = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.when(F.col("quality") == 1, "known").alias("hash"))
    return files.hash_manifest(every, done).select("path", "hash")


@query("s9_mails", """SELECT '/mail/' || conv_id || '-' || turn || '.eml' AS path, 'Turn ' || turn AS subject, role || '@example.com' AS sender, length(text) AS n_body, 0 AS attachments FROM conversations""")
def _(t: Tables):
    raw = F.concat(F.lit("From: "), "role", F.lit("@example.com\nTo: x@example.com\nSubject: Turn "), F.col("turn").cast("string"),
                   F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text")
    path = F.concat(F.lit("/mail/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".eml"))
    read = files.mails(t.conversations.select(path.alias("path"), raw.cast("binary").alias("content")))
    return read.select("path", "subject", "sender", F.length("body").alias("n_body"), "attachments")


# --- texts ------------------------------------------------------------------------------------

STAMP = "'00:' || lpad(CAST({0} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') || ',000'"


def stamp(seconds):
    return F.concat(F.lit("00:"), F.lpad(F.floor(seconds / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit(",000"))


def subtitle_texts(t: Tables) -> DataFrame:
    """Conversations as SRT texts, one file per conversation."""
    at = F.col("turn") * 7
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\r\n"), stamp(at), F.lit(" --> "), stamp(at + 6), F.lit("\r\n"), "text", F.lit("\r\n"))
    packed = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    return packed.select(F.concat(F.lit("/srt/"), F.col("conv_id").cast("string")).alias("path"), F.array_join(F.col("c.cue"), "\r\n").alias("text"))


@query("s11_subtitle_cues", f"""SELECT '/srt/' || conv_id AS path, CAST(turn + 1 AS INT) AS number, {STAMP.format('(turn * 7)')} AS start, {STAMP.format('(turn * 7 + 6)')} AS "end", length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n_text FROM conversations""")
def _(t: Tables):
    return files.subtitle_cues(subtitle_texts(t)).select("path", "number", "start", "end", F.length("text").alias("n_text"))


@query("s11_subtitle_summary", f"""SELECT '/srt/' || conv_id AS path, count(*) AS cues, {STAMP.format('(min(turn) * 7)')} AS first_time, {STAMP.format('(max(turn) * 7 + 6)')} AS last_time,
  sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM conversations GROUP BY conv_id""")
def _(t: Tables):
    return files.subtitle_summary(files.subtitle_cues(subtitle_texts(t))).drop("text")


@query("s12_geojson", """SELECT '/geo/' || n_regionkey AS path, count(*) AS feature_count, string_agg(DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'Point' ELSE 'Polygon' END, ',' ORDER BY CASE WHEN n_nationkey % 2 = 0 THEN 'Point' ELSE 'Polygon' END) AS kinds FROM nation GROUP BY n_regionkey""")
def _(t: Tables):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "Point").otherwise("Polygon")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("type")).alias("geometry"), F.struct(F.col("n_name").alias("name")).alias("properties"))
    texts = t.nation.groupBy("n_regionkey").agg(F.collect_list(feature).alias("features")).select(
        F.concat(F.lit("/geo/"), F.col("n_regionkey").cast("string")).alias("path"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("text"))
    return files.geojson_summary(texts).select("path", F.col("feature_count").cast("bigint").alias("feature_count"), F.array_join("geometry_types", ",").alias("kinds"))


@query("s13_line_patterns", """WITH l AS (SELECT '/txt/' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, lang FROM documents)
  SELECT path, count(*) FILTER (lang = 'en') AS vertices, count(*) FILTER (lang = 'de') AS faces, max(CASE WHEN lang = 'fr' THEN 'AP203' END) AS schema FROM l GROUP BY path""")
def _(t: Tables):
    mark = F.when(F.col("lang") == "en", "v ").when(F.col("lang") == "de", "f ").when(F.col("lang") == "fr", "FILE_SCHEMA(('AP203'));").otherwise("#")
    lines = t.docs.select(F.concat(F.lit("/txt/"), F.col("doc_id").cast("string")).alias("path"), mark.alias("m"), F.explode(F.split("text", "\n")).alias("line"))
    return files.line_patterns(lines.select("path", F.concat("m", "line").alias("line")))


# --- written and read back --------------------------------------------------------------------


@query("s1_file_inventory", "SELECT '.txt' AS extension, 1 AS depth, count(DISTINCT source) AS files FROM documents")
def _(t: Tables):
    folder = run_folder(t.spark)
    t.documents.select("source", "text").repartition("source").write.partitionBy("source").text(f"{folder}/tree")
    found = files.inventory(t.spark, files_root(folder) + "/tree")
    return found.groupBy("extension", "depth").agg(F.count("*").alias("files"))


@query("st10_inbox", "SELECT source, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents GROUP BY source")
def _(t: Tables):
    folder = run_folder(t.spark)
    t.documents.select("source", "text").repartition("source").write.partitionBy("source").text(f"{folder}/inbox")

    def prepare(batch: DataFrame) -> DataFrame:
        return batch.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.length("content").cast("bigint").alias("bytes"))

    drain_to_index(watch_inbox(t.spark, f"{folder}/inbox"), t.spark, f"{folder}/index", f"{folder}/state", prepare)
    return t.spark.read.parquet(f"{folder}/index").select("source", "bytes")


def files_root(folder: str) -> str:
    return folder.replace("file:", "") if folder.startswith("file:") else folder


@query("s2_inventory_csv", f"""WITH {INVENTORY} SELECT path, filename, CASE WHEN extension = '.bak' THEN '[no_extension]' ELSE extension END AS extension,
  CASE WHEN extension = '.zip' THEN 0.0::DOUBLE ELSE round(size_mb, 4) END AS size_mb, depth FROM inventory""")
def _(t: Tables):
    folder = run_folder(t.spark)
    ext = F.col("extension")
    written = t.inventory().select(F.col("path").alias("Path"), F.col("filename").alias("Filename"), F.when(ext != ".bak", F.upper(ext)).alias("Extension"),
                                   F.when(ext == ".zip", "n/a").otherwise(F.col("size_mb").cast("string")).alias("Size_MB"), F.col("depth").alias("Depth"))
    written.write.option("header", True).csv(f"{folder}/index")
    return rounded(table_sources.read_inventory_csv(t.spark, f"{folder}/index"), "size_mb", digits=4)


@query("s4_json_table", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(t: Tables):
    folder = run_folder(t.spark)
    row = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    grouped = t.customer.groupBy(F.floor(F.col("c_custkey") / 500).alias("g")).agg(F.collect_list(row).alias("data"))
    grouped.select(F.to_json(F.struct("data")).alias("value")).write.text(f"{folder}/json")
    return table_sources.read_json_lines(t.spark, f"{folder}/json", "data array<struct<id:bigint,name:string>>").select(F.explode("data").alias("r")).select("r.*")


@query("s5_query_set", "SELECT CAST(item_id AS VARCHAR) AS id, text AS query, 1 AS expected FROM benchmark")
def _(t: Tables):
    folder = run_folder(t.spark)
    rows = t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.lit("text").alias("modality"), F.col("text").alias("query"),
                              F.array(F.col("item_id").cast("string")).alias("expected_ids"))
    rows.write.json(f"{folder}/set")
    return table_sources.read_query_set(t.spark, f"{folder}/set").select("id", "query", F.size("expected_ids").alias("expected"))


ARCHIVE_ROWS = 500


@query("s10_archive_members", f"""WITH {FILES}, m AS (SELECT author || '-' || (id // 500) AS path, original_filename AS member FROM files)
  SELECT path, count(*) AS files, sum(length(member))::BIGINT AS total_size, true AS ok FROM m GROUP BY path""")
def _(t: Tables):
    named = t.files().select(F.concat("author", F.lit("-"), F.floor(F.col("id") / ARCHIVE_ROWS).cast("string")).alias("path"), "original_filename")
    packed = named.groupBy("path").applyInPandas(pack, "path string, content binary")  # at most ARCHIVE_ROWS names each
    return files.archive_summary(files.archive_members(packed)).select("path", "files", "total_size", "ok")


def pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A ZIP with one small member per file name, to have archives to list."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in rows["original_filename"]:
            z.writestr(name, name)
    return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [data.getvalue()]})
