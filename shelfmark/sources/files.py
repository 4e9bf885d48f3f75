"""File jobs: inventories, manifests, texts, mails, archives, subtitles, GeoJSON, line patterns."""

from __future__ import annotations

import email
import email.policy
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.binary import file_health, file_type
from ..functions.lookup import base_name, suffix


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files under a root, as path, modificationTime, length and content. Content is only read when a
    later step asks for it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, name, extension, size, time and depth of every file outside ignored and dot folders."""
    files = read_files(spark, root).select(plain_path(F.col("path")).alias("path"), "modificationTime", "length")
    below = F.substr("path", F.lit(len(root.rstrip("/")) + 2))
    folders = F.slice(F.split(below, "/"), F.lit(1), F.size(F.split(below, "/")) - 1)
    skipped = F.exists(folders, lambda d: d.isin(V.IGNORED_DIRS) | d.startswith("."))
    return files.filter(~skipped).select(
        "path", base_name(F.col("path")).alias("filename"), suffix(F.col("path")).alias("extension"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_ts"), F.size(folders).alias("depth"))


def hash_manifest(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Path, size, time and SHA-256; files already hashed in the previous manifest are left out, failed
    ones (null hash) are tried again."""
    if previous is not None:
        done = previous.filter(F.col("hash").isNotNull()).select("path")
        files = files.join(done, "path", "left_anti")
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_ts"),
                        F.sha2("content", 256).alias("hash"))


def merge_manifests(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per path; hashed rows win over failed ones, fresh over old."""
    both = previous.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)))
    row = F.struct("size_bytes", "modified_ts", "hash")
    best = both.groupBy("path").agg(F.max_by(row, F.struct(F.col("hash").isNotNull(), "_v")).alias("_r"))
    return best.select("path", "_r.*")


def read_texts(spark: SparkSession, root: str, longer_than: int = 50) -> DataFrame:
    """Whole text files (path, text) that hold more than ``longer_than`` characters after trimming."""
    texts = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    named = texts.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    return named.filter(F.length(F.trim("text")) > longer_than)


def detected(files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Files with detected type and health; ``members`` (path, names, ok) come from the archive manifest."""
    ext = suffix(F.col("path"))
    if members is None:
        return files.withColumn("type", file_type(F.col("content"), ext)).withColumn("check", file_health(F.col("content"), F.col("length"), ext))
    joined = files.join(members, "path", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return (joined.withColumn("type", file_type(F.col("content"), ext, names))
            .withColumn("check", file_health(F.col("content"), F.col("length"), ext, F.col("ok"))).drop("names", "ok"))


MAIL = "path string, subject string, sender string, recipient string, sent string, body string, attachments int, error string"


def mails(files: DataFrame) -> DataFrame:
    """One row per mail file: headers, first plain-text part, number of attachments."""
    def one(path: str, content: bytes) -> dict:
        row = {"path": path, "subject": None, "sender": None, "recipient": None, "sent": None, "body": None, "attachments": 0, "error": None}
        try:
            message = email.message_from_bytes(content, policy=email.policy.default)
            for field, header in (("subject", "Subject"), ("sender", "From"), ("recipient", "To"), ("sent", "Date")):
                row[field] = str(message[header]) if message[header] is not None else ""
            part = message.get_body(("plain",))
            row["body"] = part.get_content() if part is not None else ""
            row["attachments"] = sum(1 for _ in message.iter_attachments())
        except Exception as problem:  # a broken mail must not fail the job
            row["error"] = type(problem).__name__
        return row

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(p, c) for p, c in zip(batch["path"], batch["content"])], columns=[c.split()[0] for c in MAIL.split(", ")])

    return files.select("path", "content").mapInPandas(read, MAIL)


MEMBER = "path string, member string, size long, packed long, is_dir boolean, ok boolean"


def archive_members(files: DataFrame) -> DataFrame:
    """One row per member of ZIP and TAR archives, read from their directories without unpacking; an
    unreadable archive gives one row with ``ok`` false."""
    def rows(path: str, content: bytes) -> Iterator[tuple]:
        data = io.BytesIO(content)
        try:
            if zipfile.is_zipfile(data):
                for m in zipfile.ZipFile(data).infolist():
                    yield path, m.filename, m.file_size, m.compress_size, m.is_dir(), True
                return
            data.seek(0)
            with tarfile.open(fileobj=data, mode="r:*") as tar:
                for t in tar:
                    yield path, t.name, t.size, t.size, t.isdir(), True
        except Exception:
            yield path, None, None, None, None, False

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [row for p, c in zip(batch["path"], batch["content"]) for row in rows(p, c)]
            yield pd.DataFrame(found, columns=["path", "member", "size", "packed", "is_dir", "ok"]).astype(
                {"size": "Int64", "packed": "Int64", "is_dir": "boolean", "ok": "boolean"})

    return files.select("path", "content").mapInPandas(read, MEMBER)


def archive_summary(members: DataFrame, preview: int = 100) -> DataFrame:
    """Per archive: files, sizes, compression ratio and the first names."""
    from ..operators.grouping import top_k_per

    rows = members.filter(F.col("ok") & ~F.col("is_dir"))
    names = top_k_per(rows, ["path"], [F.col("member")], preview).groupBy("path").agg(
        F.array_sort(F.collect_list("member")).alias("preview"))
    totals = members.groupBy("path").agg(
        F.count_if(F.col("ok") & ~F.col("is_dir")).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("packed"), F.lit(0)).alias("packed_size"), F.bool_and("ok").alias("ok"))
    ratio = F.round(1 - F.col("packed_size") / F.greatest(F.lit(1), F.col("total_size")), 2)
    return totals.withColumn("compression_ratio", ratio).join(names, "path", "left")


def member_names(members: DataFrame) -> DataFrame:
    """Names and readability per archive, for type detection; only names that decide a type are kept."""
    wanted = F.exists(F.array(*[F.lit(part) for part, _, _ in V.ZIP_MEMBERS]), lambda p: F.col("member").contains(p))
    return members.groupBy("path").agg(F.collect_set(F.when(wanted, F.col("member"))).alias("names"), F.bool_and("ok").alias("ok"))


CUE = r"(?s)^([0-9]+)\n([0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})\s*-->\s*([0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})\n(.*)$"


def subtitle_cues(texts: DataFrame) -> DataFrame:
    """One row per cue of SRT texts (path, text)."""
    unix = F.regexp_replace(F.regexp_replace("text", "^\\x{FEFF}", ""), r"\r\n?", "\n")
    pieces = texts.select("path", F.posexplode(F.split(unix, r"\n*(?:^|\n)(?=[0-9]+\n[0-9]{2}:[0-9]{2}:[0-9]{2},)")).alias("pos", "piece"))
    cue = pieces.filter(F.col("piece").rlike(CUE))
    said = F.trim(F.regexp_replace(F.get(F.split(F.regexp_extract("piece", CUE, 4), r"\n[0-9]+\n"), F.lit(0)), r"^\s+|\s+$", ""))
    return cue.select("path", F.regexp_extract("piece", CUE, 1).cast("int").alias("number"), F.regexp_extract("piece", CUE, 2).alias("start"),
                      F.regexp_extract("piece", CUE, 3).alias("end"), said.alias("text"), "pos")


def subtitle_summary(cues: DataFrame) -> DataFrame:
    """Per file: cues, first and last time, words, and the text in order."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    counted = cues.groupBy("path").agg(F.count("*").alias("cues"), F.min_by("start", "pos").alias("first_time"), F.max_by("end", "pos").alias("last_time"),
                                       F.sum(words).alias("words"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t"))
    return counted.select("path", "cues", "first_time", "last_time", "words", F.array_join(F.col("_t.text"), " ").alias("text"))


GEO = "type string, features array<struct<type:string,geometry:struct<type:string>>>"


def geojson_summary(texts: DataFrame) -> DataFrame:
    """Feature count and sorted distinct geometry types of GeoJSON texts (path, text)."""
    parsed = texts.select("path", F.from_json("text", GEO).alias("g"))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform("g.features", lambda f: f["geometry"]["type"]), lambda k: k.isNotNull())))
    return parsed.select("path", F.greatest(F.size("g.features"), F.lit(0)).alias("feature_count"), kinds.alias("geometry_types"))


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of text assets with their file."""
    lines = spark.read.option("recursiveFileLookup", True).text(root)
    return lines.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("line"))


def line_patterns(lines: DataFrame) -> DataFrame:
    """Vertex and face lines of mesh texts and the schema named in step texts, per file."""
    schema = F.regexp_extract("line", r"FILE_SCHEMA\s*\([\s(]*'?([^'()]+)", 1)
    return lines.groupBy("path").agg(
        F.count_if(F.col("line").startswith("v ")).alias("vertices"), F.count_if(F.col("line").startswith("f ")).alias("faces"),
        F.max(F.when(schema != "", schema)).alias("schema"))
