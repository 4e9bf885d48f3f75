"""File and table sources on files written by the tests."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import files, tables


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in {
        "a/report.pdf": b"%PDF-1.4 body %%EOF", "a/.hidden/x.txt": b"hidden", "node_modules/y.txt": b"skip", "b/c/note.txt": b"n" * 60,
        "b/mail.eml": b"From: a@x.de\nTo: b@y.de\nSubject: Hallo\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nContent-Type: text/plain\n\nBody text\n",
        "b/sub.srt": "\ufeff1\r\n00:00:01,000 --> 00:00:02,000\r\nHi there\r\nyou\r\n\r\n2\r\n00:00:03,500 --> 00:00:04,000\r\nBye\r\n".encode(),
        "b/map.geojson": json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}]}).encode(),
        "b/mesh.obj": b"v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\n", "b/part.step": b"ISO-10303-21;\nFILE_SCHEMA(('AP203'));\n",
        "b/bad.zip": b"PK\x03\x04broken",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    with zipfile.ZipFile(root / "b/doc.docx", "w") as z:
        z.writestr("word/document.xml", "x" * 1000)
        z.writestr("[Content_Types].xml", "y")
    with tarfile.open(root / "b/pack.tar", "w") as t:
        info = tarfile.TarInfo("inner.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    return str(root)


def test_inventory(spark, tree):
    rows = {r.filename: r for r in files.inventory(spark, tree).collect()}
    assert "x.txt" not in rows and "y.txt" not in rows
    assert (rows["note.txt"].depth, rows["note.txt"].extension, rows["note.txt"].size_bytes) == (2, ".txt", 60)


def test_manifest_resumes(spark, tree):
    every = files.read_files(spark, tree)
    first = files.hash_manifest(every).withColumn("hash", F.when(~F.col("path").endswith("note.txt"), F.col("hash")))
    again = files.hash_manifest(every, first)
    assert [r.path.endswith("note.txt") for r in again.collect()] == [True]
    assert files.merge_manifests(first, again).filter("hash IS NULL").isEmpty()


def test_mail(spark, tree):
    row = files.mails(files.read_files(spark, tree, "*.eml")).first()
    assert (row.subject, row.sender, row.recipient, row.body.strip(), row.attachments, row.error) == ("Hallo", "a@x.de", "b@y.de", "Body text", 0, None)


def test_archives_and_detection(spark, tree):
    both = files.read_files(spark, tree, "*.{docx,tar,zip}")
    members = files.archive_members(both)
    rows = {r.path.split("/")[-1]: r for r in files.archive_summary(members).collect()}
    assert (rows["doc.docx"].files, rows["pack.tar"].preview, rows["bad.zip"].ok) == (2, ["inner.txt"], False)
    typed = {r.path.split("/")[-1]: r for r in files.detected(both, files.member_names(members)).collect()}
    assert typed["doc.docx"].type["extension"] == "docx" and typed["bad.zip"].check["errors"] == ["ZIP_CORRUPTED"]


def test_subtitles(spark, tree):
    texts = spark.read.text(f"{tree}/b/sub.srt", wholetext=True).select(F.lit("sub").alias("path"), F.col("value").alias("text"))
    row = files.subtitle_summary(files.subtitle_cues(texts)).first()
    assert (row.cues, row.first_time, row.last_time, row.words) == (2, "00:00:01,000", "00:00:04,000", 4)


def test_geojson_and_lines(spark, tree):
    geo = files.read_texts(spark, f"{tree}/b/map.geojson", 0)
    row = files.geojson_summary(geo).first()
    assert (row.feature_count, row.geometry_types) == (1, ["Point"])
    mesh = files.line_patterns(files.read_lines(spark, f"{tree}/b/mesh.obj")).first()
    assert (mesh.vertices, mesh.faces) == (4, 1)
    assert files.line_patterns(files.read_lines(spark, f"{tree}/b/part.step")).first().schema == "AP203"


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,value,score\n1,a,10\n2,b,20\n3,c,30\n")
    (tmp_path / "t.json").write_text(json.dumps({"data": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "t.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "i.csv").write_text("Filename,Path,Extension,Size_MB,Depth\na,/a,,x,2\nb,/b,.PDF,1.5,y\n")
    row = tables.table_summary(tables.read_delimited(spark, str(tmp_path / "t.csv")), "t", 2).first()
    assert (row.row_count, row.column_count, len(row.preview), row.truncated) == (3, 3, 2, True)
    assert tables.read_json_table(spark, str(tmp_path / "t.json")).count() == 2
    assert tables.read_json_lines(spark, str(tmp_path / "t.jsonl"), "id long").count() == 2
    rows = {r.filename: (r.extension, r.size_mb, r.depth) for r in tables.read_inventory_csv(spark, str(tmp_path / "i.csv")).collect()}
    assert rows == {"a": ("[no_extension]", 0.0, 2), "b": (".pdf", 1.5, 0)}
