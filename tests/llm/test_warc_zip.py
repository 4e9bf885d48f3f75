import gzip
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from shelfmark.llm import warc_zip as wz


class File:
    """bytes with the two calls of a pyarrow file, counting what is read"""

    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += n
        return self.data[at:at + n]

    def size(self):
        return len(self.data)


def test_round_trip(spark, tmp_path):
    big, small = "<p>é</p>" * 30, "short"
    rows = [(5, "u5", big), (2, "u2", big), (9, None, big), (3, "u3", small), (4, "u4", small), (6, "a\r\nX-Evil: 1 %41 ü", None), (None, "n", big), (None, None, "z"),
            (7, "u7", ""), (2, "u2", big), (8, "u8", "x" * 100), (10, "u10", "x" * 100), (11, "u", "y" * 99), (12, "u", "y" * 99), (13, "long", "w" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id bigint, url string, html string, digest string").repartition(4)
    got = wz.round_trip(pages, str(tmp_path / "w")).collect()
    want = []
    for page, url, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == body]
        refers = min(same) if len(body) >= 100 and same and min(same) != page else None
        want.append((page, url, "response" if refers is None else "revisit", refers, len(body), hashlib.sha256(body).hexdigest(), body if refers is None else None))
    assert sorted(map(str, [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got])) == sorted(map(str, want))
    assert wz.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0


def package(records, limit=wz.PACKAGE_BYTES):
    out = io.BytesIO()
    wz.write_package(out, iter(records), limit)
    return out.getvalue()


def test_package_is_a_plain_zip_and_is_read_by_ranges():
    records = [(f"u{i}", wz.record_of(i, f"u{i}", bytes(2000), hashlib.sha256(bytes(2000)).hexdigest(), None)) for i in range(300)]
    data = package(records)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == [wz.ARCHIVE, wz.INDEX]
        assert gzip.decompress(z.read(wz.ARCHIVE)) == b"".join(r for _, r in records)
    file = File(data)
    members = {m["name"]: m for m in wz.members_of(file, file.size())}
    lines = list(wz.index_lines(file, members[wz.INDEX]["offset"], members[wz.INDEX]["size"]))
    assert len(lines) == 300
    line = lines[17]
    record = gzip.decompress(file.read_at(int(line["length"]), members[wz.ARCHIVE]["offset"] + int(line["offset"])))
    assert wz.parse_record(record)["url"] == line["url"]
    with pytest.raises(ValueError):
        wz.parse_record(record.replace(b"\0\0\r\n\r\n", b"\0\1\r\n\r\n"))


def test_zip64_directories_and_comments(monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):  # more entries than the plain end record can count
            z.writestr(f"m{i}", b"" if i % 1000 else f"data {i}")
        z.comment = b"a comment with PK\x05\x06 inside" + bytes(18)
    file = File(out.getvalue())
    assert b"PK\x06\x06" in out.getvalue()
    monkeypatch.setattr(wz, "CHUNK", 5000)
    members = list(wz.members_of(file, file.size()))
    assert len(members) == 66_000
    m = members[3000]
    assert file.data[m["offset"]:m["offset"] + m["size"]] == b"data 3000"


def test_zip64_entry_sizes():
    """An entry whose sizes and offset stand in its ZIP64 field."""
    data = package([("u", wz.record_of(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None))])
    at = data.index(wz.ENTRY)
    plain = bytearray(data)
    count, offset, length = wz.directory_of(File(data), len(data))
    first = next(iter(wz.members_of(File(data), len(data))))
    n_name, n_extra = int.from_bytes(data[at + 28:at + 30], "little"), int.from_bytes(data[at + 30:at + 32], "little")
    field = b"\x01\x00\x18\x00" + first["size"].to_bytes(8, "little") * 2 + (0).to_bytes(8, "little")
    entry = bytearray(data[at:at + 46 + n_name]) + field
    entry[20:28] = b"\xff" * 8
    entry[30:32] = len(field).to_bytes(2, "little")
    entry[42:46] = b"\xff" * 4
    plain[at:at + 46 + n_name + n_extra] = entry
    grown = len(entry) - (46 + n_name + n_extra)
    end = bytes(plain).rindex(wz.END)
    plain[end + 12:end + 16] = (length + grown).to_bytes(4, "little")
    assert next(iter(wz.members_of(File(bytes(plain)), len(plain)))) == first


def test_broken_packages():
    for data in (b"", b"PK\x05\x06", b"no archive at all" * 10):
        with pytest.raises(ValueError):
            wz.directory_of(File(data), len(data))


def test_packages_roll_over(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " * 200) for i in range(50)], "page_id bigint, url string, html string").coalesce(1)
    folder = str(tmp_path / "r")
    manifest = wz.write_packages(wz.revisits(pages), folder, limit=1000)
    assert manifest.count() > 3 and manifest.agg({"n_records": "sum"}).first()[0] == 50
    assert sorted(r.page_id for r in wz.read_records(wz.locate_records(manifest, folder), folder).collect()) == list(range(50))


def test_compressed_archive_member_is_named(spark, tmp_path):
    """A stored index of a compressed archive: its records cannot be read by range, which the error says."""
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " * 200) for i in range(5)], "page_id bigint, url string, html string").coalesce(1)
    folder = tmp_path / "p"
    manifest = wz.write_packages(wz.revisits(pages), str(folder))
    path = manifest.select("package").first()[0]
    local = path.removeprefix("file:")
    with zipfile.ZipFile(local) as old:
        members = [(i, old.read(i)) for i in old.infolist()]
    other = str(tmp_path / "compressed.wacz")
    with zipfile.ZipFile(other, "w") as new:
        for info, data in members:
            new.writestr(info.filename, data, zipfile.ZIP_DEFLATED if info.filename.startswith("archive/") else zipfile.ZIP_STORED)
    changed = spark.createDataFrame([(other,)], "package string")
    with pytest.raises(Exception, match="compressed.wacz: member archive/.* is missing or not stored"):
        wz.locate_records(changed, str(folder)).collect()


def test_ranges_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wz, "RANGE", 500)
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} text " * 100) for i in range(60)], "page_id bigint, url string, html string").coalesce(1)
    manifest = wz.write_packages(wz.revisits(pages), str(tmp_path / "r"))
    records = wz.read_records(wz.locate_records(manifest, str(tmp_path / "r")), str(tmp_path / "r"))
    assert manifest.count() == 1 and records.rdd.getNumPartitions() > 8 and records.count() == 60
