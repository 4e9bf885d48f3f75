"""Web archives in ZIP packages: written as Spark tasks, read back by ranges.

A package holds two stored members, `archive/data.warc.gz` (one gzip member per WARC record) and `indexes/index.cdxj` (one line per record with
offset and length). The reader looks at a package's end and central directory (ZIP64 too), takes the places of the stored members from there,
reads the index by its range and then each record by its own: nothing is extracted and no package is read whole.

Packages lie in a folder that all executors reach; pyarrow opens it by its URI. A task writes under a new name and reports it in the manifest,
which is a Spark table: what a lost or repeated task left behind is in no manifest and never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import new_path, write_table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads below this many bytes are never replaced by a reference.
LEAST_REVISIT = 100
#: A task begins a new package beyond this many bytes.
PACKAGE_BYTES = 256 << 20
#: Bytes of one read of a directory or an index, and the range of records that one task opens together.
CHUNK, RANGE = 1 << 20, 32 << 20
DATE = "2000-01-01T00:00:00Z"
END, LOCATOR64, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
MANIFEST = "package string, n_records bigint, bytes bigint"
RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, "
          "package string, offset bigint, length bigint")


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


# writing

def revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest page_id with an equal payload of at least 100 bytes, null for that page and
    for shorter payloads. Rows that repeat the smallest page_id are all responses; null ids are never the smallest."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1 AND first IS NOT NULL").drop("n"))
    refers_to = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))


def record_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose length is that of the payload it stands for."""
    own = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {url}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URI)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Printable ASCII but the percent sign, so that any text survives as a header.
_URI = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Sink:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, stream):
        self.stream, self.size = stream, 0

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def write_package(stream, records: Iterable[tuple[str, bytes]], limit: int = PACKAGE_BYTES) -> tuple[int, int]:
    """Write (url, record) pairs until `limit` bytes are reached or there are no more; number of records and bytes."""
    sink, lines = _Sink(stream), []
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
        with package.open(ARCHIVE, "w", force_zip64=True) as member:
            offset = 0
            for url, record in records:
                packed = gzip.compress(record, 6, mtime=0)
                member.write(packed)
                lines.append((url, json.dumps({"url": url, "offset": str(offset), "length": str(len(packed)), "filename": ARCHIVE.partition("/")[2]})))
                offset += len(packed)
                if offset >= limit:
                    break
        with package.open(INDEX, "w", force_zip64=True) as member:
            for url, line in sorted(lines):
                member.write(f"{quote(url, safe=_URI)} {DATE[:4]}0101000000 {line}\n".encode())
    return len(lines), sink.size


def _write_task(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    store, path = open_store(folder)

    def records() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(c)[row].as_py() for c in range(5))
                yield url or "", record_of(page_id, url, payload, digest, refers_to)

    rest = records()
    first = next(rest, None)
    while first is not None:
        name = f"{path}/{uuid.uuid4().hex}.wacz"
        with store.open_output_stream(name) as stream:
            n, size = write_package(stream, chain((first,), rest), limit)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["package", "n_records", "bytes"])
        first = next(rest, None)


def write_packages(pages: DataFrame, folder: str, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Write rows (page_id, url, payload, digest, refers_to) to packages in `folder`; the manifest (package, n_records, bytes) as a table. An empty
    table writes no package."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    rows = pages.select("page_id", "url", "payload", "digest", "refers_to")
    return write_table(rows.mapInArrow(lambda batches: _write_task(batches, folder, limit), MANIFEST)).frame


# reading

def directory_of(file, size: int) -> tuple[int, int, int]:
    """Number of entries, offset and size of the central directory, from the end record or, where that overflows, its ZIP64 form."""
    tail_size = min(size, 22 + 0xFFFF)
    tail = file.read_at(tail_size, size - tail_size)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP end record")
    _, _, _, count, length, offset = struct.unpack("<HHHHII", tail[at + 4:at + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        place = size - tail_size + at - 20
        locator = file.read_at(20, place) if place >= 0 else b""
        if locator[:4] == LOCATOR64:
            record = file.read_at(56, int.from_bytes(locator[8:16], "little"))
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, offset = struct.unpack("<QQQ", record[32:56])
    return count, offset, length


def members_of(file, size: int) -> Iterator[dict[str, Any]]:
    """name, method, size and data offset of the members, in the directory's order; the directory is read in chunks."""
    count, offset, length = directory_of(file, size)
    buffer, read = b"", 0

    def need(n: int) -> None:
        nonlocal buffer, read
        while len(buffer) < n and read < length:
            more = file.read_at(min(max(CHUNK, n - len(buffer)), length - read), offset + read)
            read += len(more)
            buffer += more
        if len(buffer) < n:
            raise ValueError("the central directory ends early")

    for _ in range(count):
        need(46)
        if buffer[:4] != ENTRY:
            raise ValueError("not an entry of a central directory")
        flags, method = struct.unpack("<HH", buffer[8:12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", buffer[20:34])
        header = int.from_bytes(buffer[42:46], "little")
        need(46 + n_name + n_extra + n_comment)
        name = buffer[46:46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = buffer[46 + n_name:46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: only the fields that overflow, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        buffer = buffer[46 + n_name + n_extra + n_comment:]
        local = file.read_at(30, header)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        yield {"name": name, "method": method, "size": packed, "offset": header + 30 + sum(struct.unpack("<HH", local[26:30]))}


def index_lines(file, offset: int, size: int) -> Iterator[dict[str, Any]]:
    """The JSON parts of an index, read in chunks."""
    rest, read = b"", 0
    while read < size:
        more = file.read_at(min(CHUNK, size - read), offset + read)
        if not more:
            raise ValueError("the index ends early")
        read += len(more)
        *lines, rest = (rest + more).split(b"\n")
        for line in lines:
            yield json.loads(line[line.index(b" {") + 1:])
    if rest:
        yield json.loads(rest[rest.index(b" {") + 1:])


def _locate(batches: Iterator[pa.RecordBatch], folder: str, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    store, _ = open_store(folder)
    names = ["package", "offset", "length"]
    for batch in batches:
        for package in batch.column("package").to_pylist():
            with store.open_input_file(package) as file:
                # directories and members that are not stored are of no use for range reads
                members = {m["name"]: m for m in members_of(file, file.size()) if m["method"] == 0}
                found: list[tuple[int, int]] = []
                for name, member in members.items():
                    if not name.startswith("indexes/"):
                        continue
                    for line in index_lines(file, member["offset"], member["size"]):
                        archive = members.get("archive/" + line["filename"])
                        if archive is None:
                            raise ValueError(f"{package}: member archive/{line['filename']} is missing or not stored, its records cannot be read by range")
                        found.append((archive["offset"] + int(line["offset"]), int(line["length"])))
                        if len(found) >= rows:
                            yield pa.RecordBatch.from_arrays([pa.array([package] * len(found)), *map(pa.array, zip(*found))], names)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([package] * len(found)), *map(pa.array, zip(*found))], names)


def parse_record(data: bytes) -> dict[str, Any]:
    """Fields of one WARC record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    sizes = [int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    digest = fields["warc-payload-digest"].partition(":")[2]
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    page = lambda name: int(fields[name][10:-1]) if fields.get(name, "").startswith("<urn:page:") else None
    url = fields.get("warc-target-uri")
    return {"page_id": page("warc-record-id"), "url": None if url is None else unquote(url), "record_type": kind, "refers_to": page("warc-refers-to"),
            "payload_bytes": sizes[0] if sizes else len(body), "payload_digest": digest, "payload": body if kind == "response" else None}


def _read(batches: Iterator[pa.RecordBatch], folder: str, schema: pa.Schema, rows: int = 256) -> Iterator[pa.RecordBatch]:
    store, _ = open_store(folder)
    package, file = None, None
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            out = []
            for row in batch.slice(start, rows).to_pylist():
                if row["package"] != package:
                    if file is not None:
                        file.close()
                    package = row["package"]
                    file = store.open_input_file(package)
                record = gzip.decompress(file.read_at(row["length"], row["offset"]))
                out.append(parse_record(record) | {k: row[k] for k in ("package", "offset", "length")})
            yield pa.RecordBatch.from_pylist(out, schema)
    if file is not None:
        file.close()


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("payload", pa.binary()), ("package", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def locate_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(package, offset, length) of every record in the packages of column `package`. A package whose index names an archive that is missing or compressed
    raises ValueError with both names."""
    return manifest.select("package").mapInArrow(lambda batches: _locate(batches, folder), "package string, offset bigint, length bigint")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """The records at (package, offset, length), in as many tasks as the records have ranges of 32 MB, so that one large package is read by many."""
    stored = write_table(places).frame
    size = stored.agg(F.sum("length")).first()[0] or 0
    dealt = stored.repartitionByRange(max(1, -(-size // RANGE)), "package", "offset").sortWithinPartitions("package", "offset")
    return dealt.mapInArrow(lambda batches: _read(batches, folder, _ARROW), RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page as a WARC record and read all records back. Null html is an empty payload; null urls and ids stay null; repeated rows
    give repeated records; other columns are ignored; an empty table gives no records."""
    folder = folder or new_path(pages.sparkSession, "warc")
    manifest = write_packages(revisits(pages, page_id, url, html), folder)
    return read_records(locate_records(manifest, folder), folder)
