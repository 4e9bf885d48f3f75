"""Repeated passages of whole corpora, byte by byte, from a sorted table of suffixes.

A passage counts as repeated if its `length` bytes also start anywhere else. Not every suffix has to be sorted to find them. Let h = 3 * length // 4 and
q = length - h + 1. Every string of `length` bytes has h places at which q bytes fit; the place whose q bytes hash least (leftmost of equals) is its
anchor. Equal strings have their anchors at equal offsets, so it is enough to compare suffixes that start at anchors, with the h - 1 bytes before them: about
two of h + 1 places are anchors. Anchors whose q bytes occur once are left out.

1. Sampled splitters (a range partitioning by Spark) deal the suffixes out by their leading bytes: first q bytes, then the bytes before them
   read backwards, then the rest, then the place, so that equal suffixes in any number spread over several buckets.
2. A bucket sorts its suffixes by multikey quicksort on eight-byte words, and the bytes before them likewise. Common prefixes of neighbours give the
   rank of each suffix at every depth; two strings of `length` bytes around anchors are equal if both their ranks are.
3. Buckets are compared across their boundaries: a string can occur in another bucket only as far as its bytes agree with those of the first or
   last suffix of its own. Such strings go on as hashes of 128 bits, each once a bucket, and are counted over all buckets.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.tables import drop_table, write_table

LENGTH = 200
#: Bytes of suffixes in one bucket.
BUCKET_BYTES = 6 << 20
#: Places hashed at a time; the low bits of a key hold the place.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_TEXT = ["t1", "t2"]


def _reach(length: int) -> tuple[int, int]:
    """(h, q): a longer h gives fewer anchors with more bytes around each."""
    h = max(1, 3 * length // 4)
    return h, length - h + 1


# --- anchors

def _gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on: differences of running sums of byte values times powers of an odd base."""
    values = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data) - 1, _BASE, np.uint64))), dtype=np.uint64)
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data) - 1, pow(_BASE, -1, 1 << 64), np.uint64))), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * power, dtype=np.uint64)))
        out = (sums[q:] - sums[:-q]) * back[:len(data) - q + 1]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` keys from each place on."""
    reach, out = 1, keys
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the texts that lie end to end in `data` and stop at `ends`; a string never crosses an end."""
    h, q = _reach(length)
    starts_of = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    places, hashes = [], []
    for start in range(0, len(data) - length + 1, BLOCK):
        part = data[start:start + BLOCK + length - 1]
        grams = _gram_hashes(part, q)
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        least = (_least(keys, h) & _PLACE).astype(np.int64)  # per string, its anchor
        inside = np.zeros(len(least) + 1, np.int64)  # strings that lie in one text, as running sum of +1 and -1
        first, last = np.maximum(starts_of - start, 0), np.minimum(ends - length + 1 - start, len(least))
        some = last > first
        np.add.at(inside, first[some], 1)
        np.add.at(inside, last[some], -1)
        found = np.unique(least[np.cumsum(inside[:-1]) > 0])
        places.append(found + start)
        hashes.append(grams[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, at = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[at]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each row ends; a null has none."""
    texts = [t or b"" for t in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            data, ends = _bytes_of(batch.column("text"))
            place, grams = anchors(data, ends, length)
            row = np.searchsorted(ends, place, side="right")
            begins = np.concatenate((np.zeros(1, np.int64), ends))[row]
            yield pa.record_batch({"gram": pa.array(grams.view(np.int64)), "t1": batch.column("t1").take(pa.array(row)),
                                   "pos": pa.array((place - begins).astype(np.int32))})


# --- suffixes

_SUFFIX = "t1 bigint, t2 bigint, pos array<int>, q binary, before binary, rest binary"


def _suffix_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of each text at its shared anchors; equal ones of one text are one row with all their places."""
    h, q = _reach(length)
    for batch in batches:
        for n in range(batch.num_rows):
            text = batch.column("text")[n].as_py()
            seen: dict[tuple[bytes, bytes], list[int]] = {}
            for at in batch.column("places")[n].as_py():
                if 0 <= at <= len(text) - q:  # places of another text with the same short hash may lie outside
                    seen.setdefault((text[at:at + length], text[max(0, at - h + 1):at][::-1]), []).append(at)
            if seen:
                yield pa.record_batch({
                    "t1": pa.array([batch.column("t1")[n].as_py()] * len(seen), pa.int64()), "t2": pa.array([batch.column("t2")[n].as_py()] * len(seen), pa.int64()),
                    "pos": pa.array(list(seen.values()), pa.list_(pa.int32())), "q": pa.array([s[:q] for s, _ in seen], pa.binary()),
                    "before": pa.array([b for _, b in seen], pa.binary()), "rest": pa.array([s[q:] for s, _ in seen], pa.binary())})


def _padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of `width` bytes, rounded up to words and filled with zeros, and their sizes."""
    wide = -(-width // 8) * 8
    return np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(len(strings), wide), np.array([len(s) for s in strings], np.int64)


def multikey_order(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of byte strings by multikey quicksort. Each part of the array is split by one word of its rows into less, equal and greater; the equal part
    goes on with the next word, the others with the same. All parts of a round are split at once. Words are eight bytes, the size is the last."""
    n = len(rows)
    words = np.concatenate((np.ascontiguousarray(rows).view(">u8").astype(np.uint64), sizes.astype(np.uint64)[:, None]), axis=1)
    order = np.arange(n)
    at = np.arange(n)  # places in `order` that are not settled
    part, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    while len(at):
        value = words[order[at], depth]
        new = np.concatenate((np.ones(1, bool), part[1:] != part[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        number = np.cumsum(new) - 1
        low, middle, high = value[first], value[first + size // 2], value[first + size - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))[number]
        side = np.where(value < pivot, 0, np.where(value > pivot, 2, 1))
        key = 3 * number + side
        moved = np.argsort(key, kind="stable")
        order[at] = order[at][moved]
        key, depth = key[moved], depth[moved] + (key[moved] % 3 == 1)
        counts = np.bincount(key, minlength=3 * (number[-1] + 1))
        goes_on = (counts[key] > 1) & (depth < words.shape[1])
        at, part, depth = at[goes_on], key[goes_on], depth[goes_on]
    return order


def _common(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in `order`, 0 for the first."""
    a, b = rows[order[1:]], rows[order[:-1]]
    differs = a != b
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return np.concatenate((np.zeros(1, np.int64), np.minimum(first, np.minimum(sizes[order[1:]], sizes[order[:-1]]))))


def _ranks(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number per row that equal prefixes of `depth` bytes share; rows that are shorter have to be left out."""
    out = np.empty(len(order), np.int64)
    starts = common < depth
    starts[0] = False
    out[order] = np.cumsum(starts)
    return out


def _shared(one: bytes, other: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(one, other)) if x != y), min(len(one), len(other)))


_FOUND = "t1 bigint, t2 bigint, start int, end int, w1 bigint, w2 bigint, several boolean"


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One bucket: repeated stretches (start, end), and hashes (w1, w2) of the strings that may occur in other buckets too."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    h, _ = _reach(length)
    q_all, before, rest = (table.column(c).to_pylist() for c in ("q", "before", "rest"))
    places = table.column("pos").to_pylist()
    t1, t2 = table.column("t1").to_numpy(), table.column("t2").to_numpy()
    del table, rows
    n = len(q_all)
    suffixes, sizes = _padded([a + b for a, b in zip(q_all, rest)], length)
    lefts, left_sizes = _padded(before, max(1, h - 1))
    order, left_order = multikey_order(suffixes, sizes), multikey_order(lefts, left_sizes)
    common, left_common = _common(suffixes, sizes, order), _common(lefts, left_sizes, left_order)
    # how many bytes before the anchor may agree with those in another bucket; -1: not even the leading bytes
    reach = np.full(n, -1)
    for edge in (min, max):
        first = edge(range(n), key=lambda i: (q_all[i], before[i], rest[i]))
        for i in np.flatnonzero([x == q_all[first] for x in q_all]):
            reach[i] = max(reach[i], _shared(before[i], before[first]))
    twice = np.array([len(p) > 1 for p in places])
    least, most = np.full(n, h), np.full(n, -1)  # over the offsets of repeated strings around each anchor
    sent = []
    for offset in range(h):
        fits = np.flatnonzero((left_sizes >= offset) & (sizes >= length - offset))
        if not len(fits):
            continue
        key = _ranks(left_order, left_common, offset)[fits] * n + _ranks(order, common, length - offset)[fits]
        _, kept, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        again = fits[(counts[inverse] > 1) | twice[fits]]
        least[again], most[again] = np.minimum(least[again], offset), np.maximum(most[again], offset)
        # one row for each string that may go further, known as repeated or not
        goes = reach[fits[kept]] >= offset
        sent.extend((i, offset, bool(c > 1 or twice[i])) for i, c in zip(fits[kept[goes]], counts[goes]))
    out: dict[str, list] = {c: [] for c in ("t1", "t2", "start", "end", "w1", "w2", "several")}
    for i in np.flatnonzero(most >= 0):
        for at in places[i]:
            for name, value in zip(out, (t1[i], t2[i], at - most[i], at + length - least[i], None, None, None)):
                out[name].append(value)
    for i, offset, several in sent:
        string = before[i][:offset][::-1] + (q_all[i] + rest[i])[:length - offset]
        for name, value in zip(out, (t1[i], t2[i], places[i][0] - offset, None, *struct.unpack("<qq", hashlib.blake2b(string, digest_size=16).digest()), several)):
            out[name].append(value)
    yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], list(out))


def repeated_stretches(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t1, t2, parts): per text with repeated strings, the stretches (start, end) found, which may overlap. `texts` has t1, t2 and text as
    bytes; rows of equal text are one text here."""
    rows = texts.select(*_TEXT, "text").where(F.octet_length("text") >= length)
    grams = rows.select("t1", "text").mapInArrow(lambda b: _anchor_rows(b, length), "gram bigint, t1 bigint, pos int")
    place = F.struct("t1", "pos")
    shared = write_table(grams.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("gram"), free=True)
    # a table on the other side of the join, so that Spark can split a frequent gram
    wanted = write_table(grams.join(shared.frame, "gram", "left_semi").groupBy("t1").agg(F.collect_set("pos").alias("places")), free=True)
    n = wanted.frame.agg(F.sum(F.size("places").cast("bigint"))).first()[0] or 0
    one_each = rows.groupBy(*_TEXT).agg(F.first("text").alias("text"))
    suffixes = one_each.join(wanted.frame, "t1").select(*_TEXT, "text", "places").mapInArrow(lambda b: _suffix_rows(b, length), _SUFFIX)
    dealt = suffixes.repartitionByRange(max(1, -(-n * (length + _reach(length)[0]) // BUCKET_BYTES)), "q", "before", "rest", *_TEXT, "pos")
    found = write_table(dealt.mapInArrow(lambda b: _compare(b, length), _FOUND), free=True).frame
    drop_table(wanted)
    drop_table(shared)
    crossing = found.where("w1 IS NOT NULL")
    place = F.struct(*_TEXT, "start")  # two anchors of one string can send the same place from two buckets
    repeated = crossing.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.bool_or("several").alias("known"))
    repeated = repeated.where("known OR a <> b").select("w1", "w2")
    across = crossing.where("NOT several").join(repeated, ["w1", "w2"], "left_semi").select(*_TEXT, "start", (F.col("start") + length).alias("end"))
    return found.where("w1 IS NULL").select(*_TEXT, "start", "end").unionByName(across).groupBy(*_TEXT).agg(
        F.collect_set(F.struct("start", "end")).alias("parts"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the text without its stretches, which are merged first."""
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            kept, spans = [], []
            for text, parts, copied in zip(*(batch.column(c).to_pylist() for c in ("text", "parts", "copied"))):
                merged: list[list[int]] = []
                for a, b in [(0, len(text))] if copied else sorted((p["start"], p["end"]) for p in parts or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for span in merged for x in span), len(text or b"")]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if text else b"")
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.record_batch({"row": batch.column("row"), "n_bytes": pa.array([len(t or b"") for t in batch.column("text").to_pylist()], pa.int64()),
                                   "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept": pa.array(kept, pa.binary())})


def without_repeats(docs: DataFrame, columns: list[str], text: str = "text", length: int = LENGTH) -> DataFrame:
    """(row, n_bytes, removed, kept) per row of `docs`: the named columns as a struct, the size of the text in bytes, the maximal stretches (start, end; end
    exclusive) of bytes that go, and the bytes that stay.

    A byte goes if it lies in a string of `length` bytes that also starts elsewhere, in any text, its own included; all copies go, the first too.
    Texts are their UTF-8 bytes as they came; what is left may begin or end within a character. Null and empty texts have no bytes. Rows that
    repeat are texts that repeat, so they go wholly from `length` bytes on; texts are told apart by two 64-bit hashes. Other columns are ignored.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = rows.select("row", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    copies = rows.where(F.octet_length("text") >= length).groupBy(*_TEXT).agg(F.count("*").alias("n"))
    parts = repeated_stretches(rows, length)
    known = copies.where("n > 1").select(*_TEXT, F.lit(True).alias("copied")).join(parts, _TEXT, "full")
    joined = rows.join(known, _TEXT, "left").select("row", "text", "parts", F.coalesce("copied", F.lit(False)).alias("copied"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_bytes bigint, removed array<struct<start: int, end: int>>, kept binary")])
    return joined.mapInArrow(_without, schema)
