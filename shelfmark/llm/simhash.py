"""Near-duplicate documents by SimHash: 64-bit fingerprints, links within a radius, connected components.

Copies share a fingerprint, so links are sought between distinct fingerprints only. Two fingerprints within radius r agree
on at least one of r + 1 bit ranges (or on k - r of k ranges); the values of those ranges are the keys under which fingerprints
meet. What meets under one key is cut into pieces of bounded size, each pair of pieces is one unit of work, and a unit is compared
bit-sliced: bit planes stored vertically, 64 distances counted at once with carry-save adders, blocks abandoned as soon as
all their distances exceed the radius. A unit emits a spanning forest of its links, not the links: components stay
the same and no group emits its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import field, keyed_texts, map_rows, words_of
from shelfmark.llm.components import components
from shelfmark.llm.tables import write_table

BITS = 64
SHINGLE = 4
RADIUS = 4
#: Most fingerprints in one piece of a hot key; a unit of work holds two pieces.
PIECE = 4096
#: Rows a key may hold on average; more fingerprints get more key bits.
KEY_ROWS = 4096
_UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of the XXH64 values of all word shingles, repeats included; a bit is 1 if set in over half of them."""
    words = words_of(text.translate(_UPPER_TO_LOWER)) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist())], dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.nonzero(2 * counts > len(hashes))[0].tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fingerprint as a signed long) per row. Null and blank texts have fingerprint 0."""
    def per_batch(batch):
        values = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"fingerprint": values.view(np.int64)}

    return map_rows(keyed_texts(docs, key, text), per_batch, [field("fingerprint", "bigint")]).withColumnRenamed("key", key)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes, stored vertically: row b, word w, bit i is bit b of value 64 w + i."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype=np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int = RADIUS, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, value) at `radius` bits or fewer. Distances are kept as bit-sliced counters: counter plane k holds bit k of
    64 distances per word. Planes are added two at a time by a carry-save adder into the counters; a distance past the
    counters' range sets a sticky overflow bit. After each `step` planes, (query, word) blocks without a distance
    left within the radius are abandoned."""
    width = int(radius).bit_length()
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    n_words = planes.shape[1]
    alive_q = np.repeat(np.arange(len(queries)), n_words)
    alive_w = np.tile(np.arange(n_words), len(queries))
    counters = np.zeros((width, len(alive_q)), dtype=np.uint64)
    over = np.zeros(len(alive_q), dtype=np.uint64)
    if n % 64:  # places behind the last value are never within the radius
        over[alive_w == n_words - 1] = ones << np.uint64(n % 64)
    for start in range(0, BITS, step):
        for b in range(start, start + step, 2):
            flip = [np.where((queries >> np.uint64(x)) & np.uint64(1), ones, np.uint64(0)) for x in (b, b + 1)]
            x, y = (planes[c][alive_w] ^ f[alive_q] for c, f in zip((b, b + 1), flip))
            low = counters[0]
            half = x ^ y
            carry = (x & y) | (low & half)
            counters[0] = low ^ half
            for k in range(1, width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        left = ~(over | _above(counters, radius))
        live = left != 0
        if not live.all():
            alive_q, alive_w, counters, over, left = alive_q[live], alive_w[live], counters[:, live], over[live], left[live]
        if not len(alive_q):
            break
    bits = np.unpackbits(np.ascontiguousarray(left).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(alive_q) else np.zeros((0, 64), np.uint8)
    row, bit = np.nonzero(bits)
    return alive_q[row], alive_w[row] * 64 + bit


def _above(counters: np.ndarray, radius: int) -> np.ndarray:
    """Places whose counter exceeds the radius, compared from the highest counter bit down."""
    above = np.zeros(counters.shape[1], dtype=np.uint64)
    equal = ~above
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def forest(left: np.ndarray, right: np.ndarray, size: int) -> list[int]:
    """Indices of links that span the same components as all links."""
    parent = list(range(size))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for at, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(at)
    return kept


def unit_links(one: np.ndarray, other: np.ndarray | None, radius: int, queries: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one piece (`other` is None) or between two pieces."""
    values = one if other is None else other
    planes, n = planes_of(values), len(values)
    kept_a, kept_b = [], []
    for at in range(0, len(one), queries):
        a, b = within(one[at:at + queries], planes, n, radius)
        a = a + at
        if other is None:
            a, b = a[a < b], b[a < b]
        else:
            b = b + len(one)
        everything = one if other is None else np.concatenate((one, other))
        links_a, links_b = np.concatenate((*kept_a, a)).astype(np.int64), np.concatenate((*kept_b, b)).astype(np.int64)
        kept = forest(links_a, links_b, len(everything))
        kept_a, kept_b = [links_a[kept]], [links_b[kept]]
    everything = one if other is None else np.concatenate((one, other))
    return everything[kept_a[0].astype(np.int64)], everything[kept_b[0].astype(np.int64)]


def key_ranges(n: int, radius: int = RADIUS, key_rows: int = KEY_ROWS) -> list[list[tuple[int, int]]]:
    """The key tables: with k equal bit ranges, each choice of k - radius of them is a table. The least k is taken whose keys hold
    `key_rows` evenly spread fingerprints or fewer, so that work per fingerprint does not grow with their number. Every k
    finds every link."""
    for k in range(radius + 1, 2 * radius + 3):
        cuts = [BITS * i // k for i in range(k + 1)]
        shortest = sum(sorted(b - a for a, b in zip(cuts, cuts[1:]))[:k - radius])
        if n <= key_rows << shortest:
            break
    return [[(cuts[i], cuts[i + 1]) for i in chosen] for chosen in combinations(range(k), k - radius)]


def _units(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (table, key, first, second, fp, side), sorted by unit of work: compares each unit once its last row is in."""
    unit, parts = None, []

    def compare(rows: list[tuple[np.ndarray, np.ndarray]]):
        fp = np.concatenate([r[0] for r in rows])
        side = np.concatenate([r[1] for r in rows])
        if len(fp) < 2:
            return None
        a, b = unit_links(fp, None, radius) if unit[2] == unit[3] else unit_links(fp[side == 0], fp[side == 1], radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]) if len(a) else None

    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "key", "first", "second")])
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        side = batch.column("side").to_numpy(zero_copy_only=False)
        if not len(fp):
            continue
        cuts = [0, *(np.nonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))[0] + 1).tolist(), len(fp)]
        for a, b in zip(cuts, cuts[1:]):
            here = tuple(ids[:, a].tolist())
            if here != unit:
                if parts and (out := compare(parts)) is not None:
                    yield out
                unit, parts = here, []
            parts.append((fp[a:b], side[a:b]))
    if parts and (out := compare(parts)) is not None:
        yield out


def links(distinct: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column `fp` that span all components. The keys with more than
    `piece` fingerprints are cut into pieces by hash and every pair of pieces is compared."""
    n = distinct.count()
    keys = []
    for number, ranges in enumerate(key_ranges(n, radius)):
        value = F.lit(0).cast("bigint")
        for a, b in ranges:
            bits = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint"))
            value = F.shiftleft(value, b - a).bitwiseOR(bits)
        keys.append(F.struct(F.lit(number).alias("table"), value.alias("key")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.table", "k.key")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(sizes, ["table", "key"])
    n_pieces = F.ceil(F.col("n") / F.lit(piece)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda o: F.struct(
        F.least("mine", o).alias("first"), F.greatest("mine", o).alias("second"), (F.col("mine") > o).cast("int").alias("side")))
    units = (sized.withColumn("pieces", n_pieces).withColumn("mine", mine).select("table", "key", "fp", F.explode(others).alias("u"))
             .select("table", "key", "u.first", "u.second", "fp", "u.side"))
    unit = ["table", "key", "first", "second"]
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(lambda batches: _units(batches, radius), "a bigint, b bigint")


def classes(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """`prints` (key, fingerprint, ...) with root, one fingerprint of its class, and component_id, the least key among all rows
    whose fingerprints are connected by links of `radius` bits or fewer, a row itself included. Null keys are never the least; a component of null keys alone has null.
    Only distinct fingerprints take part in the search; rows meet their class by fingerprint, in a join whose hot keys Spark can split."""
    least = write_table(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("least"))).frame
    roots = components(links(least.select("fp"), radius))
    joined = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = write_table(joined).frame
    per_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    per_print = joined.join(per_root, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id")
    return prints.join(per_print, "fingerprint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) per row of `docs`. Null and blank texts share fingerprint 0 and are linked like
    any other; repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result."""
    prints = write_table(fingerprints(docs, key, text)).frame
    return classes(prints, key, radius).select(key, "fingerprint", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate class, all columns: that with the least key (a class of null keys alone keeps one row
    too). Rows repeated with the least key are told apart by their text and then by their place in the table, so exactly one stays."""
    packed = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))

    def per_batch(batch):
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"fingerprint": values.view(np.int64)}

    marked = write_table(map_rows(packed.withColumn("place", F.monotonically_increasing_id()), per_batch,
                                  [field("fingerprint", "bigint")], keep=("row", "key", "place"))).frame
    ranked = classes(marked.select("place", "key", "fingerprint"), "key", radius)
    order = F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("key"), F.col("place").alias("place"))
    kept = ranked.groupBy("root").agg(F.min(order).alias("first"))
    return marked.join(kept.select(F.col("first.place").alias("place")), "place", "left_semi").select("row.*")
