"""Stupid-backoff scores of whole corpora, relationally.

Documents lie in blocks and n-grams in parts of the hash range; both are Spark groups whose number grows with the corpus. A block sends each part its
distinct n-grams with their counts, one row per part, so a frequent n-gram costs one entry per block and no more. A part sums the counts to
its share of the count table, joins the table with the n-grams that came in and returns the totals to the blocks, in the order asked. A block then
scores its documents and sums per document. Rows hold sorted 64-bit hashes as differences, byte by byte in planes, which the
shuffle's compression shrinks to little more than their entropy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import ascii_lower, document, field, map_rows, words_column
from shelfmark.llm.tables import write_table

ORDER = 3
ALPHA = 0.4
#: n-grams of two words or more that occur less often are not in the table.
MIN_COUNT = 2
#: Bytes of text in one block, and bytes of text whose n-grams make one part.
BLOCK_BYTES = 8 << 20
PART_BYTES = 12 << 20
#: Documents of one text and key whose rows are summed apart, see `relational_scores`.
_DOC = ["d", "copy"]
_UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TAG = np.uint64(3)  # the two low bits of a hash hold the order


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, each compressed on its own, with the planes' sizes in front."""
    codec = pa.Codec("zstd", compression_level=1)
    width = values.dtype.itemsize
    planes = [codec.compress(p.tobytes(), asbytes=True) for p in values.view(np.uint8).reshape(-1, width).T]
    return np.array([len(values), *map(len, planes)], dtype="<u8").tobytes() + b"".join(planes)


def unpack(data: bytes, kind: type) -> np.ndarray:
    codec = pa.Codec("zstd")
    width = np.dtype(kind).itemsize
    n, *sizes = np.frombuffer(data, "<u8", count=width + 1).tolist()
    out = np.empty((n, width), dtype=np.uint8)
    at = 8 * (width + 1)
    for plane, size in enumerate(sizes):
        if n:
            out[:, plane] = np.frombuffer(codec.decompress(data[at:at + size], n, asbytes=True), np.uint8)
        at += size
    return out.view(kind).ravel()


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = (x + right) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


class Grams:
    """n-gram hashes of a block of texts: at[n - 1][i] is that of the n words that end with word i, where `place` of the word in its text allows it."""

    def __init__(self, texts: list[bytes | None]):
        digest = xxhash.xxh64_intdigest
        hashed = [np.fromiter(map(digest, t.translate(_UPPER_TO_LOWER).split()), np.uint64) if t else np.zeros(0, np.uint64) for t in texts]
        self.sizes = np.array([len(h) for h in hashed], dtype=np.int64)
        word = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        del hashed
        starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if len(self.sizes) else np.zeros(0, np.int64)
        self.place = np.arange(len(word)) - np.repeat(starts, self.sizes)
        grams, self.at = word, []
        for n in range(1, ORDER + 1):
            if n > 1:
                grams = np.concatenate((np.zeros(1, np.uint64), _mix(grams[:-1], word[1:])))[:len(word)]
            self.at.append((grams & ~_TAG) | np.uint64(n))

    def keys(self) -> np.ndarray:
        return np.concatenate([hashes[self.place >= n] for n, hashes in enumerate(self.at)])


def texts_of(table: pa.Table) -> list[bytes | None]:
    codec = pa.Codec("zstd")
    return [codec.decompress(t, n, asbytes=True) if n else None for t, n in zip(table.column("packed").to_pylist(), table.column("size").to_pylist())]


def _packed(batch: pa.RecordBatch) -> dict:
    """Texts compressed on their own: they are shuffled once and take the most room beside the n-grams."""
    codec = pa.Codec("zstd", compression_level=3)
    texts = batch.column("text").to_pylist()
    return {"packed": [codec.compress(t, asbytes=True) if t else None for t in texts], "size": [len(t) if t else 0 for t in texts]}


def _bounds(parts: int) -> np.ndarray:
    """First hash of each part but the first."""
    return np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)


def _differences(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _send(table: pa.Table, parts: int) -> pa.Table:
    """The distinct n-grams of one block, a row for every part, empty ones too."""
    keys, counts = np.unique(Grams(texts_of(table)).keys(), return_counts=True)
    counts = counts.astype(np.uint32)
    cuts = [0, *np.searchsorted(keys, _bounds(parts)).tolist(), len(keys)]
    ranges = list(zip(cuts, cuts[1:]))
    return pa.table({
        "part": pa.array(range(parts), pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * parts, pa.int32()),
        "grams": pa.array([_differences(keys[a:b]) for a, b in ranges], pa.binary()), "counts": pa.array([pack(counts[a:b]) for a, b in ranges], pa.binary())})


def _total(table: pa.Table) -> pa.Table:
    """The count table of one part, joined with what each block asked for."""
    asked = [np.cumsum(unpack(g, np.uint64), dtype=np.uint64) for g in table.column("grams").to_pylist()]
    counts = np.concatenate([unpack(c, np.uint32) for c in table.column("counts").to_pylist()])
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.uint64)  # exact below 2**53
    single = (keys & _TAG) == 1
    n_words = int(totals[single].sum())
    totals[~single & (totals < MIN_COUNT)] = 0
    answers, at = [], 0
    for grams in asked:
        answers.append(pack(totals[place[at:at + len(grams)]]))
        at += len(grams)
    return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": pa.array(answers, pa.binary()),
                     "n_words": pa.array([n_words] * table.num_rows, pa.int64())})


def _score(docs: pa.Table, answers: pa.Table, parts: int, key_type: pa.DataType) -> pa.Table:
    grams = Grams(texts_of(docs))
    keys = np.unique(grams.keys())
    rows = sorted(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist()))
    totals = np.concatenate([unpack(t, np.uint64) for _, t in rows])
    if [p for p, _ in rows] != list(range(parts)) or len(totals) != len(keys):
        raise ValueError("the answers do not fit the block's n-grams")
    n_words = sum(answers.column("n_words").to_pylist())

    # counts of the n-grams that end at each word, 0 where the text is too short
    counts = []
    for n in range(1, ORDER + 1):
        fits = grams.place >= n - 1
        found = np.zeros(len(fits), dtype=np.float64)
        own, place = np.unique(grams.at[n - 1][fits], return_inverse=True)
        found[fits] = totals[np.searchsorted(keys, own)][place]  # sorted against sorted
        counts.append(found)
    del keys, totals
    longest = np.minimum(grams.place, ORDER - 1)
    value = ALPHA ** longest * counts[0] / max(1, n_words)
    seen = np.ones(len(value), dtype=np.int64)
    for n in range(2, ORDER + 1):
        hit = counts[n - 1] > 0
        before = np.concatenate((np.ones(1), counts[n - 2][:-1]))[:len(hit)]
        value[hit] = ALPHA ** (longest[hit] - (n - 1)) * counts[n - 1][hit] / before[hit]
        seen[hit] = n
    micros = np.rint(np.log(value) * 1e6).astype(np.int64) if len(value) else np.zeros(0, np.int64)
    document_of = np.repeat(np.arange(len(grams.sizes)), grams.sizes)

    def per_document(values: np.ndarray) -> pa.Array:
        sums = np.bincount(document_of, weights=values, minlength=len(grams.sizes))  # whole numbers, exact below 2**53
        return pa.array(sums.astype(np.int64))

    return pa.table({"key": docs.column("key").cast(key_type), "n_words": pa.array(grams.sizes), "log_micros": per_document(micros),
                     **{f"n_order{n}": per_document((seen == n).astype(np.int64)) for n in range(1, ORDER + 1)}})


def _block(blocks: int) -> Column:
    """Block of a row by key, text and row number, so that rows that repeat spread. The number is that of the input's files and so the same in every read."""
    return F.pmod(F.xxhash64("d", "copy", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, log_micros, n_order1, n_order2, n_order3) per row of `docs`, counts taken from all rows.

    A word scores count(n-gram) / count(its context) for the longest n-gram of up to three words that ends with it and is in the table, times 0.4 for
    each order given up; with one word left, count / all words. log_micros sums the natural logarithms in millionths, each rounded. n_order* count
    the words by the order used. Words are those between ASCII blanks, in ASCII lower case. Null and blank texts have 0 everywhere; repeated rows
    count and score each; other columns are ignored. `docs` is read more than once and has to give its rows in the same order each time, as tables do.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // PART_BYTES))
    placed = map_rows(rows.select("key", "text", *document()).select("key", "text", _block(blocks).alias("block")), _packed,
                      [field("packed", "binary"), field("size", "bigint")], keep=("key", "block"))
    sent = placed.groupBy("block").applyInArrow(lambda t: _send(t, parts), "part int, block int, grams binary, counts binary")
    answered = sent.groupBy("part").applyInArrow(_total, "block int, part int, totals binary, n_words bigint")
    fields = [field(n, "bigint") for n in ("n_words", "log_micros", *(f"n_order{n}" for n in range(1, ORDER + 1)))]
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *fields])

    def score(docs_of_block: pa.Table, answers: pa.Table) -> pa.Table:
        return _score(docs_of_block, answers, parts, docs_of_block.schema.field("key").type)

    scored = placed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, schema)
    return scored.withColumnRenamed("key", key)


def _exploded(rows: DataFrame) -> DataFrame:
    """(d, copy, i, n, gram, context): the n-grams of every word i that end with it, as hashes, and that of the n-gram without its last word."""
    words = rows.select(*_DOC, F.transform(words_column(ascii_lower(F.col("text"))), lambda w: F.xxhash64(w)).alias("w"))

    def gram(i: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), *(F.get("w", i - back) for back in range(n - 1, -1, -1)))

    def ending(i: Column) -> Column:
        rows_of = [F.struct(i.alias("i"), F.lit(n).alias("n"), gram(i, n).alias("gram"), (gram(i - 1, n - 1) if n > 1 else F.lit(None).cast("bigint")).alias("context"))
                   for n in range(1, ORDER + 1)]
        return F.filter(F.array(*rows_of), lambda g: g.i >= g.n - 1)

    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    return words.select(*_DOC, F.explode(F.flatten(F.transform(places, ending))).alias("g")).select(*_DOC, "g.*")


def relational_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """The rows of `scores` by groupBy and joins alone: exploded n-grams, count tables dealt by hash, contexts joined to the counts once per n-gram, n-grams
    joined to both, sums per document. n-grams of two words and more below `min_count` are not in the table; 1 keeps all. n-grams are 64-bit hashes here and
    62-bit ones in `scores`; those that collide share a count. Shuffles a row per word and order."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("key", "text", *document())
    grams = _exploded(rows)
    counts = grams.groupBy("n", "gram", "context").agg(F.count("*").alias("c")).where((F.col("n") == 1) | (F.col("c") >= min_count))
    counts = write_table(counts).frame
    total = counts.where("n = 1").agg(F.sum("c")).first()[0] or 1
    contexts = counts.select((F.col("n") + 1).alias("n"), F.col("gram").alias("context"), F.col("c").alias("before"))
    table = counts.where("n > 1").join(contexts, ["n", "context"]).select("n", "gram", "c", "before").unionByName(
        counts.where("n = 1").select("n", "gram", "c", F.lit(total).alias("before")))
    found = grams.select(*_DOC, "i", "n", "gram").join(table, ["n", "gram"]).repartition(*_DOC)
    best = found.groupBy(*_DOC, "i").agg(F.max(F.struct("n", "c", "before")).alias("b"))
    given_up = F.least(F.col("i"), F.lit(ORDER - 1)) - (F.col("b.n") - 1)
    value = F.pow(F.lit(ALPHA), given_up) * F.col("b.c") / F.col("b.before")
    sums = best.groupBy(*_DOC).agg(F.count("*").alias("n_words"), F.sum(F.round(F.log(value) * 1e6).cast("bigint")).alias("log_micros"),
                                   *(F.count_if(F.col("b.n") == n).alias(f"n_order{n}") for n in range(1, ORDER + 1)))
    names = ["n_words", "log_micros", *(f"n_order{n}" for n in range(1, ORDER + 1))]
    joined = rows.select("key", *_DOC).join(sums, _DOC, "left")
    return joined.select(F.col("key").alias(key), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names))
