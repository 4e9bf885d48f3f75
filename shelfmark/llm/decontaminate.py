"""Benchmark passages in training documents, found by spaced seeds. DataFrame operations only.

A seed is a fixed mask over neighbouring words: it hashes the words at its selected positions and ignores the others, so a
substituted word costs only the seeds that select it. Items of the same words are searched once. Seeds of the test items are broadcast in slices of
bounded size, one slice after the other; documents are scanned once per slice, and each hit carries the document's words around it. Around every hit the item is laid over the document
without gaps and equal words are counted. For items of 16 words or more the three masks leave a hit for every choice of three
substitutions in 16 words (checked by a test), shorter items use runs that must survive their substitutions: nothing is missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, document, words_column
from shelfmark.llm.tables import write_table

#: Words of the window that must agree, and the share of them.
WINDOW = 16
SHARE = (4, 5)
#: Shorter items are too common as phrases to be a leak.
SHORTEST = 5
#: Selected positions of the masks.
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 4, 8, 10, 11), (0, 5, 6, 8, 9, 10))
#: Characters that are no part of a word when words are compared.
PUNCTUATION = ".,;:!?\"'()[]{}"
#: Seeds of one broadcast slice, about 40 bytes each.
SLICE_SEEDS = 1_000_000
#: Words a hit carries before its first and behind its last.
AROUND = WINDOW
#: Places of a document that make up one row with the words around them. Spark holds the hits of a row at once, so that these, and not those of a whole
#: document, are what a task holds.
PIECE = 256


def needed(window: int) -> int:
    """Equal words that make a window of this length a match."""
    return -(-window * SHARE[0] // SHARE[1])


def run_of(words: int) -> int:
    """Neighbouring equal words that every match of a whole item of so many words has."""
    lost = words - needed(words)
    return -(-(words - lost) // (lost + 1))


def plain_words(text: Column) -> Column:
    """The words in ASCII lower case and without punctuation."""
    return words_column(F.translate(ascii_lower(text), PUNCTUATION, ""))


def word_hashes(words: Column) -> Column:
    """64-bit hashes of the words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _pieces(words: Column, behind: int) -> Column:
    """A document's words in pieces of PIECE places: struct(first, base, words), the words with some before the first place and `behind` after the last; base is
    the place of the first word. Null without words."""
    size = F.size(words)

    def piece(first: Column) -> Column:
        base = F.greatest(first - AROUND, F.lit(0))
        return F.struct(first.alias("first"), base.alias("base"), F.slice(words, base + 1, first - base + F.lit(PIECE + behind)).alias("words"))

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(PIECE)), piece))


def _seeds(words: Column, at: Column, masks: dict[int, tuple[int, ...]]) -> Column:
    """One hash per mask at the place `at` (from 0); null where the mask does not fit."""
    return F.array(*(F.when(at + mask[-1] < F.size(words), F.xxhash64(F.lit(number), *(F.get(words, at + o) for o in mask)))
                     for number, mask in masks.items()))


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, item, words) of the items that can leak, repeated items once; `item` stands for the words."""
    rows = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    words = rows.select("item_id", word_hashes(plain_words(F.col("text"))).alias("words")).where(F.size("words") >= SHORTEST).distinct()
    return words.select("item_id", F.xxhash64("words").alias("item"), "words")


def _best(row: dict[str, Column]) -> Column:
    """Best window of the item that covers the hit: struct(matched, start), start counted in the document's words."""
    size, window = F.size(row["words"]), F.least(F.size(row["words"]), F.lit(WINDOW))
    j, i = row["j"], row["i"]
    low = F.greatest(F.lit(0), j + row["span"] - window)
    high = F.least(j, size - window)

    def matched(a: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), window - 1), F.lit(0), lambda n, o: n + F.when(
            F.get(row["words"], a + o) == F.get(row["around"], a + o - j + row["lead"]), 1).otherwise(0))

    windows = F.transform(F.sequence(low, high), lambda a: F.struct(matched(a).alias("matched"), (-(i + a - j)).alias("back"), window.alias("window")))
    return F.array_max(windows)


def _hits(docs: DataFrame, items: DataFrame, masks: dict[int, tuple[int, ...]], part: Column) -> DataFrame:
    """Verified windows of one slice of the items. docs: (d, copy, key, text); items: (item, words)."""
    items = items.where(part)
    spans = F.element_at(F.create_map(*(F.lit(x) for number, mask in masks.items() for x in (number, mask[-1] + 1))), F.col("mask"))
    numbers = F.array(*(F.lit(n) for n in masks))
    seeds = (items.select("item", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("j"))
             .select("item", "j", F.size("words").alias("size"), F.posexplode(_seeds(F.col("words"), F.col("j"), masks)).alias("at", "seed"))
             .where("seed IS NOT NULL").withColumn("mask", F.get(numbers, F.col("at")))
             # long items use the spaced masks, a short one the run of its own length
             .where(F.when(F.col("size") >= WINDOW, F.col("mask") < len(MASKS)).otherwise(F.col("mask") == F.lit(100) + _run_column(F.col("size"))))
             .select("seed", "item", "j", spans.alias("span")))
    behind = AROUND + max(m[-1] for m in masks.values())
    words = docs.select("d", "copy", "key", plain_words(F.col("text")).alias("w"))
    pieces = words.select("d", "copy", "key", F.explode(_pieces(F.col("w"), behind)).alias("p"))
    hashed = pieces.select("d", "copy", "key", "p.first", "p.base", word_hashes(F.col("p.words")).alias("h"))
    last = F.least(F.col("first") - F.col("base") + PIECE, F.size("h")) - 1
    placed = hashed.select("d", "copy", "key", "base", "h", F.explode(F.sequence(F.col("first") - F.col("base"), last)).alias("at"))
    seeded = placed.select("d", "copy", "key", "base", "h", "at", F.explode(_seeds(F.col("h"), F.col("at"), masks)).alias("seed"))
    found = seeded.join(F.broadcast(seeds), "seed")
    lead = F.least(F.col("at"), F.lit(AROUND))
    around = F.slice("h", F.col("at") - lead + 1, lead + F.lit(1 + behind))
    hits = found.select("d", "copy", "key", "item", (F.col("base") + F.col("at")).alias("i"), "j", "span", lead.alias("lead"), around.alias("around"))
    laid = hits.join(F.broadcast(items), "item").select("d", "copy", "key", "item", _best({c: F.col(c) for c in ("words", "around", "lead", "i", "j", "span")}).alias("best"))
    return laid.where(F.col("best.matched") >= F.ceil(F.col("best.window") * SHARE[0] / SHARE[1]))


def _run_column(size: Column) -> Column:
    return F.get(F.array(*(F.lit(run_of(n) if n >= SHORTEST else 0) for n in range(WINDOW))), size)


def _leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(d, copy, key, item, best) of the windows found; the slices in turn, so that executors hold the seeds of one."""
    items = items.select("item", "words").distinct()
    sizes = items.agg(F.sum(F.size("words")).alias("n"), F.collect_set(F.when(F.size("words") < WINDOW, F.size("words"))).alias("short")).first()
    masks = dict(enumerate(MASKS)) | {100 + run: tuple(range(run)) for run in sorted({run_of(n) for n in sizes.short})}
    n_slices = max(1, -(-(sizes.n or 0) * len(MASKS) // SLICE_SEEDS))
    parts = (_hits(docs, items, masks, F.pmod(F.xxhash64("item", F.lit(7)), F.lit(n_slices)) == s) for s in range(n_slices))
    if n_slices == 1:
        return next(parts)
    return reduce(DataFrame.unionAll, [write_table(p.groupBy("d", "copy", "key", "item").agg(F.max("best").alias("best")), free=True).frame for p in parts])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, matched, window, start): one row per document and benchmark item of which some window of 16 words (the whole item if it
    is shorter) lies in the document with at least 80 % equal words in place; matched and start (in words without punctuation) are those of the best
    window, the first of equals.

    Null and blank texts and items leak nothing, nor do items of fewer than five words. Repeated rows, and rows with the same key, give one row per
    item. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").select("key", "text", *document())
    items = _items(benchmark, item, item_text)
    found = _leaks(rows, items).groupBy("key", "item").agg(F.max("best").alias("best"))
    best = found.join(items.select("item", "item_id").distinct(), "item").groupBy("key", "item_id").agg(F.max("best").alias("best"))
    return best.select(F.col("key").alias(key), "item_id", F.col("best.matched").cast("bigint").alias("matched"),
                       F.col("best.window").cast("bigint").alias("window"), (-F.col("best.back")).cast("bigint").alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, in which no benchmark item leaks."""
    packed = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text")).select("row", *document(), "key", "text")
    found = _leaks(packed.select("d", "copy", "key", "text").where("text IS NOT NULL"), _items(benchmark, item, item_text))
    return packed.join(found.select("d", "copy").distinct(), ["d", "copy"], "left_anti").select("row.*")
