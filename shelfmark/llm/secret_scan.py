"""Secrets in texts: three patterns, and candidate strings whose sliding windows are too random. DataFrame operations only.

Patterns run once over each text and give matches and the pieces between them; places follow from running sums of
their lengths. A candidate string is cut into pieces and these into characters; a window's entropy follows from the counts before a character leaves and
before one enters, so each step costs the same whatever the window is. Entropy is kept as a whole number: sums of c log2 c in
units of 1e-9, which makes running sums exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import document
from shelfmark.llm.tables import write_table

#: Fixed patterns, in the order in which spans of one start are listed; sizes are the least lengths (of the group named).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
#: A run of the same letters is searched with its least length, which finds the same matches as dropping short ones.
SEARCH = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}", "entropy": r"[A-Za-z0-9+/_=-]{20,}"}
ASSIGNED = 8

#: Sliding window of the entropy rule, in characters.
WINDOW = 20


@dataclass(frozen=True)
class CharacterClass:
    """Windows of these characters, with at least so many digits and letters, are random from `bits` per character on."""
    name: str
    characters: str
    digits: int
    letters: int
    bits: float


#: In order; a window belongs to the first class that has all its characters.
CLASSES = (
    CharacterClass("hex", "[0-9a-f]", 3, 3, 2.9),
    CharacterClass("alphanumeric", "[A-Za-z0-9]", 2, 2, 3.7),
    CharacterClass("base64", "[A-Za-z0-9+/_=-]", 2, 4, 3.8),
)
#: What is allowed. A candidate that is an identifier goes. Of a path (letters, _ and - between single slashes, then a last part with digits too) only windows
#: within the last part count. A window that holds one of these words, or lies in one of these alphabets, does not count. All others do, whatever lies
#: beside them; a date is shorter than a window. No pattern has a group under a quantifier, which Java would match by recursion.
IDENTIFIER = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
NOT_IN_FOLDERS, NOT_IN_NAMES = "[^A-Za-z_/-]|//", "[+=]"
WORDS = "(?i)example|sample|dummy|placeholder|changeme|abcdefghij|0123456789|1234567890|qwertyuiop"
_LETTERS, _KEYS = "abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm"
ALPHABETS = " ".join(a + b + end for digits in ("0123456789", "1234567890") for x in (_LETTERS, _KEYS)
                     for a, b, end in ((2 * x, digits, "+/="), (2 * x, digits, "-_="), (digits, 2 * x, "+/="), (digits, 2 * x, "-_=")))
#: A candidate is cut into pieces of so many windows, so that no step depends on its length.
PIECE = 1000
#: c log2 c in units of 1e-9 for c = 0 ... WINDOW.
COUNT_LOG = [round(c * math.log2(c) * 1e9) if c else 0 for c in range(WINDOW + 1)]


def most_concentrated(bits: float, window: int = WINDOW) -> int:
    """Largest sum of c log2 c at which the entropy of a window is `bits` or more."""
    return math.floor(window * (math.log2(window) - bits) * 1e9)


def _matches(docs: DataFrame) -> DataFrame:
    """(d, copy, kind, start, end, match): kind counts KINDS from 0. Repeated documents give their matches once."""
    found = [F.struct(F.lit(n).alias("kind"), F.split("text", SEARCH[name]).alias("gaps"), F.regexp_extract_all("text", F.lit(SEARCH[name]), F.lit(0)).alias("all"))
             for n, name in enumerate(KINDS)]
    per_kind = docs.where("text IS NOT NULL").select("d", "copy", F.explode(F.array(*found)).alias("f")).where(F.size("f.all") > 0)
    zipped = F.arrays_zip(F.col("f.gaps").alias("gap"), F.col("f.all").alias("match"))
    rows = (per_kind.select("d", "copy", "f.kind", F.posexplode(zipped).alias("n", "m")).where("m.match IS NOT NULL")
            .select("d", "copy", "kind", "n", F.length("m.gap").alias("gap"), F.length("m.match").alias("size"), F.col("m.match").alias("match")).distinct())
    before = Window.partitionBy("d", "copy", "kind").orderBy("n")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    placed = rows.select("d", "copy", "kind", (end - F.col("size")).alias("start"), end.alias("end"), "match")
    long_enough = (F.col("kind") != 0) | (F.length(F.regexp_extract("match", ASSIGN, 1)) >= ASSIGNED)
    return placed.where(long_enough)


def _count_log(count: Column) -> Column:
    return F.get(F.array(*map(F.lit, COUNT_LOG)), count.cast("int"))


def _pieces(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., start, piece, first, text): the candidates that are no identifiers in pieces of PIECE characters and the windows' rest behind; first is the
    place of the first window in a piece that may count."""
    last = F.substring_index("match", "/", -1)
    part = F.length("match") - F.length(last)
    is_path = (part > 0) & ~F.substring("match", F.lit(1), part).rlike(NOT_IN_FOLDERS) & ~last.rlike(NOT_IN_NAMES)
    chunks = F.regexp_extract_all("match", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = candidates.where(~F.col("match").rlike(IDENTIFIER)).select(*keys, "start", F.when(is_path, part).otherwise(0).alias("part"), chunks.alias("chunks"))
    behind = F.concat(F.transform(F.slice("chunks", 2, F.size("chunks")), lambda c: F.left(c, F.lit(WINDOW - 1))), F.array(F.lit("")))
    rows = cut.select(*keys, "start", "part", F.posexplode(F.zip_with("chunks", behind, lambda c, rest: F.concat(c, rest))).alias("piece", "text"))
    return rows.select(*keys, "start", "piece", (F.col("part") - F.col("piece") * PIECE).alias("first"), "text").where(f"length(text) >= {WINDOW}")


def random_parts(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., start, end) of the candidates (keys..., start, match) with a random window that counts: from the first such window to the end of the last.
    Characters of one piece are ordered in one place."""
    pieces = _pieces(candidates, keys)
    own = [*keys, "start", "piece"]
    chars = pieces.select(*own, F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    same, along = Window.partitionBy(*own, "ch").orderBy("i"), Window.partitionBy(*own).orderBy("i")
    counted = chars.withColumns({
        "enters": F.count("*").over(same.rangeBetween(1 - WINDOW, -1)),  # equal characters in the window it enters
        "stays": F.count("*").over(same.rangeBetween(0, WINDOW - 1)),  # and, itself among them, in the one it leaves
    })
    leaves = F.lag("stays", WINDOW).over(along)
    step = (_count_log(F.col("enters") + 1) - _count_log(F.col("enters"))
            + F.coalesce(_count_log(leaves - 1) - _count_log(leaves), F.lit(0)))
    moved = counted.withColumn("step", step)
    last = along.rowsBetween(1 - WINDOW, 0)
    is_in = lambda pattern: F.sum(F.col("ch").rlike(pattern).cast("int")).over(last)
    windows = moved.select(*own, "i", F.sum("step").over(along).alias("total"), is_in("[0-9]").alias("digits"), is_in("[A-Za-z]").alias("letters"),
                           *(is_in(c.characters).alias(c.name) for c in CLASSES)).where(F.col("i") >= WINDOW - 1)
    random = F.lit(False)
    for c in reversed(CLASSES):
        good = (F.col("digits") >= c.digits) & (F.col("letters") >= c.letters) & (F.col("total") <= most_concentrated(c.bits))
        random = F.when(F.col(c.name) == WINDOW, good).otherwise(random)
    found = windows.where(random).groupBy(*own).agg(F.collect_list(F.col("i") - (WINDOW - 1)).alias("at")).join(pieces, own)

    def counts(i: Column) -> Column:
        window = F.substring("text", i + 1, F.lit(WINDOW))
        return (i >= F.col("first")) & ~window.rlike(WORDS) & ~F.contains(F.lit(ALPHABETS), F.lower(window))

    place = lambda i: F.col("start") + F.col("piece") * PIECE + i
    counting = found.withColumn("at", F.filter("at", counts)).where(F.size("at") > 0)
    ends = counting.select(*keys, "start", place(F.array_min("at")).alias("a"), place(F.array_max("at")).alias("b"))
    return ends.groupBy(*keys, "start").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(*keys, F.col("a").alias("start"), (F.col("b") + WINDOW).alias("end"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, copy, kind, start, end) of all secrets in the texts of `docs`; see `scan`."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("text", *document())
    return _spans(rows)


def _spans(rows: DataFrame) -> DataFrame:
    found = write_table(_matches(rows)).frame  # used twice; the texts are searched once
    doc = ["d", "copy"]
    base = found.where(f"kind < {KINDS.index('entropy')}").select(*doc, "kind", "start", "end")
    added = random_parts(found.where(f"kind = {KINDS.index('entropy')}").select(*doc, "start", "match"), doc).select(
        *doc, F.lit(KINDS.index("entropy")).alias("kind"), "start", "end")
    # an entropy span that one span of a pattern contains says nothing new
    ordered = Window.partitionBy(*doc).orderBy("start", "kind")
    is_base = F.col("kind") < KINDS.index("entropy")
    seen = base.unionByName(added).withColumn("before", F.max(F.when(is_base, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.where(is_base | F.coalesce(F.col("before") < F.col("end"), F.lit(True))).select(*doc, "kind", "start", "end")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) per row of `docs`: an array of (kind, start, end), by start and then kind, counted in code points, end exclusive; kinds are the
    places in KINDS. The three patterns are matched from the left without overlap, each on its own, and matches that are too short go.
    To them come candidate strings with a random window: from the first window that counts to the end of the last. Every window is judged on its own, so no
    candidate goes for a part of it; IDENTIFIER, NOT_IN_FOLDERS, WORDS and ALPHABETS say which windows do not count. A span goes only where one span of
    a pattern contains it. Null and blank texts have no spans; repeated rows give repeated rows; other columns are ignored. Work grows with
    the text, also within one candidate.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("key", "text", *document())
    listed = _spans(rows.select("text", "d", "copy")).groupBy("d", "copy").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    spans_of = F.transform(F.coalesce("found", F.array()), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return rows.select("key", "d", "copy").join(listed, ["d", "copy"], "left").select(F.col("key").alias(key), spans_of.alias("spans"))


def written(found: Column, base_only: bool = False) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    some = F.filter(found, lambda s: s.kind < KINDS.index("entropy")) if base_only else found
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s.kind == KINDS.index(kind))).cast("bigint")
