"""Repeated runs of lines across a corpus, and the texts without their later copies. DataFrame operations only.

Every document is a sequence of line ids. Prefix doubling sorts its suffixes by their first 1, 2, 4, ... lines: a level holds the
rank of each suffix among all suffixes under that comparison, for suffixes that share the rank with another one (others need no
further comparison). Equal ranks are the LCP intervals of at least that depth. A suffix that is not the first of its interval begins a block that
occurred before. A run of n lines that occurred before is the union of two such blocks, one at its start and one at its end, of the
largest power of two up to n, and these overlap: so the blocks of all suffixes, each at its deepest level, joined where they share a line, are
exactly the runs that occurred before, joined where they share a line. Such a stretch is deleted if it has enough words; the first
copy, in the order of keys, stays.

Lines that occur once leave after the first count, so all later work is on repeated lines. Every level is a table in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, document
from shelfmark.llm.tables import drop_table, write_table

#: Fewest words of a stretch that is worth deleting.
MIN_WORDS = 20
DOC = ["d", "copy"]
AT = ["d", "copy", "p"]


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, copy, p, line, id1, id2, words): the \\n-split lines with a word; p counts them, line counts all. The two ids are one
    128-bit hash of the line. Distinct documents only."""
    split = docs.where(F.col(text).isNotNull()).select(*document(key, text), F.split(text, "\n").alias("lines"))
    numbered = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s.x.rlike(WORD))
    rows = split.select(*DOC, F.posexplode(numbered).alias("p", "s"))
    return rows.select(*AT, F.col("s.i").alias("line"), F.xxhash64("s.x").alias("id1"), F.xxhash64(F.lit(1), "s.x").alias("id2"),
                       F.regexp_count("s.x", F.lit(WORD)).alias("words"))


def _ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys with `rank`, a number that grows with the key: after a range sort, row numbers grow from partition to
    partition, so nothing meets in one task."""
    return keys.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id())


def _position(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in AT))


def later_blocks(lines: DataFrame) -> DataFrame:
    """(d, copy, p, level): for every line that occurred before, the deepest level at which it begins a block of 2**level lines that
    occurred before. Ends with the first level at which no block is found twice."""
    found: list[DataFrame] = []
    level, keys, columns = None, lines.select(*AT, "id1", "id2"), ["id1", "id2"]
    while True:
        groups = keys.groupBy(*columns).agg(F.count("*").alias("n"), F.min(_position()).alias("first")).where("n > 1").drop("n")
        ranked = keys.join(_ranked(groups, columns), columns).select(*AT, "rank", (_position() > F.col("first")).alias("later"))
        level = write_table(ranked if found else ranked.distinct())  # rows that repeat are one document
        if level.frame.isEmpty():
            drop_table(level)
            break
        number = len(found)
        found.append(level.frame.where("later").select(*AT, F.lit(number).alias("level")))
        after = level.frame.select(*DOC, (F.col("p") - (1 << number)).alias("p"), F.col("rank").alias("rank2"))
        keys = level.frame.select(*AT, F.col("rank").alias("rank1")).join(after, AT)
        columns = ["rank1", "rank2"]
    if not found:
        return lines.select(*AT, F.lit(0).alias("level")).limit(0)
    return reduce(DataFrame.unionAll, found).groupBy(*AT).agg(F.max("level").alias("level"))


def later_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, copy, gone): per document with deletions, the numbers of the lines to delete."""
    lines = write_table(lines_of(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text")).frame
    blocks = later_blocks(lines).join(lines.select(*AT, "line", "words").distinct(), AT)
    along = Window.partitionBy(*DOC).orderBy("p")  # one document's lines
    reached = F.max(F.col("p") + F.pow(F.lit(2), F.col("level")).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("p") >= reached).cast("int"), F.lit(1))
    stretches = blocks.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(along))
    long_enough = F.sum("words").over(Window.partitionBy(*DOC, "stretch")) >= min_words
    return stretches.withColumn("goes", long_enough).where("goes").groupBy(*DOC).agg(F.collect_list("line").alias("gone"))


def without_later_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_lines, n_deleted) per row of `docs`: the row as it was, and its text without the stretches of lines that
    occurred before and have `min_words` words or more. A stretch is a maximal repeated run, or several that overlap.

    Order is by key (an integer; null last), then by text, then by line. A run may lie anywhere, also twice in one text. Rows that repeat with key and
    text are one document and share its result. Null texts stay null with 0 lines; blank lines are no part of a run and stay.
    """
    gone = later_lines(docs, key, text, min_words)
    packed = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text")).select("row", "text", *document())
    joined = packed.join(gone, DOC, "left")
    lines = F.split("text", "\n")

    def left(ls: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "gone"), lambda i: F.get(ls, i))

    kept = F.get(F.transform(F.array(lines), left), 0)  # the outer lambda holds the lines, so they are split once
    return joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_deleted"))
