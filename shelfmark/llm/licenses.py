"""Licence texts in documents: MinHash bands over overlapping windows find templates, shingle containment confirms them.
DataFrame operations only.

Templates fall into classes by their number of five-word shingles, up to 1, 2, 4, 8, ... For class c a document is covered by windows of 2c shingles that
start every c shingles, so every stretch of c shingles lies whole in one window. A window's set holds its shingles that some template of
the class has: others can neither match nor, left out, push a template's minimum aside. At 80 % containment the Jaccard similarity of such a
window and the template is at least 0.8 (c / 2) / (2 c + 0.1 c) = 0.19, and 64 bands of one row find it with probability
1 - (1 - 0.19) ** 64 > 0.999998; with nothing but the template in the window it is 0.8 or more and a miss has probability 1e-44.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, document
from shelfmark.llm.license_texts import TEMPLATES
from shelfmark.llm.tables import write_table

SHINGLE = 5
CONTAINED = 0.8
BANDS = 64
#: Template shingles are broadcast up to this number (about 40 bytes each); more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000
#: What separates words: everything but ASCII letters, digits and characters beyond ASCII.
SEPARATOR = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def _hashes(text: Column) -> Column:
    words = F.filter(F.split(ascii_lower(text), SEPARATOR), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., i, s): the shingles of column text with their place."""
    hashed = rows.select(*keep, _hashes(F.col("text")).alias("h")).where(F.size("h") >= SHINGLE)
    placed = hashed.select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - SHINGLE)).alias("i"))
    return placed.select(*keep, "i", F.xxhash64(*(F.get("h", F.col("i") + o) for o in range(SHINGLE))).alias("s"))


def _bands(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., band, value): the MinHash of the shingles s of each group, one row a band."""
    minima = rows.groupBy(*keys).agg(*(F.min(F.xxhash64(F.lit(b), "s")).alias(f"m{b}") for b in range(BANDS)))
    return minima.select(*keys, F.posexplode(F.array(*(F.col(f"m{b}") for b in range(BANDS)))).alias("band", "value"))


def scan(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """(key, license, containment, start): one row per document and template of which a window holds at least `contained` of the distinct
    five-word shingles; containment is that of the best window, start the first matched shingle (in words, from 0) of it, the first of equals.

    `templates` is (license, text); texts of fewer than five words find nothing. Null texts find nothing; repeated rows, and rows with the
    same key, give one row per template; other columns are ignored.
    """
    spark = docs.sparkSession
    templates = templates if templates is not None else default_templates(spark)
    named = templates.select("license", "text").where("license IS NOT NULL AND text IS NOT NULL")
    own = _shingles(named, "license").select("license", "s").distinct()
    sized = own.join(own.groupBy("license").agg(F.count("*").alias("n")), "license")
    shingles = write_table(sized.select("license", "s", "n", F.pow(F.lit(2.0), F.ceil(F.log2("n") - 1e-9)).cast("bigint").alias("c"))).frame
    known = shingles.select("s", "c").distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").select("key", "text", *document())
    hits = _shingles(rows, "d", "copy", "key").join(known, "s")
    index = F.floor(F.col("i") / F.col("c")).cast("bigint")
    window = ["d", "copy", "key", "c", "w"]
    inside = write_table(hits.select("d", "copy", "key", "c", "i", "s", F.explode(F.array(index, index - 1)).alias("w")).where("w >= 0")
                         .groupBy(*window, "s").agg(F.min("i").alias("i"))).frame

    found = _bands(inside, *window).join(_bands(shingles, "license", "c"), ["c", "band", "value"]).select(*window, "license").distinct()
    window_free = [c for c in window if c != "key"]
    matched = inside.join(found.drop("key"), window_free).join(shingles.select("license", "s", "n"), ["license", "s"])
    held = matched.groupBy(*window, "license", "n").agg(F.count("*").alias("same"), F.min("i").alias("start")).where(F.col("same") >= F.col("n") * contained)
    best = held.groupBy("key", "license").agg(F.max(F.struct((F.col("same") / F.col("n")).alias("containment"), (-F.col("start")).alias("back"))).alias("b"))
    return best.select(F.col("key").alias(key), "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).cast("bigint").alias("start"))
