"""Inventory operators: triage, statistics, snapshots, migration checks, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.lookup import contains_any
from ..functions.naming import category_from_path, normal_path, path_key, paths_match
from ..functions.scoring import triage_status


def triage(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("status", triage_status(F.col("extension")))


def work_list(inventory: DataFrame, status: str, done: DataFrame, key: str, newest: str, limit: int) -> DataFrame:
    """Open rows of one status, newest first."""
    return (inventory.filter(F.col("status") == status).join(done.select(key), key, "left_anti")
            .orderBy(F.desc(newest), key).limit(limit))


def named_extension(ext: Column) -> Column:
    return F.when(F.coalesce(ext, F.lit("")) == "", "[no_extension]").otherwise(F.lower(ext))


def extension_stats(inventory: DataFrame, top: int = 20) -> DataFrame:
    """Top extensions by count and by size in one long table."""
    stats = inventory.groupBy(named_extension(F.col("extension")).alias("extension")).agg(
        F.count("*").alias("files"), F.sum("size_mb").alias("size_mb"))
    by_count = stats.orderBy(F.desc("files"), "extension").limit(top).withColumn("ranking", F.lit("count"))
    by_size = stats.orderBy(F.desc("size_mb"), "extension").limit(top).withColumn("ranking", F.lit("size"))
    return by_count.unionByName(by_size)


def inventory_flags(inventory: DataFrame) -> DataFrame:
    """Flags of each file: very large, deeply nested, suspicious word in the name."""
    name = F.lower("filename")
    return inventory.select(
        "path", "size_mb", "depth", (F.col("size_mb") > V.LARGE_FILE_MB).alias("is_large"),
        (F.col("depth") > V.DEEP_PATH_DEPTH).alias("is_deep"), contains_any(name, V.RED_FLAG_WORDS).alias("is_red_flag"))


def largest_files(inventory: DataFrame, above_mb: float = V.LARGE_FILE_MB, top: int = 20) -> DataFrame:
    return inventory.filter(F.col("size_mb") > above_mb).orderBy(F.desc("size_mb"), "path").limit(top)


def triage_report(triaged: DataFrame, ready_top: int = 20, ignored_top: int = 10) -> DataFrame:
    """Share of each status, then the most frequent extensions of ready and ignored files."""
    by_status = triaged.groupBy("status").agg(F.count("*").alias("files"))
    total = by_status.agg(F.sum("files").alias("n")).scalar()
    by_ext = triaged.groupBy("status", named_extension(F.col("extension")).alias("item")).agg(F.count("*").alias("files"))

    def top(status: str, n: int) -> DataFrame:
        return by_ext.filter(F.col("status") == status).orderBy(F.desc("files"), "item").limit(n)

    status_rows = by_status.select(F.lit("status").alias("section"), F.col("status").alias("item"), "files",
                                   F.round(F.lit(100.0) * F.col("files") / total, 2).alias("percent"))
    empty = F.lit(None).cast("double").alias("percent")
    ready = top("READY_FOR_INGEST", ready_top).select(F.lit("ready").alias("section"), "item", "files", empty)
    ignored = top("IGNORED", ignored_top).select(F.lit("ignored").alias("section"), "item", "files", empty)
    return status_rows.unionByName(ready).unionByName(ignored)


def capacity_estimate(inventory: DataFrame) -> DataFrame:
    """Counts and sizes of text, media and other files with processing hours and storage."""
    ext = F.lower("extension")
    kind = F.when(ext.isin(V.TEXT_EXTENSIONS), "text").when(ext.isin(V.MEDIA_EXTENSIONS), "media").otherwise("other")
    counted = inventory.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("size_mb").alias("size_mb"))
    seconds = F.create_map(*[F.lit(x) for item in V.SECONDS_PER_FILE.items() for x in item])[F.col("kind")]
    vector_kb = F.when(F.col("kind") == "text", 3).otherwise(0)
    return counted.select(
        "kind", "files", "size_mb", (F.col("files") * seconds / 3600).alias("hours"),
        (F.col("files") * vector_kb / 1024 / 1024).alias("vector_gb"), (F.col("files") / 1024 / 1024).alias("ledger_gb"))


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "path", value: str = "size_bytes") -> DataFrame:
    """New, changed, gone and same rows between two snapshots."""
    p, c = previous.select(key, F.col(value).alias("old_value")), current.select(key, F.col(value).alias("new_value"))
    change = (F.when(F.col("old_value").isNull(), "new").when(F.col("new_value").isNull(), "gone")
              .when(F.col("old_value") != F.col("new_value"), "changed").otherwise("same"))
    return p.join(c, key, "full_outer").withColumn("change", change)


def without_excluded(inventory: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Rows that lie under none of the roots. Each path meets the roots through its own ancestors, so
    this stays an equi-join however many roots there are."""
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    under = (inventory.select(path, F.explode(ancestors).alias("_at"))
             .join(roots.select(F.col(root).alias("_at")), "_at", "left_semi").select(path))
    return inventory.join(under, path, "left_anti")


def match_paths(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Pairs whose paths are equal after normalising, or whose left path ends with the right base name."""
    a = left.withColumn("_name", path_key(F.col(left_path)))
    b = right.withColumn("_name", path_key(F.col(right_path)))
    return a.join(b, "_name").filter(paths_match(F.col(left_path), F.col(right_path))).drop("_name")


def moved_by_user(ledger: DataFrame, seen: DataFrame) -> DataFrame:
    """Correction events: files now in a folder of another category than where they were put.
    ``seen`` holds sha256 and new_path."""
    joined = ledger.join(seen, "sha256").select(
        F.col("sha256").alias("file_hash"), F.col("original_filename").alias("filename"),
        category_from_path(F.col("current_path")).alias("predicted_category"),
        category_from_path(F.col("new_path")).alias("actual_category"),
        F.col("current_path").alias("predicted_path"), F.col("new_path").alias("actual_path"),
        F.col("confidence").alias("predicted_confidence"), F.lit("both").alias("correction_type"))
    return joined.filter(F.col("predicted_category") != F.col("actual_category"))


def verify_migration(source: DataFrame, target: DataFrame, mapping: DataFrame, check_hash: bool = True) -> DataFrame:
    """Issues of a copy: MISSING, SIZE_MISMATCH or CORRUPT. ``source`` holds root, rel_path, size_bytes
    and sha256; ``mapping`` root and target_root; ``target`` path, size_bytes and sha256."""
    expected = source.join(mapping, "root").withColumn("expected_path", F.concat_ws("/", "target_root", "rel_path"))
    t = target.select(F.col("path").alias("expected_path"), F.col("size_bytes").alias("_size"), F.col("sha256").alias("_hash"))
    issue = F.when(F.col("_size").isNull(), "MISSING").when(F.col("_size") != F.col("size_bytes"), "SIZE_MISMATCH")
    if check_hash:
        issue = issue.when(F.col("_hash") != F.col("sha256"), "CORRUPT")
    joined = expected.join(t, "expected_path", "left")
    return joined.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select("root", "rel_path", "expected_path", "issue")


def resolve_collisions(incoming: DataFrame, existing: DataFrame, stamp: str) -> DataFrame:
    """Decision for each incoming file: MOVED, SKIPPED (same content) or RESOLVED under a conflict name."""
    e = existing.select(F.col("path").alias("target_path"), F.col("sha256").alias("_hash"))
    renamed = F.regexp_replace("target_path", r"^(.*?)(\.[^./]*)?$", f"$1_CONFLICT_{stamp}$2")
    action = F.when(F.col("_hash").isNull(), "MOVED").when(F.col("_hash") == F.col("sha256"), "SKIPPED").otherwise("RESOLVED")
    joined = incoming.join(e, "target_path", "left").withColumn("action", action)
    return joined.withColumn(
        "final_path", F.when(F.col("action") == "RESOLVED", renamed).when(F.col("action") == "MOVED", F.col("target_path"))).drop("_hash")


def map_folders(files: DataFrame, folder: str, mapping: DataFrame, default_root: str) -> DataFrame:
    """Target folder by case-insensitive name; unmapped names go under a default bucket."""
    m = mapping.select(F.lower("folder").alias("_key"), "target")
    joined = files.withColumn("_key", F.lower(folder)).join(m, "_key", "left").drop("_key")
    return joined.withColumn("target", F.coalesce("target", F.concat(F.lit(default_root + "/"), F.col(folder))))


def reconcile(source: DataFrame, target: DataFrame, scope: str) -> DataFrame:
    """Per scope: files and bytes on both sides, what is missing, and whether the target is complete."""
    def totals(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(scope).agg(F.count("*").alias(f"{side}_files"), F.sum("size_bytes").alias(f"{side}_bytes"))

    both = totals(source, "source").join(totals(target, "target"), scope, "full_outer").na.fill(0)
    gb = F.lit(1024 ** 3).cast("double")
    complete = (F.col("target_files") >= F.col("source_files")) & (F.col("target_bytes") >= F.col("source_bytes"))
    return both.select(
        scope, "source_files", "target_files", "source_bytes", "target_bytes",
        F.when(complete, 0).otherwise(F.col("source_files") - F.col("target_files")).cast("bigint").alias("missing_files"),
        F.when(complete, 0.0).otherwise(F.round((F.col("source_bytes") - F.col("target_bytes")) / gb, 2)).alias("missing_gb"),
        complete.alias("complete"))


def sample_per_extension(inventory: DataFrame) -> DataFrame:
    """Median-size and smallest file of each extension; all files of extensions with fewer than two."""
    counts = inventory.groupBy("extension").agg(F.count("*").alias("n"))
    joined = inventory.join(counts, "extension")
    sizes = inventory.groupBy("extension", "size_bytes").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("extension").orderBy("size_bytes")
    below = sizes.withColumn("start", F.sum("k").over(upto) - F.col("k")).drop("k")
    # only the rows of the two size values that hold the wanted ranks are ranked by path
    ranked = joined.join(below, ["extension", "size_bytes"])
    middle = F.floor(F.col("n") / 2)
    last = F.col("n") - 1
    holds = F.col("start") <= middle
    best = ranked.groupBy("extension").agg(F.max(F.when(holds, F.col("start"))).alias("middle_start"))
    wanted = ranked.join(best, "extension").filter((F.col("start") == 0) | (F.col("start") == F.col("middle_start")) | (F.col("n") < 2))
    w = Window.partitionBy("extension", "start").orderBy("path")
    rank = F.col("start") + F.row_number().over(w) - 1
    return wanted.withColumn("rank", rank).filter(
        (F.col("n") < 2) | (F.col("rank") == middle) | (F.col("rank") == 0)).select("extension", "path", "size_bytes", "rank", "n")


def names_like(files: DataFrame, words: list[str], column: str = "original_filename") -> DataFrame:
    """Files whose name holds any of the words."""
    return files.filter(contains_any(F.lower(column), [w.lower() for w in words]))


def find_all_words(files: DataFrame, query: str, top_k: int, name: str = "original_filename", path: str = "original_path") -> DataFrame:
    """First files whose name or path holds every word of the query."""
    words = F.split(F.lit(query.lower()), " ")
    hit = F.forall(words, lambda w: F.lower(name).contains(w) | F.lower(path).contains(w))
    return files.filter(hit).orderBy(path).limit(top_k)


def normalised(files: DataFrame, path: str) -> DataFrame:
    return files.withColumn(path, normal_path(F.col(path)))
