"""Vector table with versions: immutable generations of files, and a manifest per version that names them.

A write, an upsert or a deletion adds one generation and a manifest that lists it behind those of the version before; stored files are never changed, and nothing
shows before its manifest does. Rows of a generation are dealt by ranges of the id's hash into as many files as their size asks for, so tables that grow
get more ranges. A read takes the version's generations: rows of older ones whose id comes again later give way to the latest. Compaction writes the rows
of a version as one generation.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of vectors in one file, about.
FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class Generation:
    """A folder of rows (id, …, deleted); ids of one generation are distinct."""
    name: str
    rows: int


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _path(spark, path, "manifests")
    if not fs.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())


def _generations(spark: SparkSession, path: str, version: int) -> list[Generation]:
    """The few generations of a version, oldest first."""
    lines = spark.read.text(f"{path}/manifests/{version}").collect()
    return [Generation(**json.loads(r["value"])) for r in sorted(lines, key=lambda r: json.loads(r["value"])["name"])]


def _commit(spark: SparkSession, path: str, version: int, generations: list[Generation]) -> int:
    """The manifest is written aside and then renamed, which fails if the version exists."""
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    lines = [(json.dumps({"name": g.name, "rows": g.rows}),) for g in generations]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(draft)
    source, fs = _path(spark, draft)
    target, _ = _path(spark, path, "manifests", str(version))
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        raise Conflict(f"version {version} of {path} exists")
    return version


def _stored(rows: DataFrame, path: str, number: int) -> Generation:
    """Write rows (id, embedding, …, deleted) as a generation: the last row of an id wins, by ``order`` if there is such a column."""
    name = f"{number:010d}-{uuid.uuid4().hex}"
    values = F.struct(*[c for c in rows.columns if c not in ("id", "order")])
    latest = F.max_by(values, F.struct(F.col("order"), F.xxhash64(values)) if "order" in rows.columns else F.xxhash64(values))
    one_each = rows.where("id IS NOT NULL").groupBy("id").agg(latest.alias("v")).select("id", "v.*")
    sized = one_each.withColumn("_h", F.xxhash64("id"))
    estimate = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("embedding")), F.lit(0.0)).alias("d")).first()
    files = max(1, int(estimate["n"] * (estimate["d"] * 4 + 64)) // FILE_BYTES)
    folder = f"{path}/data/{name}"
    sized.repartitionByRange(files, "_h").sortWithinPartitions("_h").drop("_h").write.parquet(folder)
    return Generation(name, rows.sparkSession.read.parquet(folder).count())


def _add(rows: DataFrame, path: str, after: int | None, deleted: bool) -> int:
    spark = rows.sparkSession
    known = versions(spark, path)
    version = (known[-1] if known else 0) if after is None else after
    old = _generations(spark, path, version) if version else []
    new = _stored(rows.withColumn("deleted", F.lit(deleted)), path, version + 1)
    return _commit(spark, path, version + 1, [*old, new])


def upsert(rows: DataFrame, path: str, after: int | None = None) -> int:
    """Add or replace rows (id, embedding and further columns) by id and return the new version. Of rows with one id in ``rows`` that with the highest
    ``order`` stays, or without such a column any one, the same on every run; rows without an id are left out. With ``after`` it must be the version now in force,
    else ``Conflict`` is raised; a first upsert makes the table."""
    return _add(rows, path, after, False)


def delete(ids: DataFrame, path: str, after: int | None = None) -> int:
    """Delete the rows with the given ids."""
    return _add(ids.select("id", F.lit(None).cast("array<float>").alias("embedding")), path, after, True)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last. Ids of later generations, which are few beside the first, are joined against the earlier rows."""
    known = versions(spark, path)
    version = version or (known[-1] if known else 0)
    if version not in known:
        raise ValueError(f"{path} has no version {version}")
    parts, later = [], None
    for generation in reversed(_generations(spark, path, version)):
        rows = spark.read.parquet(f"{path}/data/{generation.name}")
        parts.append(rows if later is None else rows.join(later, "id", "left_anti"))
        ids = rows.select("id")
        later = ids if later is None else later.unionAll(ids)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reversed(parts))
    return whole.where("NOT deleted").drop("deleted")


def compact(spark: SparkSession, path: str) -> int:
    """One generation with the rows of the last version, as a new version. Older versions stay readable until ``expire``."""
    version = versions(spark, path)[-1]
    return _commit(spark, path, version + 1, [_stored(read(spark, path, version).withColumn("deleted", F.lit(False)), path, version + 1)])


def expire(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all versions but the last ``keep``, with the generations that no other version names, those of failed writes too. No writer may be at work."""
    known = versions(spark, path)
    for version in known[:-keep]:
        manifest, fs = _path(spark, path, "manifests", str(version))
        fs.delete(manifest, True)
    used = {g.name for v in known[-keep:] for g in _generations(spark, path, v)}
    folder, fs = _path(spark, path, "data")
    for entry in fs.listStatus(folder):
        if entry.getPath().getName() not in used:
            fs.delete(entry.getPath(), True)
