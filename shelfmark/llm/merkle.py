"""Merkle manifest of a dataset: a tree of digests per group of rows, a tree over the groups, and the proof of every row.

A digest is the lowercase hex SHA-256 of its inputs one after the other. Rows of a group are leaves in the order of their key; every FAN_OUT consecutive nodes
become their digest until one is left, and the groups' last nodes are the leaves of the upper tree. Every run of up to FAN_OUT nodes is stored as one
row (id, children, parent, ordinal): its nodes, the run its own digest lies in, and the place there.

A recursive query climbs from the leaves to the root. Leaves of one run have the same nodes above them, so they climb in one row, each with a digest of its
own: a step joins the stored run, appends the siblings and folds the digest of every leaf. Runs near the root are met by many rows; they are
stored in as many copies as their share of the rows asks for, and a row goes to the copy its id hashes to. Climbing rows hold digests as bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tables import Table, drop_table, write_table

FAN_OUT = 16
#: Climbing rows for each copy of a stored run.
ROWS_A_COPY = 4096
TOP = -1  # the tree over the groups


def encoded(value: Column) -> Column:
    """`-` for null, else the size in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def _digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, "").cast("binary"), 256)


def _run_id(tree: Column, level: int, place: Column) -> Column:
    return F.concat_ws("/", tree.cast("string"), F.lit(level), place.cast("string"))


def _half(size: str = "size") -> Column:
    return F.expr(f"({size} + {FAN_OUT - 1}) div {FAN_OUT}")


@dataclass(frozen=True)
class Manifest:
    """bundles: the lowest runs with their rows; runs: all others, in copies; groups: the group numbers with their last nodes; root: None if there is no row."""
    bundles: DataFrame
    runs: DataFrame
    groups: DataFrame
    root: str | None


def _numbered(rows: DataFrame) -> tuple[Table, DataFrame]:
    """Leaves with tree (number of the group), pos (place in it) and size (of it). One range sort; places come from row numbers within its parts and
    from the parts' counts, so no group has to be in one part."""
    sorted_rows = rows.orderBy("grp", "k", "leaf", "found")
    number = F.monotonically_increasing_id()  # part of the sort in the upper bits, row in the lower 33
    table = write_table(sorted_rows.withColumns({"part": F.shiftright(number, 33).cast("int"), "i": number.bitwiseAND((1 << 33) - 1)}))
    counts = write_table(table.frame.groupBy("part", "grp").agg(F.min("i").alias("first"), F.count("*").alias("n"))).frame
    # groups are numbered like their rows: by the part they begin in, then by place there
    begins = counts.groupBy("grp").agg(F.min("part").alias("part"), F.sum("n").alias("size"))
    per_part = begins.groupBy("part").agg(F.count("*").alias("n"))
    ahead = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row for each part
    trees = begins.join(ahead, "part").select(
        "grp", "size", (F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1).alias("tree"))
    offsets = counts.join(trees, "grp").select(
        "part", "grp", "tree", "size", (F.sum("n").over(Window.partitionBy("grp").orderBy("part")) - F.col("n") - F.col("first")).alias("offset"))
    placed = table.frame.join(offsets, ["part", "grp"]).select("k", "leaf", "found", "tree", "size", (F.col("i") + F.col("offset")).alias("pos"))
    return table, placed


def _climb_levels(nodes: DataFrame, level: int, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs above `nodes` (tree, pos, size, hash, width), level by level, and the nodes that are the last of their tree."""
    made, last = [], [nodes.where("size = 1")]
    while largest > 1:
        level, largest = level + 1, -(-largest // FAN_OUT)
        place = F.expr(f"pos div {FAN_OUT}")
        runs = nodes.where("size > 1").groupBy("tree", place.alias("pos"), _half().alias("size")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "hash"))).getField("hash").alias("children"), F.sum("width").alias("width"))
        runs = write_table(runs.select("tree", "pos", "size", "children", "width", _digest(F.col("children")).alias("hash"),
                                       _run_id(F.col("tree"), level, F.col("pos")).alias("id"), F.lit(level).alias("level"))).frame
        made.append(runs)
        nodes = runs
        last.append(nodes.where("size = 1"))
    return made, reduce(DataFrame.unionByName, (x.select("tree", "hash", "width") for x in last))


def build(rows: DataFrame, key: Column, group: Column, values: list[Column], seen: list[Column] | None = None) -> Manifest:
    """The manifest of `rows`: a leaf is the digest of `values`, leaves of a `group` (null is one, the first) ascend by `key`, equal keys by digest; repeated
    rows are leaves each. `seen` are the values as they are found at a later time, whose digests `climb` folds; without them the same values."""
    text = group.cast("string")
    named = rows.select(key.alias("k"), F.coalesce(F.concat(F.lit("="), text), F.lit("")).alias("grp"), leaf(values).alias("leaf"), leaf(seen or values).alias("found"))
    sorted_rows, placed = _numbered(named)
    member = F.struct("pos", "k", "leaf", "found")
    low = placed.groupBy("tree", F.expr(f"pos div {FAN_OUT}").alias("pos"), "size").agg(F.sort_array(F.collect_list(member)).alias("rows"))
    digest = F.when(F.col("size") == 1, F.col("rows")[0]["leaf"]).otherwise(_digest(F.col("rows.leaf")))
    bundles = write_table(low.select("tree", "pos", _half().alias("size"), (F.col("size") == 1).alias("alone"), "rows", digest.alias("hash"),
                                     F.lit(1).cast("bigint").alias("width"), _run_id(F.col("tree"), 1, F.col("pos")).alias("id"), F.lit(1).alias("level"))).frame
    drop_table(sorted_rows)
    largest = bundles.agg(F.max("size")).first()[0] or 0
    inner, ends = _climb_levels(bundles, 1, largest)
    groups = write_table(ends).frame
    n_groups = groups.count()
    top, last = _climb_levels(groups.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(n_groups).cast("bigint").alias("size"), "hash", "width"), 0, n_groups)
    root = last.first()
    columns = ["id", "tree", "pos", "size", "level", "children", "width"]
    above = bundles.select(*columns[:5], F.col("rows.leaf").alias("children"), "width").limit(0)
    above = reduce(DataFrame.unionByName, (r.select(*columns) for r in [*inner, *top]), above)
    # where a run's digest lies: the next run of its tree, or as the last of its tree a run over the groups
    in_tree = F.col("size") > 1
    to_top = (F.col("tree") != TOP) & F.lit(n_groups > 1)
    place = F.expr(f"(CASE WHEN size > 1 THEN pos ELSE tree END) div {FAN_OUT}").cast("string")
    parent = F.when(in_tree, F.concat_ws("/", F.col("tree").cast("string"), (F.col("level") + 1).cast("string"), place)).when(to_top, F.concat_ws("/", F.lit(f"{TOP}/1"), place))
    ordinal = F.expr(f"cast((CASE WHEN size > 1 THEN pos ELSE tree END) % {FAN_OUT} AS int)")
    copies = above.select(F.col("id").alias("parent"), (F.expr(f"width div {ROWS_A_COPY}") + 1).alias("copies"))

    def linked(runs: DataFrame) -> DataFrame:
        return runs.withColumns({"parent": parent, "ordinal": ordinal}).join(copies, "parent", "left")

    stored = linked(above).withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr(f"width div {ROWS_A_COPY}"))))
    runs = write_table(stored.select("id", "copy", "children", "parent", "ordinal", "copies")).frame
    return Manifest(linked(bundles), runs, groups, root["hash"] if root else None)


CLIMB = """WITH RECURSIVE climb(bundle, parent, ordinal, copies, folded, proof) AS (
  SELECT id, parent, ordinal, copies, folded, CAST('' AS BINARY) FROM {start}
  UNION ALL
  SELECT c.bundle, r.parent, r.ordinal, r.copies,
    transform(c.folded, f -> unhex(sha2(CAST(array_join(transform(r.children, (x, i) -> IF(i = c.ordinal, lower(hex(f)), x)), '') AS BINARY), 256))),
    concat(c.proof, unhex(array_join(filter(r.children, (x, i) -> i <> c.ordinal), '')))
  FROM climb c JOIN {runs} r ON c.parent = r.id AND pmod(hash(c.bundle), c.copies) = r.copy)
SELECT bundle, folded, proof FROM climb WHERE parent IS NULL"""
_LIMIT = "spark.sql.cteRecursionRowLimit"


def climb(manifest: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded) per leaf: proof is the digest of all siblings from the leaf's run up to the root, left to
    right, folded the root that follows from the digest found. No rows give no rows."""
    spark = manifest.bundles.sparkSession
    children = F.col("rows.leaf")
    # the first run, in which every leaf has siblings of its own
    folded = F.transform("rows.found", lambda f, i: _digest(F.transform(children, lambda x, j: F.when(i == j, f).otherwise(x))))
    start = write_table(manifest.bundles.select("id", "parent", "ordinal", "copies", F.transform(F.when(F.col("alone"), F.col("rows.found")).otherwise(folded), F.unhex).alias("folded")))
    before = spark.conf.get(_LIMIT, None)
    spark.conf.set(_LIMIT, "-1")  # the limit guards against queries without an end; this one ends at the root
    try:
        climbed = write_table(spark.sql(CLIMB, start=start.frame, runs=manifest.runs)).frame
    finally:
        spark.conf.unset(_LIMIT) if before is None else spark.conf.set(_LIMIT, before)
    drop_table(start)
    rows = manifest.bundles.select(F.col("id").alias("bundle"), "tree", "rows").join(climbed, "bundle").join(
        manifest.groups.select("tree", F.col("hash").alias("subroot")), "tree")
    siblings = F.transform(F.col("rows.leaf"), lambda x, i: F.array_join(F.filter(F.col("rows.leaf"), lambda y, j: i != j), ""))
    each = rows.select("subroot", "proof", F.explode(F.arrays_zip("rows", "folded", siblings.alias("siblings"))).alias("x"))
    return each.select(F.col("x.rows.k").alias("key"), F.col("x.rows.leaf").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"),
                       F.sha2(F.concat("x.siblings", F.lower(F.hex("proof"))).cast("binary"), 256).alias("proof"), F.lower(F.hex("x.folded")).alias("folded"))
