"""Names and paths: smart file names, folder targets, path translation, path matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .lookup import base_name, suffix


def first_category(category: Column) -> Column:
    """Part of a category before ``|`` and ``/``."""
    return F.trim(F.split_part(F.split_part(category, F.lit("|"), F.lit(1)), F.lit("/"), F.lit(1)))


def smart_filename(name: Column, category: Column, entity: Column, date: Column) -> Column:
    """``date_Category_Entity.ext`` with unsafe characters replaced and the entity cut at 30."""
    ext = suffix(name)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(ext))
    chosen = F.when(F.coalesce(entity, F.lit("")) != "", entity).otherwise(stem)
    safe = F.substring(F.regexp_replace(chosen, V.NAME_RUNS, "_"), 1, 30)
    label = F.regexp_replace(first_category(category), V.NAME_RUNS, "")
    return F.concat(date, F.lit("_"), label, F.lit("_"), safe, ext)


def target_folder(category: Column, root: str = "/archive") -> Column:
    """Folder of a category; unknown ones go to the default."""
    label = first_category(category)
    return F.concat(F.lit(root + "/"), F.when(label.isin(V.CATEGORIES), label).otherwise(V.DEFAULT_CATEGORY))


def translate_path(path: Column, host_prefix: str = "", mount: str = "/mnt/data") -> Column:
    """Windows and host paths to paths under the mount point; others pass through."""
    tail = F.replace(F.substr(path, F.lit(3)), F.lit("\\"), F.lit("/"))
    if host_prefix[1:2] == ":":
        drive_root = F.when(F.upper(F.substring(path, 1, 1)) == host_prefix[0].upper(), mount).otherwise("/mnt/data")
    else:
        drive_root = F.lit("/mnt/data")
    out = F.when(path.rlike(r"^[A-Za-z]:[/\\]"), F.concat(drive_root, tail))
    if host_prefix:
        out = out.when(
            path.startswith("/") & ~path.startswith("/mnt/") & path.startswith(host_prefix),
            F.concat(F.lit(mount), F.substr(path, F.lit(len(host_prefix) + 1))))
    return out.otherwise(path)


def category_from_path(path: Column) -> Column:
    """First path component that starts with a known category, else the default."""
    def known(part: Column) -> Column:
        return reduce(lambda a, b: a | b, [part.startswith(name) for name in V.PATH_CATEGORIES])

    return F.coalesce(F.get(F.filter(F.split(path, r"[/\\]"), known), F.lit(0)), F.lit(V.DEFAULT_CATEGORY))


def normal_path(path: Column) -> Column:
    return F.trim(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))


def path_key(path: Column) -> Column:
    """Base name used as the equi-join key of path matching."""
    return base_name(normal_path(path))


def paths_match(source: Column, target: Column) -> Column:
    """Equal after normalising, or the source ends with the target's base name."""
    s, t = normal_path(source), normal_path(target)
    return (s != "") & (t != "") & ((s == t) | s.endswith(F.concat(F.lit("/"), base_name(t))))
