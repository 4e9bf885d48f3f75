"""Small literal lookups kept inside the expression, so no join or shuffle is planned for them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Value of ``key`` in a fixed table, or the default."""
    entries = F.create_map(*[F.lit(part) for item in table.items() for part in item])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True when the text holds at least one of the fixed strings."""
    return reduce(lambda a, b: a | b, [text.contains(needle) for needle in needles])


def first_case(cases: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first condition that holds."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def bare_ext(ext: Column) -> Column:
    """Lower-case extension without its dot."""
    return F.regexp_replace(F.lower(ext), r"^\.+", "")


def suffix(name: Column) -> Column:
    """Extension with its dot in lower case, empty for names without one (and for dot files)."""
    return F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)
