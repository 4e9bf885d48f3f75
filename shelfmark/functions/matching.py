"""Matching-block similarity of two texts, in built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Stands for the characters of the right text that are too frequent to begin a block. A noncharacter, so no text has it.
MASK = "\uffff"
#: Right texts from this length on have frequent characters: those above one in a hundred.
LONG_TEXT = 200


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _search(top: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """State after a binary search of the largest size up to ``top``; ``step(state, size)`` gives the next state, whose fields lo
    and hi bound the size."""
    steps = F.greatest(F.lit(1), F.ceil(F.log2(top + 1))).cast("int")

    def halve(state: Column, _: Column) -> Column:
        return F.when(state["lo"] >= state["hi"], state).otherwise(step(state, F.shiftright(state["lo"] + state["hi"] + 1, 1)))

    return F.aggregate(F.sequence(F.lit(1), steps), start, halve)


def _pieces(text: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size))


def longest_block(left: Column, right: Column) -> Column:
    """Longest text that both hold, of several the first in ``left``; empty if they share no character. Common blocks of a size
    have common blocks of every smaller one, so the size is found by halving."""
    def step(state: Column, size: Column) -> Column:
        common = F.array_intersect(_pieces(left, size), _pieces(right, size))  # in the order of the left text
        return _let(common, lambda c: F.when(F.size(c) > 0, F.struct(size.alias("lo"), state["hi"].alias("hi"), F.get(c, 0).alias("block")))
                    .otherwise(F.struct(state["lo"].alias("lo"), (size - 1).alias("hi"), state["block"].alias("block"))))

    top = F.least(F.length(left), F.length(right))
    return _search(top, F.struct(F.lit(0).alias("lo"), top.alias("hi"), F.lit("").alias("block")), step)["block"]


def common_prefix(left: Column, right: Column) -> Column:
    """Number of characters both begin with."""
    def step(state: Column, size: Column) -> Column:
        same = F.substr(left, F.lit(1), size) == F.substr(right, F.lit(1), size)
        return F.struct(F.when(same, size).otherwise(state["lo"]).alias("lo"), F.when(same, state["hi"]).otherwise(size - 1).alias("hi"))

    top = F.least(F.length(left), F.length(right))
    return _search(top, F.struct(F.lit(0).alias("lo"), top.alias("hi")), step)["lo"]


def _masked(text: Column) -> Column:
    def rare(size: Column) -> Column:
        frequent = F.filter(F.array_distinct(F.split(text, "")), lambda c: size - F.length(F.replace(text, c, F.lit(""))) > F.floor(size / 100) + 1)
        return F.when(size >= LONG_TEXT, _let(frequent, lambda f: F.call_function(
            "translate", text, F.array_join(f, ""), F.repeat(F.lit(MASK), F.size(f))))).otherwise(text)

    return _let(F.length(text), rare)


def _split(part: Column) -> Column:
    """Size of the block of a pair and the pairs of what lies before and after it."""
    x, y, m = part["x"], part["y"], part["m"]

    def around(block: Column) -> Column:
        return F.struct(F.position(block, x).alias("i"), F.position(block, m).alias("j"), F.length(block).alias("n"))

    def grown(at: Column) -> Column:
        def before(text: Column, first: Column) -> Column:
            return F.reverse(F.substr(text, F.lit(1), first - 1))

        back = F.when(m == y, 0).otherwise(common_prefix(before(x, at["i"]), before(y, at["j"])))
        ahead = F.when(m == y, 0).otherwise(common_prefix(F.substr(x, at["i"] + at["n"]), F.substr(y, at["j"] + at["n"])))
        return F.struct((at["i"] - back).alias("i"), (at["j"] - back).alias("j"), back.alias("back"), ahead.alias("ahead"), at["n"].alias("n"))

    def cut(at: Column) -> Column:
        size = at["back"] + at["n"] + at["ahead"]
        first = F.lit(1)
        left = F.struct(F.substr(x, first, at["i"] - 1).alias("x"), F.substr(y, first, at["j"] - 1).alias("y"), F.substr(m, first, at["j"] - 1).alias("m"))
        right = F.struct(F.substr(x, at["i"] + size).alias("x"), F.substr(y, at["j"] + size).alias("y"), F.substr(m, at["j"] + size).alias("m"))
        rest = F.filter(F.array(left, right), lambda p: (size > 0) & (p["x"] != "") & (p["y"] != ""))
        return F.struct(size.alias("size"), rest.alias("rest"))

    return _let(_let(_let(longest_block(x, m), around), grown), cut)


def matching_ratio(left: Column | str, right: Column | str) -> Column:
    """Twice the characters in matching blocks over the characters of both texts; 1 for two empty ones, null counts as empty.

    The longest common block matches, of several the first in the left text and there the first in the right; what lies before it on
    both sides is compared the same way, and what lies after. Characters that make up more than a hundredth of a right text of 200
    characters or more begin no block, they only lengthen one. All pieces of a level are split in one step; texts must not hold U+FFFF.
    Time grows with the length times its logarithm and the block's size, so this is for names, titles and summaries."""
    def plain(text: Column | str) -> Column:
        return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def blocks(pair: Column) -> Column:
        def level(state: Column, _: Column) -> Column:
            def collected(parts: Column) -> Column:
                matched = F.aggregate(parts, state["matched"], lambda s, p: s + p["size"])
                return F.struct(F.flatten(F.transform(parts, lambda p: p["rest"])).alias("todo"), matched.alias("matched"))

            return F.when(F.size(state["todo"]) == 0, state).otherwise(_let(F.transform(state["todo"], _split), collected))

        start = F.struct(F.array(F.struct(pair["x"].alias("x"), pair["y"].alias("y"), _masked(pair["y"]).alias("m"))).alias("todo"),
                         F.lit(0).alias("matched"))
        deepest = F.least(F.length(pair["x"]), F.length(pair["y"])) + 1
        matched = F.aggregate(F.sequence(F.lit(1), deepest), start, level)["matched"]
        total = F.length(pair["x"]) + F.length(pair["y"])
        return F.when(total == 0, 1.0).when(pair["x"] == pair["y"], 1.0).otherwise(2 * matched / total)

    return _let(F.struct(plain(left).alias("x"), plain(right).alias("y")), blocks)
