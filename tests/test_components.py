import random

import pytest

from shelfmark.operators.components import components
from shelfmark.operators.entities import one_edit_apart


def plain(pairs):
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {x: root(x) for x in list(least)}


@pytest.mark.parametrize("seed,nodes,links", [(1, 300, 150), (2, 300, 400)])
def test_random_graphs(spark, seed, nodes, links):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(links)] + [("n1", "n1"), ("alone", "alone")]
    frame = spark.createDataFrame(pairs + pairs[:5] + [(None, "n1"), ("lost", None)], "a string, b string")
    found, _ = components(frame)
    assert {r.node: r.component for r in found.collect()} == plain(pairs)


def test_a_chain_of_ten_thousand(spark):
    chain = spark.range(9_999).selectExpr("id AS a", "id + 1 AS b")
    found, rounds = components(chain)
    assert rounds <= 32 and found.count() == 10_000 and found.where("component <> 0").isEmpty()
    star, few = components(spark.range(1, 20_000).selectExpr("0L AS a", "id AS b"))
    assert few <= 32 and star.where("component = 0").count() == 20_000


def test_no_pairs(spark):
    found, rounds = components(spark.createDataFrame([], "a int, b int"))
    assert rounds == 0 and found.count() == 0


def test_one_edit_apart(spark):
    names = ["Anna", "anna", "Ann", "Hanna", "Bnna", "Bob", "Rob", "Robe", "Zed", "A", "B", "", None]
    got = {(r.a, r.b) for r in one_edit_apart(spark.createDataFrame([(n,) for n in names], "name string")).collect()}

    def near(x, y):
        x, y = x.lower(), y.lower()
        if len(x) > len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) <= 1
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))

    named = [n for n in names if n]
    assert got == {(a, b) for a in named for b in named if a < b and near(a, b)}
