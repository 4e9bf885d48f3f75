import math
import random
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import whitening
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def whole(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def plain_covariance(xs):
    """straight from the definition, in fractions"""
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[i] for x in xs), n) for i in range(d)]
    return [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n for j in range(d)] for i in range(d)]


def check(got, vectors, components=32):
    """`got` rows against plain Python: deviations exact, whitened entries up to sign and the order of equal eigenvalues"""
    rows = {k: whole(v) for k, v in vectors.items() if usable(v)}
    n, d = len(rows), len(next(iter(rows.values())))
    x = np.array(list(rows.values()), dtype=float)
    sums = [sum(c) for c in zip(*rows.values())]
    k = min(components, d)
    assert len(got) == n * k
    white = np.zeros((n, k))
    place = {key: i for i, key in enumerate(rows)}
    for r in got:
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(rows[r[0]], sums))
        white[place[r[0]], r.component - 1] = r.whitened
    centred = x - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    explained = [next(r.explained for r in got if r.component == c + 1) for c in range(k)]
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-8)
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8
    assert 0 <= got[0].identity_error < 1e-8
    # projecting on whitened columns gives back eigenvectors of the covariance
    axes = centred.T @ white / n / np.sqrt(values[:k])
    assert np.allclose(cov @ axes, axes * values[:k], atol=1e-6 * values[0]) and np.allclose((axes ** 2).sum(axis=0), 1)


def test_query(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check(QUERIES["op13_whitening"](spark, SF).collect(), vectors)


def test_covariance_is_exact(spark):
    rng = random.Random(2)
    vectors = [[rng.uniform(-3000, 3000) * 10 ** rng.randrange(4) for _ in range(5)] for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(vectors)), "k int, v array<double>").repartition(7)
    x = whitening.whole_vectors(frame, "k", "v")
    n, sums, cov = whitening.covariance(x, 5)
    assert n == 60 and cov == plain_covariance([whole(v) for v in vectors]) and sums == [sum(c) for c in zip(*map(whole, vectors))]


def test_odd_rows(spark):
    rng = random.Random(4)
    vectors = {n: [rng.gauss(0, 1) for _ in range(6)] for n in range(50)}
    vectors |= {50: None, 51: [1.0, None, 0.0, 0.0, 0.0, 0.0], 52: [float("nan")] * 6, 53: [float("inf"), *[0.0] * 5], 54: vectors[3], 55: [0.0] * 6}
    frame = spark.createDataFrame([(k, v, k, "clash") for k, v in vectors.items()], "vec_id int, embedding array<float>, n int, x string")
    stored = {r.vec_id: r.embedding for r in frame.collect()}
    check(whitening.whiten(frame).collect(), stored)
    check(whitening.whiten(frame, components=2).collect(), stored, 2)
    mixed = frame.unionByName(spark.createDataFrame([(90, [1.0], 0, ""), (91, [], 0, "")], frame.schema))
    assert {r.vec_id for r in whitening.whiten(mixed).collect()} == {k for k, v in stored.items() if usable(v)}


@pytest.mark.parametrize("rows", [[], [None], [[]]])
def test_nothing_to_fit(spark, rows):
    frame = spark.createDataFrame([(1, r) for r in rows], "vec_id int, embedding array<float>")
    assert whitening.whiten(frame).collect() == []


def test_without_variance(spark):
    frame = spark.createDataFrame([(n, [1.0, float(n % 2), 2.0]) for n in range(10)] + [(None, [1.0, 0.0, 2.0])], "vec_id int, embedding array<float>")
    got = whitening.whiten(frame).collect()
    assert len(got) == 33 and all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-12
    same = whitening.whiten(frame.where("vec_id % 2 = 0")).collect()
    assert len(same) == 15 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in same)


def test_large_numbers():
    z = np.array([[(1 << 51) - 1, -(1 << 51)], [3, -(1 << 26)], [-5, (1 << 26) - 1]])
    assert whitening._square_sums(z) == [sum(int(v) ** 2 for v in c) for c in z.T]
