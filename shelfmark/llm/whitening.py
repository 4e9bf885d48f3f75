"""Whitening of embeddings with an exact covariance by polarisation.

Entries become whole numbers x. With n vectors and sums S, n * x - S is the centred entry times n, also a whole number; its square is summed for every dimension,
and so is the square of the sum of two centred entries for every pair of dimensions. The variance of a sum less the two variances is twice
the covariance. All sums are exact: a task adds squares as limbs of 26 bits to Python's whole numbers, Spark adds the tasks' sums as decimals of 38 digits.
The driver gets one number for each pair of dimensions and decomposes the matrix; vectors are projected in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
#: Most dimensions of a matrix on the driver: 8 million pairs.
MOST_DIMENSIONS = 4096
#: Cells of a task's working array.
CELLS = 1 << 20
_LIMB = 26


@dataclass(frozen=True)
class Whitening:
    """n vectors, sums per dimension, components as columns by falling eigenvalue, trace of the covariance."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def defined(self, k: int) -> np.ndarray:
        """The first components whose eigenvalue is not zero up to rounding."""
        most = self.values[0] if len(self.values) else 0.0
        return np.flatnonzero(self.values[:k] > max(0.0, most) * len(self.values) * 2.0 ** -50)


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): vectors of finite entries as whole numbers floor(SCALE * c) + SHIFT. Those that are null or hold null or non-finite entries go. Entries beyond
    1e17 raise an error."""
    entries = F.col("v").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    usable = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).where(F.col("v").isNotNull() & ~F.exists(entries, bad))
    return usable.select("key", F.transform(entries, lambda c: F.when(~bad(c), (F.floor(SCALE * c) + SHIFT).cast("bigint"))).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            yield batch.column("key"), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly. Raises where it needs more than 51 bits."""
    near = [s // n for s in sums]
    rest = np.array([s - n * m for s, m in zip(sums, near)], np.int64)
    away = x - np.array(near, np.int64)
    if len(away) and int(np.abs(away).max()) * n >= 1 << 50:
        raise OverflowError("vectors too many or too far apart for exact sums")
    return n * away - rest


def _square_sums(z: np.ndarray) -> list[int]:
    """Exact sums of squares per column of at most 1,024 numbers below 2**52 each."""
    high, low = z >> _LIMB, z & ((1 << _LIMB) - 1)
    parts = ((high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0))
    return [(int(a) << 2 * _LIMB) + (int(b) << _LIMB + 1) + int(c) for a, b, c in zip(*parts)]


def _polarised(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's sums of squares: of each dimension (i = j), and of the sum of each two."""
    totals = [0] * len(i)
    for _, x in _matrices(batches, max(1, min(1024, CELLS // len(i)))):
        y = centred(x, n, sums)
        z = y[:, i]
        z[:, i != j] += y[:, j[i != j]]
        totals = [a + b for a, b in zip(totals, _square_sums(z))]
    kind = pa.decimal128(38, 0)
    yield pa.record_batch({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "squares": pa.array([Decimal(t) for t in totals], kind)})


def _most_common_size(x: DataFrame) -> int:
    """Entries of most vectors, the larger number of two that are as common; 0 if there are none."""
    first = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    return first["d"] if first else 0


def covariance(x: DataFrame, dimensions: int) -> tuple[int, list[int], list[list[Fraction]]]:
    """(n, sums, covariance) of the vectors (key, x) of `dimensions` entries, exact, divisor n."""
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions, at most {MOST_DIMENSIONS} can be decomposed on the driver")
    per_dimension = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    n, sums = per_dimension[0]["n"], [int(r["s"]) for r in per_dimension]
    i, j = np.triu_indices(dimensions)
    per_task = x.mapInArrow(lambda b: _polarised(b, n, sums, i, j), "i int, j int, squares decimal(38,0)")
    squares = {(r["i"], r["j"]): int(r["s"]) for r in per_task.groupBy("i", "j").agg(F.sum("squares").alias("s")).collect()}
    cov = [[Fraction(0)] * dimensions for _ in range(dimensions)]
    for (a, b), s in squares.items():
        twice = 2 * s if a == b else s - squares[a, a] - squares[b, b]
        cov[a][b] = cov[b][a] = Fraction(twice, 2 * n ** 3)
    return n, sums, cov


def fit(x: DataFrame, dimensions: int) -> Whitening:
    n, sums, cov = covariance(x, dimensions)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    return Whitening(n, sums, values[::-1].copy(), vectors[:, ::-1].copy(), float(sum(cov[d][d] for d in range(dimensions))))


def _whitened(x: np.ndarray, model: Whitening, components: np.ndarray) -> np.ndarray:
    return (centred(x, model.n, model.sums) / model.n) @ (model.vectors[:, components] / np.sqrt(model.values[components]))


def identity_error(x: DataFrame, model: Whitening, k: int) -> float | None:
    """Largest entry of |covariance of the whitened vectors - identity|. A task centres its rows by its own means, and the tasks' means are centred by
    the mean of all, before anything is multiplied. None if no component is defined."""
    chosen = model.defined(k)
    if not len(chosen):
        return None
    a, b = np.triu_indices(len(chosen))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moments = 0, np.zeros(len(chosen)), np.zeros((len(chosen), len(chosen)))
        for _, part in _matrices(batches, max(1, CELLS // len(model.sums))):
            w = _whitened(part, model, chosen)
            m = len(w)
            step = w.mean(axis=0) - mean
            own = w - w.mean(axis=0)
            moments += own.T @ own + np.outer(step, step) * (n * m / (n + m))
            mean, n = mean + step * (m / (n + m)), n + m
        if n:
            yield pa.record_batch({"a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32)), "n": pa.array([n] * len(a), pa.int64()),
                                   "ma": pa.array(mean[a]), "mb": pa.array(mean[b]), "c": pa.array(moments[a, b])})

    parts = x.mapInArrow(per_task, "a int, b int, n bigint, ma double, mb double, c double")
    total = F.sum("n")
    mean_of = lambda c: F.sum(F.col(c) * F.col("n")) / total
    entry = (F.sum("c") + F.sum(F.col("n") * F.col("ma") * F.col("mb")) - total * mean_of("ma") * mean_of("mb")) / total
    wanted = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    return parts.groupBy("a", "b").agg(entry.alias("v")).agg(F.max(F.abs(F.col("v") - wanted))).first()[0]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per usable vector and component.

    The fit list is all vectors without null or non-finite entries; null vectors go. Vectors whose size differs from that of most (the larger
    of two equally common) go too. Repeated rows count and stay each. deviation is null beyond 64 bits; whitened is null on components whose
    variance is zero up to rounding, and so is explained if all are. An empty table, or vectors without entries, give no rows. Other columns are ignored.
    """
    x = whole_vectors(rows, key, vector)
    d = _most_common_size(x)
    x = x.where(F.size("x") == d)
    schema = T.StructType([T.StructField(key, x.schema["key"].dataType), *T._parse_datatype_string(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")])
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    model = fit(x, d)
    k = min(components, d)
    chosen = model.defined(k)
    error = identity_error(x, model, k)
    explained = [float(v / model.trace) if model.trace else None for v in model.values[:k]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part in _matrices(batches, max(1, min(1024, CELLS // d))):
            m = len(part)
            y = centred(part, model.n, model.sums)
            bound = int(np.abs(y).max(initial=0))
            sums = (y * y).sum(axis=1).tolist() if bound * bound * d < 1 << 63 else [sum(int(v) ** 2 for v in row) for row in y]
            spread = np.repeat(np.arange(m), k)
            white, known = np.zeros((m, k)), np.zeros((m, k), bool)
            white[:, chosen], known[:, chosen] = _whitened(part, model, chosen), True
            yield pa.record_batch([
                keys.take(pa.array(spread)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([model.n] * (m * k), pa.int64()),
                pa.array([s if s < 1 << 63 else None for s in sums], pa.int64()).take(pa.array(spread)), pa.array(white.ravel(), mask=~known.ravel()),
                pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())], schema.names)

    return x.mapInArrow(apply, schema)

