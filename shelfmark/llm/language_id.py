"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language inside the tasks, sums them by (language, bucket) and turns them into one matrix of log
probabilities, which is broadcast. Prediction builds a sparse count row per text and multiplies it with the matrix in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import field, keyed_texts, map_rows

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
#: Bound of the broadcast matrix; languages times buckets times four bytes must stay below it. While it is made, the driver holds three times as much.
MATRIX_BYTES = 64 << 20
#: Cells (buckets of texts times languages) that are weighed at a time.
CELLS = 1 << 21
UNKNOWN = "und"
#: Characters of a text are worked on in slices of this many; sums do not depend on it.
SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Log probability per bucket and language, and the log prior; languages in alphabetical order."""
    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray


def bucket_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts per bucket of all character n-grams of the text in lower case, blanks folded to one space."""
    folded = " " + " ".join(text.lower().split()) + " "
    counts = np.zeros(buckets, dtype=np.int64)
    widest = max(ORDERS)
    for start in range(0, len(folded), SLICE):
        piece = folded[start:start + SLICE + widest - 1]
        last = start + SLICE >= len(folded)
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        value = np.zeros(len(points), dtype=np.uint64)
        for order in range(1, widest + 1):
            n = len(points) - order + 1
            if n <= 0:
                break
            value = value[:n] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1:]
            if order not in ORDERS:
                continue
            mixed = (value + np.uint64(order)) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed ^= mixed >> np.uint64(29)
            own = mixed if last else mixed[:SLICE]
            counts += np.bincount((own % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return counts


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) once per task; bucket -1 counts texts."""
    sums: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            counts = bucket_counts(text.as_py().decode("utf-8", "replace"))
            sums[lang] = sums[lang] + counts if lang in sums else counts
            texts[lang] = texts.get(lang, 0) + 1
    for lang, counts in sums.items():
        at = np.nonzero(counts)[0]
        buckets, n = np.append(at, -1), np.append(counts[at], texts[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at) + [lang]), pa.array(buckets), pa.array(n)], ["lang", "bucket", "n"])


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a language as bytes of BUCKETS + 1 whole numbers, the texts first."""
    for batch in batches:
        for lang, cells in zip(batch.column("lang").to_pylist(), batch.column("cells")):
            dense = np.zeros(BUCKETS + 1, np.int64)
            dense[cells.values.field("bucket").to_numpy() + 1] = cells.values.field("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([dense.tobytes()])], ["lang", "packed"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> Model:
    """Learn from every row with text and language. The driver receives the summed counts alone, a packed array per language, whose
    size is checked first; an empty table gives a model without languages."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count_partition, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells")).mapInArrow(_pack_counts, "lang string, packed binary").persist()
    try:
        n_languages = packed.count()
        if n_languages * BUCKETS * 4 > MATRIX_BYTES:
            raise ValueError(f"{n_languages} languages need more than {MATRIX_BYTES} bytes; give fewer labels or fewer buckets")
        found = sorted(((r.lang, np.frombuffer(r.packed, np.int64)) for r in packed.toLocalIterator()), key=lambda x: x[0])
    finally:
        packed.unpersist()
    names = tuple(lang for lang, _ in found)
    cells = [column for _, column in found]
    table = np.stack([c[1:] for c in cells], axis=1).astype(np.float64) if found else np.zeros((BUCKETS, 0))
    n_texts = np.array([c[0] for c in cells], dtype=np.float64)
    table += smoothing
    log_prob = np.log(table / table.sum(axis=0)).astype(np.float32) if found else table.astype(np.float32)
    return Model(names, log_prob, np.log(n_texts / max(1, n_texts.sum())) if found else n_texts)


def score_batch(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """Language and its posterior for each text: sparse rows of counts (row starts, buckets, counts) times the matrix."""
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    counts = [bucket_counts(text) for text in texts]
    at = [np.nonzero(c)[0] for c in counts]
    most = max(1, CELLS // len(model.languages))
    totals, first = np.zeros((len(texts), len(model.languages))), 0
    while first < len(texts):
        last, cells = first, 0
        while last < len(texts) and (last == first or cells + len(at[last]) <= most):
            cells += len(at[last])
            last += 1
        some = range(first, last)
        data = np.concatenate([counts[i][at[i]] for i in some])
        weighted = model.log_prob[np.concatenate([at[i] for i in some])] * data[:, None].astype(np.float64)
        totals[first:last] = np.add.reduceat(weighted, np.cumsum([0, *(len(at[i]) for i in some)])[:-1], axis=0)
        first = last
    totals += model.log_prior
    best = totals.argmax(axis=1)
    posterior = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] for b in best], posterior.tolist()


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) per row of `docs`, from the text alone. `und` with score 0 where the text is null or has no letter, or where
    nothing was learned; equal posteriors go to the alphabetically first language. Repeated rows give repeated rows, other
    columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch):
        texts = [t.decode("utf-8", "replace") if t else "" for t in batch.column("text").to_pylist()]
        spoken = [i for i, t in enumerate(texts) if _LETTER.search(t)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if spoken:
            for i, lang, score in zip(spoken, *score_batch([texts[i] for i in spoken], shared.value)):
                langs[i], scores[i] = lang, score
        return {"lang_pred": langs, "score": scores}

    rows = map_rows(keyed_texts(docs, key, text), per_batch, [field("lang_pred", "string"), field("score", "double")], rows=256)
    return rows.withColumnRenamed("key", key)


def split_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; remainder 1 is held out. A null key has no remainder: it is neither learned from nor held out."""
    return F.crc32(key.cast("string").cast("binary")) % 3
