"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; `parse_model` reads the parts that encoding needs and `build` rebuilds from them the normaliser,
the metaspace marker, the merges (BPE) or unigram scores, and byte fallback. Tasks get the file's bytes by broadcast.

Where no piece has the marker behind another character, no merge and no best path crosses the start of a marker run, so a text's ids
are its segments' ids one after the other (a segment: a marker run and what follows it). Each task then encodes only segments
it has not seen, whole batches at a time and multithreaded; other models encode whole texts. The parity check compares every encoded string
with the sentencepiece library.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field as data_field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.common import ARROW, field, keyed_texts

MARKER = "▁"
#: Bound of the broadcast model file.
MODEL_BYTES = 64 << 20
#: Segments a task remembers; when there are more it forgets them all and goes on, which costs time only.
REMEMBERED = 1_000_000
#: Characters encoded in one call, so that memory does not depend on the batch.
CALL_CHARS = 4 << 20
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN_PIECE, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = data_field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False
    byte_fallback: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message: varints as numbers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield tag >> 3, data[at:at + size]
        at += size


def parse_model(data: bytes) -> Model:
    """Pieces, model type, normaliser settings and byte fallback of a model file."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.whitespace_as_suffix = bool(trainer.get(24, 0))
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(_fields(value))
            model.charsmap = rules.get(2, b"")
            model.add_dummy_prefix = bool(rules.get(3, 1))
            model.remove_extra_whitespaces = bool(rules.get(4, 1))
            model.escape_whitespaces = bool(rules.get(5, 1))
    if model.kind not in (UNIGRAM, BPE) or model.whitespace_as_suffix or not model.escape_whitespaces or any(k == USER_DEFINED for *_, k in model.pieces):
        raise ValueError("only unigram and BPE models with a leading marker and without user-defined pieces are supported")
    return model


def build(model: Model):
    """A tokenizers Tokenizer over normalised texts (see `normalise`)."""
    from tokenizers import Tokenizer, models

    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN_PIECE)
    if model.kind == UNIGRAM:
        return Tokenizer(models.Unigram([(piece, score) for piece, score, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback))
    joinable = {piece for piece, _, kind in model.pieces if kind == NORMAL}
    merges = []
    for piece in joinable:
        for cut in range(1, len(piece)):
            if piece[:cut] in joinable and piece[cut:] in joinable:
                merges.append((-model.pieces[ids[piece]][1], ids[piece[:cut]], ids[piece[cut:]], piece[:cut], piece[cut:]))
    merges.sort()
    return Tokenizer(models.BPE(vocab=ids, merges=[(a, b) for *_, a, b in merges], unk_token=model.pieces[unknown][0],
                                fuse_unk=True, byte_fallback=model.byte_fallback))


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, data: bytes, verify: bool, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = parse_model(data)
        self.tokenizer = build(self.model)
        self.by_segment = not any(re.search(f"[^{MARKER}]{MARKER}", piece) for piece, _, _ in self.model.pieces)
        self.ids = {piece: i for i, (piece, _, _) in enumerate(self.model.pieces)}
        runs = [score for piece, score, _ in self.model.pieces if len(piece) > 1 and not piece.strip(MARKER)]
        heads = [score for piece, score, _ in self.model.pieces if piece[:1] == MARKER and piece.strip(MARKER)]
        #: The library ranks pairs; where marker runs of equal score compete, the model's rule is the leftmost pair. Runs can be
        #: merged apart from the word behind them if words take their marker first.
        self.runs_apart = (self.model.kind == BPE and self.by_segment and max(runs, default=-np.inf) < min(heads, default=np.inf)
                           and not any(re.match(f"{MARKER}{MARKER}+[^{MARKER}]", piece) for piece in self.ids))
        self.run_ids: dict[int, list[int]] = {}
        self.normaliser = None
        if self.model.charsmap:
            from tokenizers import normalizers

            self.normaliser = normalizers.Precompiled(self.model.charsmap)
        self.bytes = [self._surface(piece, kind) for piece, _, kind in self.model.pieces]
        self.known: dict[str, list[int]] = {}
        self.differing: set[str] = set()
        self.original = None
        if verify:
            import sentencepiece

            self.original = sentencepiece.SentencePieceProcessor(model_proto=data)

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN_PIECE:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARKER, " ").encode()

    def normalise(self, text: str) -> str:
        """The text as the model sees it, with markers for blanks."""
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        if self.model.remove_extra_whitespaces:
            text = re.sub(" +", " ", text.replace(MARKER, " ")).strip(" ")
        if text and self.model.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", MARKER)

    def segments(self, text: str) -> list[str]:
        """Keys of a text's segments: what follows a single marker, or, behind a blank, a segment as it is."""
        seen = self.normalise(text)
        if not self.by_segment:
            return [" " + seen] if seen else []
        if seen[:1] == MARKER and MARKER + MARKER not in seen and seen[-1:] != MARKER:
            return seen.split(MARKER)[1:]
        return [" " + s for s in re.findall(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+", seen)]

    def _learn(self, new: list[str]) -> None:
        """Encode segments not seen yet."""
        strings = [s[1:] if s[:1] == " " else MARKER + s for s in new]
        words = [MARKER + s.lstrip(MARKER) if self.runs_apart and s[:2] == MARKER + MARKER else s for s in strings]
        for key, string, word, found in zip(new, strings, words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            ids = found.ids
            if word is not string:
                more = len(string) - len(word)
                alone = ids[0] == self.ids[MARKER]  # the word did not take its marker
                ids = self._run(more + 1) + ids[1:] if alone else self._run(more) + ids
            self.known[key] = ids
        if self.original is not None and self.model.add_dummy_prefix:
            # the original puts the first marker itself, but none before an empty string
            for key, string, want in zip(new, strings, self.original.encode([s.removeprefix(MARKER) for s in strings])):
                if want != self.known[key] and string != MARKER:
                    self.differing.add(key)

    def _run(self, n: int) -> list[int]:
        """Ids of n markers: the pair whose piece has the highest score is merged first, of equals the leftmost."""
        if n not in self.run_ids:
            sizes, follows, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            heap: list[tuple[float, int, int, int]] = []

            def offer(at: int) -> None:
                if at >= 0 and follows[at] < n:
                    piece = MARKER * (sizes[at] + sizes[follows[at]])
                    if piece in self.ids:
                        heapq.heappush(heap, (-self.model.pieces[self.ids[piece]][1], at, sizes[at], sizes[follows[at]]))

            for at in range(n):
                offer(at)
            while heap:
                _, at, left, right = heapq.heappop(heap)
                after = follows[at]
                if sizes[at] != left or after >= n or sizes[after] != right:
                    continue
                sizes[at], sizes[after], follows[at] = left + right, 0, follows[after]
                if follows[at] < n:
                    before[follows[at]] = at
                offer(at)
                offer(before[at])
            self.run_ids[n] = [self.ids[MARKER * size] for size in sizes if size]
        return self.run_ids[n]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text and whether the original library gives the same."""
        split = [self.segments(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.differing.clear()
        new = list({s for segments in split for s in segments if s not in self.known})
        start, size = 0, 0
        for at, segment in enumerate(new):
            size += len(segment)
            if size > CALL_CHARS or at == len(new) - 1:
                self._learn(new[start:at + 1])
                start, size = at + 1, 0
        known = self.known
        ids = [[i for s in segments for i in known[s]] for segments in split]
        equal = [not self.differing or self.differing.isdisjoint(segments) for segments in split]
        return ids, equal

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each, the marker of the dummy prefix goes."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        if self.model.add_dummy_prefix and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _each_bad_byte(data)


def _each_bad_byte(data: bytes) -> str:
    """UTF-8 with U+FFFD for every single byte that is not part of a character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[at:at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


def load(path: str) -> bytes:
    """The model file, read by the driver; its size is checked since tasks get it by broadcast."""
    with open(path, "rb") as file:
        data = file.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    parse_model(data)
    return data


def _list_array(values: list[list[int] | None]) -> pa.Array:
    sizes = [len(v) if v is not None else 0 for v in values]
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.fromiter((i for v in values if v is not None for i in v), dtype=np.int32, count=int(offsets[-1]))
    mask = pa.array([v is None for v in values])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)


def _run(df: DataFrame, data: bytes, fields: list[T.StructField], per_batch, verify: bool, threads: int, rows: int = 256) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(data)
    names = [f.name for f in fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(shared.value, verify, threads)
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = per_batch(codec, part)
                arrays = [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], ARROW[f.dataType.simpleString()]) for n, f in zip(names, fields)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *arrays], ["key", *names])

    return df.mapInArrow(apply, T.StructType([df.schema["key"], *fields]))


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return [None if t is None else t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", verify: bool = True, threads: int = 2) -> DataFrame:
    """(key, n_tokens, ids, round_trip, parity) per row of `docs`. round_trip: decoding the ids gives the text as the normaliser leaves it;
    parity: the sentencepiece library gives the same ids (null without `verify`). A null text has null ids, 0 tokens and both true;
    an empty one has no ids. Repeated rows give repeated rows, other columns are ignored."""
    def per_batch(codec: Codec, batch: pa.RecordBatch) -> dict:
        texts = _texts(batch)
        ids, equal = codec.encode([t or "" for t in texts])
        back = [codec.decode(i) for i in ids]
        plain = [codec.normalise(t or "").replace(MARKER, " ") for t in texts]
        same = [b == (p[1:] if codec.model.add_dummy_prefix else p) for b, p in zip(back, plain)]
        return {"n_tokens": [len(i) for i in ids], "ids": _list_array([None if t is None else i for t, i in zip(texts, ids)]),
                "round_trip": same, "parity": equal if verify else [None] * len(equal)}

    fields = [field("n_tokens", "bigint"), field("ids", "array<int>"), field("round_trip", "boolean"), field("parity", "boolean")]
    return _run(keyed_texts(docs, key, text), load(model_path), fields, per_batch, verify, threads).withColumnRenamed("key", key)


def decode(rows: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) per row; null ids give a null text, no ids an empty one. An id outside the vocabulary is an error."""
    def per_batch(codec: Codec, batch: pa.RecordBatch) -> dict:
        return {"text": [None if i is None else codec.decode(i) for i in batch.column("ids").to_pylist()]}

    packed = rows.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids")
    return _run(packed, load(model_path), [field("text", "string")], per_batch, False, 1).withColumnRenamed("key", key)
