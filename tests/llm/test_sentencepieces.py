import random
import struct

import pytest
import sentencepiece

from shelfmark.llm import sentencepieces as sp
from shelfmark.llm.queries import MODEL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def original():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query_equals_original_library(spark, original):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_sentencepiece"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == original.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip and r.parity


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "   a   b   ", "\n\n", "\ta b", "▁x ▁", "x▁▁y", "日本語 テキスト", "👩‍👩‍👧 é", "<s> </s> <unk> <0x0A>",
       "\x00\x01", "�", "ab" * 5000, " " * 3000, "don't 1234567"]


def test_odd_texts_and_decoding(spark, original):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" ▁aé\n漢1") for _ in range(rng.randrange(40))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 2), (None, "x", 3), (0, "", 4)], "doc_id bigint, text string, ids int")
    rows = sp.encode(docs, MODEL)
    back = {(r.doc_id, r.text) for r in sp.decode(rows, MODEL).collect()}
    got = rows.collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r.doc_id is None:
            assert r.ids is None and r.n_tokens == 0 and r.round_trip or r.ids == original.encode("x")
            continue
        want = original.encode(texts[r.doc_id])
        assert r.ids == want and r.parity and r.round_trip, texts[r.doc_id]
        assert (r.doc_id, original.decode(want)) in back
    assert (None, None) in back
    assert sp.encode(docs.limit(0), MODEL).count() == 0


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3]) + bytes([value]) if number < 16 else bytes([(number << 3) & 127 | 128, number >> 4, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            size = len(value)
            out += bytes([number << 3 | 2]) + bytes([size & 127 | 128, size >> 7]) + value
    return out


@pytest.mark.parametrize("crossing", [False, True])
def test_unigram_with_byte_fallback(crossing):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("▁a", -3.0, 1), ("ab", -3.5, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("▁abc", -9.0, 1), ("c", -5.0, 1)]
    if crossing:
        pieces.append(("b▁a", -3.0, 1))
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (35, 1)))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sp.Codec(data, True, 1)
    assert codec.by_segment is not crossing
    texts = ["abc", "ab abc a", "cab  b", "é a", "b a b a", "aaab abab", ""]
    ids, equal = codec.encode(texts)
    assert ids == [original.encode(t) for t in texts] and all(equal)
    assert [codec.decode(i) for i in ids] == texts


def test_bad_bytes_decode_like_the_original(original):
    codec = sp.Codec(sp.load(MODEL), False, 1)
    first = next(i for i in range(300) if original.id_to_piece(i) == "<0x00>")
    for data in (b"\xe2\x82", b"a\xff\xfeb", "é".encode()[:1] + b"x"):
        ids = [first + b for b in data]
        assert codec.decode(ids) == original.decode(ids)
