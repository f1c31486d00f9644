"""Piece paths against the sentencepiece library, and round trips."""

import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridcast.llm import sentencepiece as S

MODEL = S.model_bytes()
ODD = "   ▁▁abetheionTHE\n\t\r\x0b\x00ßéñ漢字𝒳12.,²<s></s>|#$"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def texts(n=4000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(n)] + ["", " ", "a" * 5000, " " * 300, "²." * 20, "\n" * 9]


def test_paths_equal_the_library(library):
    machine = S.Machine(MODEL)
    for t in texts():
        if "\x00" not in t:
            assert machine.encode(t).tolist() == library.encode(t), repr(t)


def test_given_documents_equal_the_library(library, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = S.encoded(docs, MODEL, back="again").collect()
    assert all(r.ids == library.encode(r.text) and r.again == r.text for r in made)
    again = S.decoded(spark.createDataFrame([(r.ids,) for r in made], "ids array<int>"), MODEL).collect()
    assert [r.decoded for r in again] == [library.decode(r.ids) for r in made]


def test_round_trip():
    machine = S.Machine(MODEL)
    for t in texts(seed=2):
        assert machine.decode(machine.encode(t).tolist()) == t.replace("▁", " ")


def test_forgotten_words_are_found_again(monkeypatch):
    monkeypatch.setattr(S, "CACHE_WORDS", 7)
    machine, other = S.Machine(MODEL), S.Machine(MODEL)
    for t in texts(300):
        assert machine.encode(t).tolist() == np.concatenate([np.zeros(0, int), *[other.path(w) for w in other.coarse.findall(other.normalised(t))]]).tolist()


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def small_model(kind, fallback=True):
    names = [("<unk>", 0.0, 2)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    names += [(p, -s, 1) for p, s in (("▁", 3.0), ("a", 4.0), ("b", 4.5), ("ab", 5.0), ("ba", 6.5), ("aba", 6.75), ("▁ab", 7.25), ("c", 9.0))]
    pieces = [(1, message((1, n.encode()), (2, s), (3, k))) for n, s, k in names]
    return message(*pieces, (2, message((3, kind), (35, int(fallback)))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


def cheapest(machine, text, at=0):
    """The smallest weight over all paths, one by one."""
    if at == len(text):
        return 0.0
    costs = [machine.piece[text[at:e]] for e in range(at + 1, len(text) + 1) if text[at:e] in machine.piece]
    best = [-machine.scores[p] + cheapest(machine, text, at + len(machine.names[p])) for p in costs]
    if text[at] not in machine.piece:
        best.append(S.UNKNOWN_PENALTY - machine.lowest + cheapest(machine, text, at + 1))
    return min(best)


def weight(machine, text):
    return sum(-machine.scores[i] if machine.kinds[i] == S.NORMAL else S.UNKNOWN_PENALTY - machine.lowest for i in machine.path(text))


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_paths_are_shortest(fallback):
    machine, rng = S.Machine(small_model(S.UNIGRAM, fallback)), random.Random(3)
    for _ in range(200):
        t = machine.normalised("".join(rng.choices("abcab x", k=rng.randint(0, 11))))
        assert weight(machine, t) == pytest.approx(cheapest(machine, t))


def test_unfit_models_are_refused():
    with pytest.raises(ValueError):
        S.Machine(small_model(3))
    with pytest.raises(ValueError):
        S.Machine(message((3, message((2, b"map"), (5, 1)))))


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a", "z"), (3, "a", "z"), (4, "long \n" * 100_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = S.encoded(docs, MODEL, back="back")
    assert made.columns == ["doc_id", "text", "ids", "back"]
    assert sorted((r.doc_id, r.back) for r in made.collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert S.encoded(docs.where(F.lit(False)), MODEL).count() == 0
    assert S.decoded(spark.createDataFrame([(None,), ([],)], "ids array<int>"), MODEL).where("decoded IS NULL").count() == 1


def test_remembered_pairs_are_bounded(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices("etaoinshrdlu", k=3000)) for _ in range(6)]
    free, held = S.Machine(MODEL), S.Machine(MODEL)
    want = [free.encode(t).tolist() for t in texts]
    monkeypatch.setattr(S, "CACHE_PAIRS", 40)
    for text, ids in zip(texts, want):
        assert held.encode(text).tolist() == ids and len(held.pairs) <= 40 < len(free.pairs)
