"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (white space to
the visible space mark, a mark before the text), the pieces, and the byte
fallback of characters that no piece covers. Their composition with a text is a
lattice whose arcs are pieces; the encoding is its shortest path in the
tropical semiring, where weights add along a path and the smallest sum wins.

For a unigram model an arc weighs minus the piece's log probability. For a
merge (BPE) model the pieces are composed with one machine more, whose states
are the last piece: an arc weighs 0 if the two neighbouring pieces are what
merging makes of their joint text, and infinity otherwise. Exactly one path of
finite weight remains, and it is the one that merging the whole text gives.

No piece has a space mark after another character, holds a character such as a
line end that only bytes encode, or reaches from a letter to a sign (but for a
few pairs, which are looked for), so lattices fall apart there without loss: the
shortest path is found word by word, and common words are remembered. Paths take
time and memory in proportion to the text, of any length.

Defined cases. Null text counts as empty and has no pieces. Rows are encoded one
by one, so repeated rows have equal results and empty tables give empty results.
Decoding is exact but for a literal space mark (U+2581), which reads as a space.
An existing column of the result's name is replaced; other columns are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format.
UNIGRAM, MERGE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: More pairs of letter and sign than this within pieces, and words are not cut at signs.
MOST_ACROSS = 200
#: Words that a worker remembers, twice, and the longest one remembered.
CACHE_WORDS = 250_000
CACHE_CHARS = 48
#: Pairs of pieces of which a worker remembers whether one may follow the other.
CACHE_PAIRS = 300_000
#: Rows handed on at once.
OUT_ROWS = 512


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Machine:
    """The compiled transducers of one model."""

    def __init__(self, model: bytes):
        self.kind, self.prefix, self.squeeze = UNIGRAM, True, True
        names, scores, kinds = [], [], []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                if rules.get(2) or not rules.get(5, 1):
                    raise ValueError("only normalisers without a character map, that mark spaces, are compiled")
        if self.kind not in (UNIGRAM, MERGE):
            raise ValueError("only unigram and merge models have pieces with weights")
        if USER in kinds:
            raise ValueError("user-defined pieces are not compiled")
        self.names, self.scores, self.kinds = names, scores, kinds
        self.piece = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == NORMAL}
        self.trie: dict = {}
        for name, number in self.piece.items():
            node = self.trie
            for c in name:
                node = node.setdefault(c, {})
            node[""] = number
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(n[1:-1], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == BYTE}
        self.lowest = min((scores[i] for i in self.piece.values()), default=0.0)
        self._compile_words()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spelt = [
            b"" if k == CONTROL else bytes([int(n[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else n.replace(MARK, " ").encode()
            for n, k in zip(names, kinds)
        ]

    def _compile_words(self) -> None:
        """Where lattices fall apart: no piece reaches over these places."""
        self.fine = self.coarse = re.compile("(?s).+")
        self.reaching = None  # places at which the fine rule would cut a piece
        if any(MARK in n.lstrip(MARK) for n in self.piece):
            return
        used = {c for n in self.piece for c in n} - {MARK}
        alone = "".join(re.escape(chr(c)) for c in range(33) if chr(c) not in used)
        signs = {c for c in used if not c.isalpha() and not c.isdecimal()}
        across = {n[i : i + 2] for n in self.piece for i in range(len(n) - 1) if MARK not in n[i : i + 2] and (n[i] in signs) != (n[i + 1] in signs)}
        first = f"[{alone}]|" if alone else ""
        self.coarse = self.fine = re.compile(f"{first}{MARK}*[^{MARK}{alone}]+|{MARK}+")
        if signs and len(across) <= MOST_ACROSS:
            sign = "".join(map(re.escape, sorted(signs)))
            self.fine = re.compile(f"{first}{MARK}*[^{MARK}{alone}{sign}]+|{MARK}*[{sign}]+|{MARK}+")
            self.reaching = re.compile("|".join(map(re.escape, sorted(across)))) if across else None

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                number = self.piece.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or self.scores[number] > best):
                    best, at = self.scores[number], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, last: int, number: int) -> bool:
        """Whether a piece may follow another one, or -1: nothing, or bytes."""
        parts = [self.names[number]] if last < 0 else [self.names[last], self.names[number]]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()  # in place: paths under way hold it too
        fits = self.pairs[last, number] = self.merged("".join(parts)) == parts
        return fits

    def path(self, word: str) -> list[int]:
        """Pieces of the shortest path; -1 stands for a character that is spelt in bytes."""
        size, trie, merge, pairs = len(word), self.trie, self.kind == MERGE, self.pairs
        cost, last, back = [0.0] + [np.inf] * size, [-1] * (size + 1), [0] * (size + 1)
        for start in range(size):
            node, end, here, before = trie, start, cost[start], last[start]
            while end < size:
                node = node.get(word[end])
                if node is None:
                    break  # no piece begins like this
                end += 1
                number = node.get("")
                if number is None:
                    continue
                if merge:
                    if not cost[end]:
                        continue
                    fits = pairs.get((before, number))
                    if fits is None:
                        fits = self._fits(before, number)
                    if fits:
                        cost[end], last[end], back[end] = 0.0, number, start
                elif here - self.scores[number] < cost[end]:
                    cost[end], last[end], back[end] = here - self.scores[number], number, start
            if word[start] not in self.piece:
                weight = 0.0 if merge else here - self.lowest + UNKNOWN_PENALTY
                if weight < cost[start + 1]:
                    cost[start + 1], last[start + 1], back[start + 1] = weight, -1, start
        found, at = [], size
        while at:
            found.append((last[at], word[back[at] : at]))
            at = back[at]
        out = []
        for number, text in reversed(found):
            if number >= 0:
                out.append(number)
            else:
                out += [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]
        return out

    def parts(self, word: str) -> list[str]:
        """A word cut at signs, unless a piece reaches over the cut."""
        if self.reaching is not None and self.reaching.search(word):
            return [word]
        return self.fine.findall(word)

    def _word(self, word: str) -> bytes:
        made = self.known.get(word)
        if made is not None:
            return made
        made = self.older.get(word)
        if made is None:
            parts = self.parts(word)
            if len(parts) > 1:
                made = b"".join(map(self._word, parts))
            else:
                made = np.array(self.path(word), dtype=np.int32).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = made
        return made

    def encode(self, text: str | None) -> np.ndarray:
        words = self.coarse.findall(self.normalised(text or ""))
        out = list(map(self.known.get, words))
        if None in out:
            out = [x or self._word(w) for x, w in zip(out, words)]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        spelt = self.spelt
        text = b"".join([spelt[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def machine(model: bytes) -> Machine:
    """Compiled once in each worker."""
    return Machine(model)


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read on the driver; tasks get its bytes, which do not grow with the data."""
    with open(path, "rb") as f:
        return f.read()


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.append_column(name, column) if at < 0 else batch.set_column(at, name, column)


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    field = T.StructField(name, kind)
    fields = [field if f.name == name else f for f in df.schema]
    return T.StructType(fields if name in df.columns else [*fields, field])


def encoded(docs: DataFrame, model: bytes, text: str = "text", to: str = "ids", back: str | None = None) -> DataFrame:
    """The rows with their piece numbers, and with the text decoded again if `back` names a column for it."""
    schema = _schema(docs, to, T.ArrayType(T.IntegerType()))
    at = docs.columns.index(text)
    if back is not None:
        schema = _schema(docs.sparkSession.createDataFrame([], schema), back, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(model)
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                found = [compiled.encode(t.as_py()) for t in part.column(at)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                out = _with(part, to, ids)
                if back is not None:
                    out = _with(out, back, pa.array([compiled.decode(x.tolist()) for x in found], pa.string()))
                yield out

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with the text of their piece numbers; null for null."""
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(model)
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                texts = [compiled.decode(x.as_py()) if x.is_valid else None for x in part.column(at)]
                yield _with(part, to, pa.array(texts, pa.string()))

    return rows.mapInArrow(run, _schema(rows, to, T.StringType()))


def readable(text: Column) -> Column:
    """The text as decoding gives it back."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
