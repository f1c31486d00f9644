"""Removal of passages that an earlier document holds, by range-partitioned suffix sorting.

Every byte is removed that a string of `SPAN` bytes covers which also starts in
a document with a smaller doc_id. Strings are compared as they stand in the
input, over all documents and whole texts.

Suffixes are taken at anchors only: of the tokens of `TOKEN` bytes in a string,
the one with the smallest hash is its anchor, the leftmost of equals. Equal
strings have equal anchors at equal places, so it is enough to compare suffixes
that start at anchors, together with the bytes before them; there is about one
anchor in 18 bytes. An anchor stands for a run of strings, those that it is the
anchor of.

1. Anchors whose token occurs in one document only can match nothing. Their
   hashes, packed, are dealt out by hash range; tokens of two and more documents
   are reported back to their rows. A block packs one list per group of ranges,
   `GROUPS` at most; where there are more ranges than groups, a second deal cuts
   the groups, so a block's work does not depend on their number.
2. The suffixes at the anchors that remain are dealt out by leading token, in
   ranges whose splitters, `SPLITTERS` at most, are drawn from a sample of
   documents; where a range would be larger than a bucket may be, its tokens are
   dealt out by their hash. Splitters lie between tokens, so equal strings never
   lie on two sides of a boundary, and there is nothing to compare across one.
3. Each bucket sorts its suffixes, and the reversed bytes before them, by keys
   of eight bytes, the most significant first: only suffixes that are still
   equal go on to the next key, as in multikey quicksort, but numpy sorts the
   keys. Common prefixes of neighbours then give, for every place of the anchor
   in a string, the classes of equal strings.
4. In a class, all strings but those of its smallest doc_id are covered. The
   runs go back to their documents, which cut them out.

Many copies of a passage do not meet in one task: each block of some `BLOCK`
bytes hands on one copy only, that of its smallest doc_id; the others are
covered whatever other blocks hold, and their runs go straight back.

Memory: a task holds a block, or one bucket, whose size does not grow with the
corpus unless one token of `TOKEN` bytes stands in ever more different contexts:
that token stays in one bucket. Long documents are cut into pieces of `PIECE`
strings that overlap by a string.

Defined cases. Null text counts as empty. Texts under `SPAN` bytes lose nothing.
Rows with the same doc_id are pieces of one document, and lose nothing to one
another; each is told of its own tokens and runs only. A null doc_id counts as larger than any other. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.session import shuffle_partitions, stored

SPAN = 50
TOKEN = 16
PLACES = SPAN - TOKEN + 1  # where an anchor can stand in a string
REACH = PLACES - 1  # bytes before an anchor that a string can hold
WIDTH = REACH + SPAN
BLOCK = 1 << 20
PIECE = 1 << 20
#: Documents cut and handed on at once.
OUT_ROWS = 256
#: Documents that splitters are drawn from, about, and their tokens kept.
SAMPLE_DOCS = 4000
SAMPLE_TOKENS = 200_000
#: Text bytes behind a bucket of token hashes, and behind one of suffixes.
HASH_BUCKET = 16 << 20
SUFFIX_BUCKET = 8 << 20
#: Lists that a block packs of its token hashes, and token hashes cut at once in the second deal.
GROUPS = 256
REGROUPED = 1 << 20
#: Ranges of leading tokens; beyond, tokens of a range are dealt out by hash.
SPLITTERS = 4096
LAST_ID = (1 << 63) - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


# --- numbers as bytes ---------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of long numbers, byte by byte so that small ones take little room."""
    out = [np.int64(len(columns)).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c).astype(np.int64, copy=False)
        out += [np.int64(len(c)).tobytes(), np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 8, []
    for _ in range(int(np.frombuffer(data[:8], np.int64)[0])):
        size = int(np.frombuffer(data[at : at + 8], np.int64)[0])
        planes = np.frombuffer(data, np.uint8, size * 8, at + 8).reshape(8, size)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).ravel())
        at += 8 + size * 8
    return out


# --- anchors of a block of texts ----------------------------------------------------------------


class Block:
    """Pieces of texts side by side, and the runs of strings by their anchors."""

    def __init__(self, pieces: list[tuple]):
        """pieces: (doc_id, number of the row in its task, place of the piece in the row, bytes, tokens, row)."""
        self.doc, self.number, self.place, self.row = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1, 2, 5))
        lengths = np.array([len(p[3]) for p in pieces], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.data = np.frombuffer(b"".join([p[3] for p in pieces]) + bytes(WIDTH + 16), np.uint8)
        size = int(lengths.sum())
        self._hash(size)
        fits = np.flatnonzero(lengths >= SPAN)
        inside = np.zeros(size + 1, np.int8)
        np.add.at(inside, self.starts[fits], 1)
        np.add.at(inside, (self.starts + lengths)[fits] - SPAN + 1, -1)
        strings = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) > 0)
        anchors = self._anchors(size)[strings] if len(strings) else strings
        new = np.ones(len(strings), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (strings[1:] != strings[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(strings)] - 1 if len(first) else first
        self.anchor, self.low, self.high = anchors[first].astype(np.int64), strings[first], strings[last]
        self.piece = np.searchsorted(self.starts, self.low, "right") - 1
        # pieces without bytes share a start with the next one
        token = self.hash[self.anchor] * _ODD[3]
        self.token = ((token ^ (token >> np.uint64(31))) >> np.uint64(9)).astype(np.int64)
        del self.hash

    def _words(self, size: int, shift: int) -> np.ndarray:
        return np.ndarray((size,), "<u8", buffer=self.data, offset=shift, strides=(1,))

    def _hash(self, size: int) -> None:
        h = self._words(size, 8) * _ODD[1]
        h ^= self._words(size, 0)
        h *= _ODD[0]
        h ^= h >> np.uint64(29)
        h *= _ODD[2]
        h ^= h >> np.uint64(32)
        self.hash = h

    def _anchors(self, size: int) -> np.ndarray:
        """For the string at each byte, the place of its token with the smallest hash."""
        least = (self.hash >> np.uint64(32)).astype(np.uint32)
        at = np.arange(size, dtype=np.int32)
        wide = 1
        while wide < PLACES:
            step = min(wide, PLACES - wide)
            if len(least) <= step:
                break
            right = least[step:]
            other = right < least[:-step]
            at = np.where(other, at[step:], at[:-step])
            least = np.minimum(least[:-step], right)
            wide += step
        out = np.zeros(size, np.int32)
        out[: len(at)] = at
        return out

    def leading(self, runs: np.ndarray) -> np.ndarray:
        """The first eight bytes of the suffixes, as numbers in the order of the bytes."""
        return self._words(len(self.data) - 8, 0)[self.anchor[runs]].byteswap()

    def strings(self, runs: np.ndarray) -> np.ndarray:
        """Rows of `WIDTH` bytes: before the anchor and from it on; zero beyond what the run covers."""
        data = np.concatenate([np.zeros(REACH, np.uint8), self.data])
        rows = data[self.anchor[runs, None] + np.arange(WIDTH)]
        return np.where(covered(self.anchor[runs] - self.low[runs], self.anchor[runs] - self.high[runs]), rows, 0)


def covered(most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which of the `WIDTH` bytes runs cover whose anchors stand at places least to most."""
    column = np.arange(WIDTH)
    return (column >= REACH - most[:, None]) & (column < WIDTH - least[:, None])


def _pieces(batches: Iterator[pa.RecordBatch], block: int, piece: int) -> Iterator[list[tuple]]:
    """Pieces (doc_id, number, place, bytes, tokens, row) of `block` bytes in all, from rows (doc_id, text, row, tokens)."""
    held, size, number = [], 0, 0
    for batch in batches:
        ids, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for row, text in enumerate(batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            extra = batch.column(3)[row] if batch.num_columns > 3 else None
            for at in range(0, max(len(data) - SPAN + 1, 0), piece):
                part = data[at : at + piece + SPAN - 1]
                held.append((int(ids[row]), number, at, part, extra, int(rows[row])))
                size += len(part)
                if size >= block:
                    yield held
                    held, size = [], 0
            number += 1
    if held:
        yield held


# --- 1. tokens of two and more documents ---------------------------------------------------------


def _bucket_width(buckets: int) -> int:
    return -(-(1 << 55) // buckets)


def _token_hashes(buckets: int, sizes: tuple[int, int]):
    """Lists (group of buckets, kind 0, tokens with their rows) and (some group, kind 1, rows with tokens known to be shared)."""
    groups = min(buckets, GROUPS)

    def run(batches):
        width = _bucket_width(buckets)
        for pieces in _pieces(batches, *sizes):
            block = Block(pieces)
            if not len(block.token):
                continue
            order = np.argsort(block.token, kind="stable")  # pieces of a row stay side by side
            token, piece = block.token[order], block.piece[order]
            doc, row, number = block.doc[piece], block.row[piece], block.number[piece]
            new = np.r_[True, token[1:] != token[:-1]]
            own = new | np.r_[True, number[1:] != number[:-1]]  # once for each row
            group = np.cumsum(new) - 1
            several = np.zeros(int(group[-1]) + 1, bool)
            several[group[1:][(doc[1:] != doc[:-1]) & ~new[1:]]] = True
            shared = np.flatnonzero(several[group] & own)
            kept = np.flatnonzero(new | own & ~several[group])
            place = (token[kept] // width) * groups // buckets
            cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            names, blobs, kinds = [], [], []
            for a, b in zip(cuts, np.r_[cuts[1:], len(kept)]):
                part = kept[a:b]
                names.append(int(place[a]))
                kinds.append(0)
                blobs.append(pack(np.diff(token[part], prepend=0), doc[part], row[part], several[group[part]]))
            if len(shared):
                names.append(int(token[shared[0]] % groups))
                kinds.append(1)
                blobs.append(pack(doc[shared], row[shared], token[shared]))
            yield _lists(names, kinds, blobs)

    return run


def _lists(names: list, kinds: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _regrouped(buckets: int):
    """The second deal: lists of groups, which come sorted, cut into lists of buckets."""

    def run(batches):
        width = _bucket_width(buckets)

        def cut(parts: list) -> pa.RecordBatch:
            token, doc, row, several = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(token, kind="stable")
            token, doc, row, several = token[order], doc[order], row[order], several[order]
            bucket = token // width
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            spans_ = list(zip(cuts, np.r_[cuts[1:], len(bucket)]))
            blobs = [pack(np.diff(token[a:b], prepend=0), doc[a:b], row[a:b], several[a:b]) for a, b in spans_]
            return _lists([int(bucket[a]) for a, _ in spans_], [0] * len(blobs), blobs)

        for group, rows in _by_bucket(batches):
            parts, size = [], 0
            for _, kind, blob in rows:
                if kind:
                    yield _lists([group * buckets // GROUPS], [1], [blob])
                    continue
                steps, doc, row, several = unpack(blob)
                parts.append((np.cumsum(steps), doc, row, several))
                size += len(steps)
                if size >= REGROUPED:
                    yield cut(parts)
                    parts, size = [], 0
            if parts:
                yield cut(parts)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator]]:
    rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
    return groupby(rows, key=lambda r: r[0])


def _told(doc: np.ndarray, row: np.ndarray, value: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, row, value)], ["doc_id", "row", name])


def _shared_tokens(batches):
    for _, rows in _by_bucket(batches):
        parts = []
        for _, kind, blob in rows:
            if kind:
                yield _told(*unpack(blob), "token")
            else:
                steps, doc, row, several = unpack(blob)
                parts.append((np.cumsum(steps), doc, row, several))
        if not parts:
            continue
        token, doc, row, several = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(token, kind="stable")
        token, doc, row, several = token[order], doc[order], row[order], several[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        shared = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | (np.maximum.reduceat(several, first) > 0)
        here = np.repeat(shared, np.diff(np.r_[first, len(token)])) & (several == 0)
        yield _told(doc[here], row[here], token[here], "token")


# --- 2. suffixes by leading token ----------------------------------------------------------------


def _leading_tokens(sizes: tuple[int, int]):
    def run(batches):
        for pieces in _pieces(batches, *sizes):
            block = Block(pieces)
            found = block.leading(np.arange(len(block.anchor))) >> np.uint64(1)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["lead"])

    return run


def _suffixes(splitters: np.ndarray, parts: int, sizes: tuple[int, int]):
    """Lists of suffixes by range of leading tokens, each range in `parts` by the token's hash; kind 1 lists runs found in the block."""

    def run(batches):
        for pieces in _pieces(batches, *sizes):
            block = Block(pieces)
            # the tokens that each row has been told of; a chance hit costs work only
            lists = [np.asarray(p[4].values.to_numpy(zero_copy_only=False), np.int64) if p[4].is_valid else np.zeros(0, np.int64) for p in pieces]
            told = np.concatenate(lists) ^ (np.repeat(block.number, [len(x) for x in lists]) << 44)
            runs = np.flatnonzero(np.isin(block.token ^ (block.number[block.piece] << 44), told))
            if not len(runs):
                continue
            names, kinds, blobs = [], [], []
            rows = block.strings(runs)
            piece = block.piece[runs]
            doc, row_of, start = block.doc[piece], block.row[piece], block.starts[piece]
            most, least = block.anchor[runs] - block.low[runs], block.anchor[runs] - block.high[runs]
            place = block.place[piece] + block.anchor[runs] - start
            # equal runs within the block: those of larger documents are covered by the smallest's
            words = np.zeros((len(runs), -(-WIDTH // 8) * 8), np.uint8)
            words[:, :WIDTH] = rows
            words = words.view("<u8")
            mixed = (most * 64 + least).astype(np.uint64)
            for j in range(words.shape[1]):
                mixed = (mixed ^ words[:, j]) * _ODD[j % 3]
                mixed ^= mixed >> np.uint64(29)
            order = np.lexsort([doc, mixed])
            same = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            same[1:] = (mixed[a] == mixed[b]) & (most[a] == most[b]) & (least[a] == least[b])
            same[1:][same[1:]] = (words[a[same[1:]]] == words[b[same[1:]]]).all(axis=1)
            smallest = doc[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            later = order[doc[order] > smallest]
            if len(later):
                names.append(int(place[later[0]] % ((len(splitters) + 1) * parts)))
                kinds.append(1)
                blobs.append(pack(doc[later], row_of[later], spans(place[later] - most[later], most[later] - least[later] + SPAN)))
            keep = np.setdiff1d(np.arange(len(runs)), later, assume_unique=True)
            lead = block.leading(runs[keep]) >> np.uint64(1)
            by_lead = np.argsort(lead, kind="stable")
            keep, lead = keep[by_lead], lead[by_lead].astype(np.int64)
            bucket = np.searchsorted(splitters, lead, "right") * parts + block.token[runs[keep]] % parts
            held = covered(most, least)
            for n in np.unique(bucket):
                part = keep[bucket == n]
                names.append(int(n))
                kinds.append(0)
                numbers = pack(doc[part], row_of[part], place[part], most[part], least[part])
                text = zstandard.ZstdCompressor(level=3).compress(rows[part][held[part]].tobytes())
                blobs.append(len(numbers).to_bytes(8, "little") + numbers + text)
            yield _lists(names, kinds, blobs)

    return run


# --- 3. sorting a bucket -------------------------------------------------------------------------


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and the bytes that each row shares with the one before it.

    Multikey quicksort with keys of eight bytes: rows are dealt by the first
    key, and only rows that are still equal are dealt by the next one.
    """
    count, width = rows.shape
    keys = np.zeros((count, -(-width // 8) * 8), np.uint8)
    keys[:, :width] = rows
    keys = keys.view(">u8")
    order = np.arange(count)
    shared = np.zeros(count, np.int64)
    group = np.zeros(count, np.int64)  # of the place in order
    open_ = np.arange(count)  # places whose rows are equal to a neighbour so far
    for j in range(keys.shape[1]):
        if len(open_) < 2:
            break
        key = keys[order[open_], j].astype(np.uint64)
        by = np.lexsort([key, group[open_]])
        order[open_] = order[open_][by]
        key, groups = key[by], group[open_]  # groups stay where they are
        fresh = np.r_[True, groups[1:] != groups[:-1]]
        apart = np.r_[True, key[1:] != key[:-1]] & ~fresh
        differ = np.zeros(len(key), np.uint64)
        differ[1:] = key[1:] ^ key[:-1]
        equal = ~fresh & ~apart
        shared[open_[equal]] = 8 * (j + 1)
        at = np.flatnonzero(apart)
        top = np.frexp(differ[at].astype(np.float64))[1]  # a number's bits; rounding up is put right below
        top -= (differ[at] >> (top - 1).clip(0, 63).astype(np.uint64)) == 0
        shared[open_[at]] = 8 * j + (64 - top) // 8
        group[open_] = np.cumsum(fresh | apart) + (j + 1) * count
        beside = equal | np.r_[equal[1:], False]
        open_ = open_[beside]
    return order, np.minimum(shared, width)


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A run of bytes as one number."""
    return (start << 8) | length


def covered_runs(doc: np.ndarray, row: np.ndarray, place: np.ndarray, most: np.ndarray, least: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc_id, row, span) of the bytes that smaller documents of the bucket cover."""
    right, shared_right = suffix_order(rows[:, REACH:])
    token = np.empty(len(doc), np.int64)
    token[right] = np.cumsum(shared_right < TOKEN)
    # tokens of one document only match nothing
    by = np.lexsort([doc, token])
    first = np.flatnonzero(np.r_[True, token[by][1:] != token[by][:-1]])
    ends = np.r_[first[1:], len(by)] - 1
    several = np.repeat(doc[by][first] != doc[by][ends], np.diff(np.r_[first, len(by)]))
    live = np.zeros(len(doc), bool)
    live[by] = several
    live = np.flatnonzero(live)
    doc, row, place, most, least, rows = doc[live], row[live], place[live], most[live], least[live], rows[live]
    if not len(doc):
        return doc, row, place
    right, shared_right = suffix_order(rows[:, REACH:])
    left, shared_left = suffix_order(np.ascontiguousarray(rows[:, :REACH][:, ::-1]))
    low, high = np.full(len(doc), -1), np.full(len(doc), -1)
    by_right, by_left = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    for at in range(PLACES):  # the anchor's place in the string
        here = np.flatnonzero((least <= at) & (at <= most))
        if len(here) < 2:
            continue
        by_right[right] = np.cumsum(shared_right < SPAN - at)
        by_left[left] = np.cumsum(shared_left < at)
        name = by_right[here] * (len(doc) + 1) + by_left[here]
        order = np.argsort(name, kind="stable")
        name, ids = name[order], doc[here][order]
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        smallest = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(name)]))
        late = here[order[ids > smallest]]
        low[late] = np.where(low[late] < 0, at, low[late])
        high[late] = at
    hit = np.flatnonzero(high >= 0)
    return doc[hit], row[hit], spans(place[hit] - high[hit], high[hit] - low[hit] + SPAN)


def _sorted_buckets(batches):
    for _, rows in _by_bucket(batches):
        parts, texts = [], []
        for _, kind, blob in rows:
            if kind:
                yield _told(*unpack(blob), "span")
                continue
            size = int.from_bytes(blob[:8], "little")
            numbers = unpack(blob[8 : 8 + size])
            held = covered(numbers[3], numbers[4])
            text = np.zeros(held.shape, np.uint8)
            text[held] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + size :]), np.uint8)
            parts.append(numbers)
            texts.append(text)
        if parts:
            numbers = (np.concatenate(x) for x in zip(*parts))
            yield _told(*covered_runs(*numbers, np.concatenate(texts)), "span")


# --- 4. cutting ----------------------------------------------------------------------------------


def cut(data: bytes, found: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """What is left of the bytes, and the starts and ends of what is removed."""
    start = np.sort(found >> 8)
    end = np.maximum.accumulate((found >> 8)[by := np.argsort(found >> 8)] + (found & 255)[by])
    new = np.r_[True, start[1:] > end[:-1]] if len(start) else np.zeros(0, bool)
    starts = start[new]
    ends = end[np.r_[np.flatnonzero(new)[1:], len(end)] - 1] if len(start) else starts
    bounds = np.r_[0, np.column_stack([starts, ends]).ravel(), len(data)]
    return b"".join(data[a:b] for a, b in bounds.reshape(-1, 2).tolist()), starts, ends


SPANS_SCHEMA = "doc_id long, starts array<long>, ends array<long>, kept binary"


def _cutter(batches):
    for batch in (whole.slice(at, OUT_ROWS) for whole in batches for at in range(0, whole.num_rows, OUT_ROWS)):
        ids = batch.column(0)
        starts, ends, kept = [], [], []
        for text, found in zip(batch.column(1), batch.column(2)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            own = np.asarray(found.values.to_numpy(zero_copy_only=False), np.int64) if found.is_valid else np.zeros(0, np.int64)
            rest, a, b = cut(data, own)
            starts.append(a)
            ends.append(b)
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
            ["doc_id", "starts", "ends", "kept"],
        )


def _numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """doc_id, text, row: 0, or for a doc_id of several rows the number of the text among all such; and whether there are any."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col(text).alias("text"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return rows.withColumn("row", F.lit(0).cast("long")), False
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = rows.select("doc_id", digest.alias("digest")).join(stored(twice, "twice"), "doc_id", "left_semi").distinct()
    numbers = stored(texts.withColumn("row", F.monotonically_increasing_id() + 1), "numbers")
    found = rows.withColumn("digest", digest).join(numbers, ["doc_id", "digest"], "left")
    return found.select("doc_id", "text", F.coalesce("row", F.lit(0)).cast("long").alias("row")), True


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, starts and ends of the removed runs, kept (the bytes left)."""
    spark, sizes = docs.sparkSession, (block, piece)
    rows, repeated = _numbered(docs, doc_id, text)
    gathered = F.collect_set if repeated else F.collect_list  # equal rows of one id say the same
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    size = size or 0
    partitions = shuffle_partitions(spark)
    lead = rows.sample(min(1.0, SAMPLE_DOCS / max(count, 1)), seed=7).mapInArrow(_leading_tokens(sizes), "lead long")
    lead = lead.orderBy(F.xxhash64("lead")).limit(SAMPLE_TOKENS)
    buckets = max(partitions, math.ceil(size / SUFFIX_BUCKET))
    ranges = min(buckets, SPLITTERS)
    shares = [i / ranges for i in range(1, ranges)]
    drawn = lead.agg(F.percentile_approx("lead", shares, 100_000)).first()[0] if shares else []
    splitters = np.unique(np.array(drawn or [], np.int64))

    hash_buckets = max(partitions, math.ceil(size / HASH_BUCKET))
    packed = "bucket long, kind int, blob binary"
    hashes = rows.mapInArrow(_token_hashes(hash_buckets, sizes), packed)
    hashes = hashes.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    if hash_buckets > GROUPS:
        hashes = hashes.mapInArrow(_regrouped(hash_buckets), packed)
        hashes = hashes.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    told = hashes.mapInArrow(_shared_tokens, "doc_id long, row long, token long")
    told = told.groupBy("doc_id", "row").agg(gathered("token").alias("tokens"))

    suffixes = rows.join(told, ["doc_id", "row"]).select("doc_id", "text", "row", "tokens")
    suffixes = suffixes.mapInArrow(_suffixes(splitters, math.ceil(buckets / ranges), sizes), packed)
    suffixes = suffixes.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    found = suffixes.mapInArrow(_sorted_buckets, "doc_id long, row long, span long")
    found = found.groupBy("doc_id", "row").agg(gathered("span").alias("spans"))
    whole = rows.join(found, ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    made = whole.mapInArrow(_cutter, SPANS_SCHEMA)
    return made.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def digest(kept: DataFrame) -> DataFrame:
    """Numbers and a digest in place of the bytes."""
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return kept.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
