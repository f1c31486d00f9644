"""Phrases whose words occur together more often than apart, by prefix-free parsing.

Texts are cut at punctuation and line ends into pieces, pieces into words. The
parse cuts a piece where its content says so: a chunk begins at the first word
of a piece and wherever a window of `max_words - 1` words hashes to a trigger,
and reaches over the window that begins the next chunk. Equal passages so give
equal chunks, wherever they stand. The dictionary holds each distinct chunk with
its frequency in the parse and the number of its own words, those before the
next chunk's window. Phrases are counted inside distinct chunks, weighted with
the chunk's frequency, and only where they begin at an own word: chunks overlap
by `max_words - 1` words, so every phrase lies whole in the chunk that owns its
first word and in no other count.

Phrases of one word are counted first, then of two, and so on. A phrase that
occurs `least` times consists of shorter ones that do, so a longer phrase is
counted only where both its shorter halves pass a filter of the frequent ones.
The filter is a bit map of at most `FILTER_BITS` bits. What it lets through by
mistake is counted exactly and falls under the threshold; the more phrases there
are, the less it saves, but no count ever depends on it.

Scale. The corpus moves once, as distinct chunks per task. Counts are combined
in blocks before they are shuffled by (lang, phrase). The first rows of each
language are found in parts, then among those parts' first rows, so no task
sorts a whole language.

Defined cases. Null text is empty; a null lang is `und`, together with rows that
say so. Rows are documents, repeated ones and those without doc_id too. Words
and pieces may be of any length. An empty table gives no rows. Only `lang` and
`text` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridcast.session import stored

MAX_WORDS = 3
LEAST = 10
#: A longer phrase with this share (of a hundred) of a phrase's occurrences stands for it.
CONTAINED = 50
TOP = 2000
#: One window of so many begins a chunk.
PERIOD = 16
#: Text that a worker parses or counts at once, and rows that it hands on at once.
BLOCK_BYTES = 4 << 20
OUT_ROWS = 50_000
#: Bits of a filter for each frequent phrase, and in all.
PHRASE_BITS = 16
FILTER_BITS = 1 << 28
#: Parts in which a language's first rows are sought.
PARTS = 64

NO_LANG = "und"
PUNCTUATION = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if c in PUNCTUATION else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def _windows(of_words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; the last runs, which are cut short, have none."""
    n = max(len(of_words) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = _mixed(h * np.uint64(31) + of_words[k : n + k])
    return h


def parse(texts: list[bytes], max_words: int = MAX_WORDS, period: int = PERIOD) -> Counter[tuple[bytes, int]]:
    """(chunk, own words) and how often the texts' parse has it; a chunk's words are joined by one space."""
    raw = b"\n".join(texts).translate(_PLAIN)
    if b"  " in raw:
        raw = re.sub(b" +", b" ", raw)
    buf = np.frombuffer(b"\n" + raw + b"\n" + bytes(8), np.uint8)
    line = buf[: len(raw) + 2] == 10
    blank = line | (buf[: len(raw) + 2] == 32)
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(begin):
        return Counter()
    piece = np.cumsum(line, dtype=np.int64)[begin]
    size = end - begin
    word = size.astype(np.uint64)
    for k in range(8):  # the first and the last eight bytes decide
        word = _mixed(word * np.uint64(31) + np.where(size > k, buf[begin + k], 0).astype(np.uint64))
        word = word * np.uint64(31) + np.where(size > k, buf[end - 1 - k], 0).astype(np.uint64)

    width = max_words - 1
    first = np.concatenate([[True], piece[1:] != piece[:-1]])
    starts = first.copy()
    if width > 0:
        h = _windows(word, width)
        whole = piece[: len(h)] == piece[width - 1 :]
        starts[: len(h)] |= whole & (_mixed(h) % np.uint64(period) == 0)
    at = np.flatnonzero(starts)
    following = np.append(at[1:], len(begin))
    piece_end = np.append(np.flatnonzero(first)[1:], len(begin))[np.cumsum(first)[at] - 1]
    last = np.minimum(following + width, piece_end)
    whole = buf.tobytes()
    spans = zip(begin[at].tolist(), end[last - 1].tolist(), (following - at).tolist())
    return Counter([(whole[a:b], own) for a, b, own in spans])


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """The rows in blocks of some `BLOCK_BYTES` of that column."""
    held, size = [], 0
    for batch in batches:
        at, bytes_of = 0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(bytes_of, dtype=np.int64)
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            cut = max(int(np.searchsorted(upto, before + BLOCK_BYTES - size, "right")), at + 1)
            held.append(batch.slice(at, cut - at))
            size += int(upto[min(cut, batch.num_rows) - 1] - before)
            at = cut
            if size >= BLOCK_BYTES or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _by_lang(block: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """The block's rows of each language; the language is the first column."""
    ordered = block.take(pc.sort_indices(block.column(0)))
    langs = ordered.column(0).combine_chunks().dictionary_encode()
    numbers = langs.indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield langs.dictionary[int(numbers[a])].as_py(), ordered.slice(a, b - a)


def dictionary(docs: DataFrame, max_words: int = MAX_WORDS, lang: str = "lang", text: str = "text", period: int = PERIOD) -> DataFrame:
    """lang, chunk, own, freq: the distinct chunks of the parse with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 1):
            for name, rows in _by_lang(block):
                texts = [t or b"" for t in rows.column(1).cast(pa.large_binary()).to_pylist()]
                found = parse(texts, max_words, period)
                chunks, freqs = list(found), list(found.values())
                for a in range(0, len(chunks), OUT_ROWS):
                    part = chunks[a : a + OUT_ROWS]
                    columns = [pa.array([c for c, _ in part], pa.binary()).cast(pa.string()), pa.array([o for _, o in part], pa.int64())]
                    columns.append(pa.array(freqs[a : a + OUT_ROWS], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *columns], ["lang", "chunk", "own", "freq"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, "lang string, chunk string, own long, freq long")
    return made.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq"))


def _word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """A hash for each word, of which phrases' hashes are made."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


class PhraseFilter:
    """A bit map of phrases of `words` words: never misses one that it holds."""

    def __init__(self, words: int, bits: np.ndarray):
        self.words = words
        self.bits = bits  # 64 to a number
        self.shift = np.uint64(64 - (len(bits) * 64).bit_length() + 1)

    def know(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def phrase_filter(frequent: DataFrame, words: int, most_bits: int = FILTER_BITS) -> PhraseFilter:
    """The filter of all these phrases, put together from parts of the bit map."""
    bits, phrases = 4096, frequent.count()
    while bits < phrases * PHRASE_BITS and bits < most_bits:
        bits *= 2
    shift = np.uint64(64 - bits.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 1):
            for name, rows in _by_lang(block):
                spelt = pc.split_pattern(rows.column(1).combine_chunks(), " ").flatten().dictionary_encode()
                ids = spelt.indices.to_numpy()
                h = _word_hashes(name, spelt.dictionary)[ids]
                at = _windows(h, words)[::words] >> shift
                place, group = np.unique(at >> np.uint64(6), return_inverse=True)
                marks = np.zeros(len(place), np.uint64)
                np.bitwise_or.at(marks, group, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(marks.view(np.int64))], ["place", "marks"])

    parts = frequent.select("lang", "phrase").mapInArrow(run, "place long, marks long").groupBy("place").agg(F.bit_or("marks").alias("marks"))
    found = parts.toArrow()  # bits / 64 rows at most
    made = np.zeros(bits // 64, np.uint64)
    made[found.column("place").to_numpy()] = found.column("marks").to_numpy().view(np.uint64)
    return PhraseFilter(words, made)


def count_phrases(name: str, rows: pa.Table, words: int, known: PhraseFilter | None) -> tuple[pa.Array, np.ndarray]:
    """The phrases of so many words that begin at own words of these chunks, and their weighted counts."""
    lists = pc.split_pattern(rows.column(1).combine_chunks(), " ")
    spelt = lists.flatten().dictionary_encode()
    ids = spelt.indices.to_numpy().astype(np.int64)
    n = len(ids) - words + 1
    if n <= 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own, freq = (rows.column(c).to_numpy().astype(np.int64) for c in (2, 3))
    good = (place < np.minimum(own, sizes - words + 1)[chunk])[:n]
    if known is not None:
        passes = known.know(_windows(_word_hashes(name, spelt.dictionary)[ids], known.words))
        good &= passes[:n] & passes[1 : n + 1]
    at = np.flatnonzero(good)
    key, weights = ids[at], freq[chunk[at]]
    for k in range(1, words):
        key = (key if k == 1 else np.unique(key, return_inverse=True)[1]) * len(spelt.dictionary) + ids[at + k]
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(order) else order
    counts = np.add.reduceat(weights[order], cuts) if len(order) else weights
    shown = at[order[cuts]]
    parts = [spelt.dictionary.take(pa.array(ids[shown + k])) for k in range(words)]
    return (pc.binary_join_element_wise(*parts, " ") if words > 1 else parts[0]), counts


def phrase_counts(chunks: DataFrame, words: int, known: PhraseFilter | None = None) -> DataFrame:
    """lang, phrase, n over a dictionary of chunks."""
    sent = chunks.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 1):
            for name, rows in _by_lang(block):
                phrases, counts = count_phrases(name, rows, words, sent.value)
                for a in range(0, len(phrases), OUT_ROWS):
                    part = phrases.slice(a, OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), part, pa.array(counts[a : a + OUT_ROWS])], ["lang", "phrase", "n"])

    made = chunks.select("lang", "chunk", "own", "freq").mapInArrow(run, "lang string, phrase string, n long")
    return made.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(chunks: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """lang, phrase, n of the phrases of 1, 2, … words that occur `least` times and more."""
    found, known = [], None
    for words in range(1, max_words + 1):
        found.append(stored(phrase_counts(chunks, words, known).where(F.col("n") >= least), "phrases"))
        if words < max_words:
            known = phrase_filter(found[-1], words, filter_bits)
    return found


def _exact(column: str) -> F.Column:
    return F.col(column).cast(T.DecimalType(16, 0))


def scored(frequent: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of every frequent phrase of two words and more, by its lowest cut.

    Products are decimals of 38 digits; more than 10^16 occurrences are an error.
    """
    phrases = frequent[1].withColumn("words", F.lit(2))
    for words, more in enumerate(frequent[2:], 3):
        phrases = phrases.unionByName(more.withColumn("words", F.lit(words)))
    parts = frequent[0]
    for more in frequent[1:-1]:
        parts = parts.unionByName(more)
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    ratio = both.withColumns({"x": F.lit(1_000_000).cast(T.DecimalType(7, 0)) * _exact("a") * _exact("a"), "y": _exact("l") * _exact("r")})
    cut = F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r")).alias("cut")
    return ratio.groupBy("lang", "phrase", "a").agg(cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def uncontained(phrases: DataFrame, longer: list[DataFrame], share: int = CONTAINED) -> DataFrame:
    """The phrases (lang, phrase, a, …) that no longer one stands for; `longer` are those of three words, of four, …"""
    for words, table in enumerate(longer, 3):
        inner = f"transform(sequence(2, {words - 1}), s -> transform(sequence(1, {words} - s + 1), i -> array_join(slice(w, i, s), ' ')))"
        parts = table.withColumn("w", F.split("phrase", " ")).select("lang", "n", F.explode(F.flatten(F.expr(inner))).alias("phrase"))
        most = parts.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
        lost = F.col("most").isNotNull() & (100 * F.col("most") >= share * F.col("a"))
        phrases = phrases.join(most, ["lang", "phrase"], "left").where(~lost).drop("most")
    return phrases


def first_rows(phrases: DataFrame, top: int = TOP, parts: int = PARTS) -> DataFrame:
    """Each language's first rows, with their rank: first of each part, then of what the parts give."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text", period: int = PERIOD
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    chunks = stored(dictionary(docs, max_words, lang, text, period), "chunks")
    frequent = frequent_phrases(chunks, max_words, least)
    kept = uncontained(scored(frequent), frequent[2:])
    sizes = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    return first_rows(kept, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
