"""Reversible line dedup by sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case. An index holds two tables. `counts` is exact: of every key the number of
documents that have it. `filters` has one cuckoo filter per shard of keys, with
the keys of `least_docs` documents and more: the lines that go. Cuckoo filters
forget a key again, so both tables take documents in and give them back:
:func:`inserted` and :func:`deleted` add and subtract references, and only keys
that cross the threshold enter or leave a filter.

:func:`cleaned` reads every text once, where it lies. A line that its filter
does not know stays. A filter also knows a few keys by mistake; those are found
beforehand by asking the filters for every counted key below the threshold, so
that a hit which is no such `mistake` is a common line for certain: the counts
hold every key of the documents.

Scale. Lines are combined in each task before the counts are shuffled by key,
so a line of a third of all documents is one row per task. Filters are built
shard by shard; shards grow in number with the keys, not in size. Filters and
mistakes are sent to the tasks up to `FILTER_BYTES` together, measured before;
beyond, the keys of distinct texts are joined with the common keys by shuffles.

Keys are identified by the first 16 bytes of their SHA-256.

Defined cases. A null or empty text is one empty line. Each row is a document,
repeated rows and rows with a null or repeated doc_id too. Keys of fewer than
`least_chars` code points never go. Documents without rows give no rows. Other
columns are not read. Deleting what was never inserted raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.session import shuffle_partitions, stored

LEAST_DOCS = 10
LEAST_CHARS = 1
#: Common keys in a shard's filter, on average, before there are more shards.
SHARD_KEYS = 16_384
#: Filters and mistakes that are sent to the tasks, at most.
FILTER_BYTES = 64 << 20
#: Distinct lines that a worker combines, and rows that it hands on at once.
HELD_LINES = 100_000
OUT_ROWS = 500

SLOTS = 4
#: Share of the slots that are filled when a filter is made, and moves before it is made larger.
LOAD = 0.7
MOVES = 200


def key_of(line: bytes) -> bytes:
    return line.strip().lower()  # bytes: ASCII white space and A-Z only


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def _halves(digests: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first half of each digest, which names its shard, and the second, which places it."""
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _shard(first: np.ndarray, bits: int) -> np.ndarray:
    return (first >> np.uint64(64 - bits) if bits else np.zeros_like(first)).astype(np.int64)


def _marks(second: np.ndarray) -> np.ndarray:
    """16 bits that stand for a key; zero marks a free slot."""
    return ((second >> np.uint64(48)) | (second >> np.uint64(48) == 0).astype(np.uint64)).astype(np.int64)


def _spread(marks: np.ndarray) -> np.ndarray:
    """What leads from one of a key's buckets to the other."""
    return (marks * 0x5BD1E995) & 0x7FFFFFFF


class CuckooFilter:
    """Buckets of four marks; a key's mark is in one of its two buckets."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = len(slots) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, second: np.ndarray) -> CuckooFilter:
        """With these keys, as large as they need."""
        size = len(second)
        while True:
            made = cls.sized(size)
            if made.add(second):
                return made
            size = made.slots.size

    @classmethod
    def read(cls, table: bytes) -> CuckooFilter:
        return cls(np.frombuffer(table, "<u2").reshape(-1, SLOTS).copy())

    def bytes(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def _places(self, second: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        marks = _marks(second)
        one = (second & np.uint64(0x7FFFFFFF)).astype(np.int64) & self.mask
        return marks.tolist(), one.tolist(), (one ^ (_spread(marks) & self.mask)).tolist()

    def add(self, second: np.ndarray) -> bool:
        """False if a mark found no place: the filter is then to be made anew, larger."""
        rows = self.slots.tolist()
        for mark, one, two in zip(*self._places(second)):
            at = one if 0 in rows[one] else two
            for move in range(MOVES):
                if 0 in rows[at]:
                    rows[at][rows[at].index(0)] = mark
                    break
                rows[at][move % SLOTS], mark = mark, rows[at][move % SLOTS]  # the mark in the way moves on
                at ^= int(_spread(np.int64(mark))) & self.mask
            else:
                return False
        self.slots = np.array(rows, np.uint16).reshape(-1, SLOTS)
        return True

    def remove(self, second: np.ndarray) -> None:
        """Keys that are in the filter."""
        for mark, one, two in zip(*self._places(second)):
            at = one if mark in self.slots[one] else two
            self.slots[at][np.flatnonzero(self.slots[at] == mark)[0]] = 0


class Filters:
    """The filters of all shards side by side."""

    def __init__(self, bits: int, tables: dict[int, bytes]):
        self.bits = bits
        sizes = np.array([len(tables.get(s, b"")) // (2 * SLOTS) for s in range(1 << bits)], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.mask = np.maximum(sizes, 1) - 1
        self.there = sizes > 0
        joined = b"".join(tables.get(s, b"") for s in range(1 << bits))
        self.slots = np.frombuffer(joined or bytes(2 * SLOTS), "<u2").reshape(-1, SLOTS)

    def know(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        first, second = _halves(digests)
        shard = _shard(first, self.bits)
        marks, mask = _marks(second), self.mask[shard]
        one = (second & np.uint64(0x7FFFFFFF)).astype(np.int64) & mask
        two = one ^ (_spread(marks) & mask)
        begin = np.where(self.there[shard], self.begin[shard], 0)
        found = (self.slots[begin + one] == marks[:, None]).any(axis=1) | (self.slots[begin + two] == marks[:, None]).any(axis=1)
        return found & self.there[shard]


@dataclass(frozen=True)
class LineIndex:
    """counts: key, n. filters: shard, bytes of its filter. mistakes: keys that a filter knows though they are not common."""

    counts: DataFrame
    filters: DataFrame
    mistakes: DataFrame
    bits: int
    least_docs: int = LEAST_DOCS
    least_chars: int = LEAST_CHARS

    def write(self, path: str) -> None:
        for name in ("counts", "filters", "mistakes"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        about = [(self.bits, self.least_docs, self.least_chars)]
        self.counts.sparkSession.createDataFrame(about, "bits int, least_docs int, least_chars int").write.parquet(f"{path}/about")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LineIndex:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("counts", "filters", "mistakes")), *spark.read.parquet(f"{path}/about").first())


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.large_binary()):
        yield t.as_py() or b""


def _long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (least_chars <= 1 or len(key.decode(errors="replace")) >= least_chars)


def references(docs: DataFrame, least_chars: int = LEAST_CHARS, text: str = "text") -> DataFrame:
    """key and n: in how many documents each key is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            keys = [k for k in held if _long_enough(k, least_chars)]
            return pa.RecordBatch.from_arrays([pa.array(map(digest, keys), pa.binary()), pa.array([held[k] for k in keys], pa.int64())], ["key", "n"])

        for batch in batches:
            for raw in _texts(batch.column(0)):
                held.update(set(map(key_of, raw.split(b"\n"))))
                if len(held) >= HELD_LINES:
                    yield out()
                    held.clear()
        yield out()

    found = docs.select(F.col(text)).mapInArrow(run, "key binary, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def _with_shard(keys: DataFrame, bits: int) -> DataFrame:
    """The first `bits` bits of the key as a number."""
    start = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    return keys.withColumn("shard", F.shiftright(start, 32 - bits).cast("int") if bits else F.lit(0))


def _shard_bits(spark: SparkSession, common: int) -> int:
    return min(max(0, (max(shuffle_partitions(spark), common // SHARD_KEYS) - 1).bit_length()), 30)


def _keys(frame: pd.DataFrame) -> np.ndarray:
    return _halves(sorted(frame["key"]))[1] if len(frame) else np.zeros(0, np.uint64)


def _built_filters(common: DataFrame, bits: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "filter": [CuckooFilter.of(_keys(rows)).bytes()]})

    return stored(_with_shard(common.select("key"), bits).groupBy("shard").applyInPandas(run, "shard int, filter binary"), "filters")


def _changed_filters(filters: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """keys: the common keys of before and after, with change 1 (enters), -1 (leaves) or 0."""

    def run(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return old
        now = rows[rows["change"] >= 0]
        if not len(now):
            return old.iloc[:0]
        made = CuckooFilter.read(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(len(now))
        made.remove(_keys(rows[rows["change"] < 0]))
        if not made.add(_keys(rows[rows["change"] > 0])):
            made = CuckooFilter.of(_keys(now))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "filter": [made.bytes()]})

    sharded = _with_shard(keys, bits)
    touched = sharded.where("change <> 0").select("shard").distinct()
    sharded = sharded.join(touched, "shard", "left_semi")
    return stored(filters.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInPandas(run, "shard int, filter binary"), "filters")


def _sent(filters: DataFrame, bits: int, most: int) -> Filters | None:
    """The filters for the tasks, or None if they are larger than `most` bytes."""
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size > most:
        return None
    return Filters(bits, {r.shard: bytes(r["filter"]) for r in filters.collect()})


def _mistakes(counts: DataFrame, filters: DataFrame, bits: int, least_docs: int, most: int) -> DataFrame:
    """Counted keys that are not common, but known to a filter; none are sought if the filters are not sent."""
    rare = counts.where(F.col("n") < least_docs).select("key")
    known = _sent(filters, bits, most)
    if known is None:
        return rare.limit(0)
    sent = counts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.know(batch.column(0).to_pylist())))

    return stored(rare.mapInArrow(run, "key binary"), "mistakes")


def _index(counts: DataFrame, filters: DataFrame, bits: int, least_docs: int, least_chars: int, most: int) -> LineIndex:
    return LineIndex(counts, filters, _mistakes(counts, filters, bits, least_docs, most), bits, least_docs, least_chars)


def built(
    docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, text: str = "text", filter_bytes: int = FILTER_BYTES
) -> LineIndex:
    """An index of the documents' lines."""
    return _filtered(stored(references(docs, least_chars, text), "counts"), least_docs, least_chars, filter_bytes)


def _filtered(counts: DataFrame, least_docs: int, least_chars: int, filter_bytes: int) -> LineIndex:
    """All filters made anew from the counts, in as many shards as they need now."""
    common = counts.where(F.col("n") >= least_docs)
    bits = _shard_bits(counts.sparkSession, common.count())
    return _index(counts, _built_filters(common, bits), bits, least_docs, least_chars, filter_bytes)


def _moved(index: LineIndex, docs: DataFrame, sign: int, text: str, filter_bytes: int) -> LineIndex:
    delta = references(docs, index.least_chars, text).select("key", F.lit(0).cast("long").alias("before"), (F.col("n") * sign).alias("by"))
    old = index.counts.select("key", F.col("n").alias("before"), F.lit(0).cast("long").alias("by"))
    both = old.unionByName(delta).groupBy("key").agg(F.sum("before").alias("before"), F.sum("by").alias("by"))
    both = stored(both.select("key", "before", (F.col("before") + F.col("by")).alias("n")), "counts")
    if not both.where("n < 0").isEmpty():
        raise ValueError("documents are deleted that were never inserted")
    was, now = F.col("before") >= index.least_docs, F.col("n") >= index.least_docs
    keys = both.where(was | now).select("key", (now.cast("int") - was.cast("int")).alias("change"))
    counts = both.where("n > 0").select("key", "n")
    bits = _shard_bits(counts.sparkSession, keys.where("change >= 0").count())
    if abs(bits - index.bits) > 1:  # the shards would become too large or too small
        return _filtered(counts, index.least_docs, index.least_chars, filter_bytes)
    filters = _changed_filters(index.filters, keys, index.bits)
    return _index(counts, filters, index.bits, index.least_docs, index.least_chars, filter_bytes)


def inserted(index: LineIndex, docs: DataFrame, text: str = "text", filter_bytes: int = FILTER_BYTES) -> LineIndex:
    """The index with more documents; the old one stays as it was."""
    return _moved(index, docs, 1, text, filter_bytes)


def deleted(index: LineIndex, docs: DataFrame, text: str = "text", filter_bytes: int = FILTER_BYTES) -> LineIndex:
    """The index without these documents, which were inserted before."""
    return _moved(index, docs, -1, text, filter_bytes)


def _without(raw: bytes, lines: list[bytes], keys: list[bytes], gone: set[bytes]) -> tuple[int, int, bytes]:
    kept = [x for x, k in zip(lines, keys) if k not in gone] if not gone.isdisjoint(keys) else lines
    return len(lines), len(lines) - len(kept), raw if len(kept) == len(lines) else b"\n".join(kept)


def _out(ids: pa.Array, made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())]
    return pa.RecordBatch.from_arrays([ids, *columns, pa.array([m[2] for m in made], pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def cleaned(docs: DataFrame, index: LineIndex, doc_id: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and text, for documents that the index holds."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)]).add("n_lines", "long").add("n_dropped", "long").add("text", "string")
    known = _sent(index.filters, index.bits, filter_bytes)
    wrong = index.mistakes.count() if known is not None else 0
    if known is None or 16 * wrong > filter_bytes:
        return _cleaned_by_join(rows, replace(index, mistakes=index.mistakes.limit(0)), schema)
    sent = docs.sparkSession.sparkContext.broadcast((known, frozenset(bytes(r.key) for r in index.mistakes.collect())))
    least_chars = index.least_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, mistakes = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                raws = list(_texts(part.column(1)))
                cut = [raw.split(b"\n") for raw in raws]
                keys = [list(map(key_of, lines)) for lines in cut]
                asked = [k for k in set().union(*keys) if _long_enough(k, least_chars)]
                digests = list(map(digest, asked))
                gone = {k for k, d, hit in zip(asked, digests, filters.know(digests).tolist()) if hit and d not in mistakes}
                yield _out(part.column(0), [_without(*x, gone) for x in zip(raws, cut, keys)])

    return rows.mapInArrow(run, schema)


def _cleaned_by_join(rows: DataFrame, index: LineIndex, schema: T.StructType) -> DataFrame:
    """The same by shuffles: keys of distinct texts meet the common keys, and texts with such lines are joined back."""
    common = index.counts.where(F.col("n") >= index.least_docs).select("key")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in _texts(batch.column(0)):
                keys = list({digest(k) for k in map(key_of, raw.split(b"\n"))})
                name = hashlib.sha256(raw).digest()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.binary()), pa.array(keys, pa.binary())], ["name", "key"])

    found = rows.select("text").distinct().mapInArrow(keyed, "name binary, key binary").join(common, "key", "left_semi")
    lists = found.groupBy("name").agg(F.collect_set("key").alias("keys"))  # of one text's own lines
    name = F.sha2(F.coalesce("text", F.lit("")), 256)
    joined = rows.withColumn("name", F.unhex(name)).join(lists, "name", "left").select("doc_id", "text", "keys")
    least_chars = index.least_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                made = []
                for raw, common_here in zip(_texts(part.column(1)), part.column(2).to_pylist()):
                    lines = raw.split(b"\n")
                    keys = list(map(key_of, lines))
                    here = set(common_here or ())
                    gone = {k for k in set(keys) if here and _long_enough(k, least_chars) and digest(k) in here}
                    made.append(_without(raw, lines, keys, gone))
                yield _out(part.column(0), made)

    return joined.mapInArrow(run, schema)
