"""SimHash fingerprints and near-duplicate components by BK-trees.

A fingerprint has 64 bits; a bit is set if it is set in more than half of the
hashes of the text's word shingles. Two documents link if their fingerprints
differ in at most `radius` bits, and components are the documents that links
connect.

Equal fingerprints are brought together first, so copies never meet pair by
pair. The distinct fingerprints are dealt into shards: of `radius + extra`
groups of bits, two linked fingerprints agree in at least `extra`, so each
fingerprint goes to one shard for every choice of `extra` groups, named by the
bits of those groups, and every link lies whole within some shard. In each
shard a BK-tree is built whose children are keyed by their integer Hamming
distance to the parent, and a search follows only edges within the radius. A
crowded shard is cut into parts of bounded size; the tree of each part is sent
to the tasks that search it for the other parts, and to no others. All trees
together grow with the corpus, so they are not broadcast to every executor.

A shard reports only which of its members belong together (each with the
smallest of them), not its pairs. Components over all shards follow by large
and small stars, in a number of rounds logarithmic in their size.

Defined cases. Null and empty texts have fingerprint zero and link like others.
Fewer words than the shingle length make one shingle of all words. Repeated
rows have equal fingerprints. A null doc_id gets a fingerprint and component,
but names no component that has another id. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.components import components
from gridcast.session import shuffle_partitions, stored

BITS = 64
WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a shard, on average, up to which no finer shards are made.
SHARD_ROWS = 1024
#: Fingerprints in a part of a crowded shard.
PART_ROWS = 8192
#: Fingerprints whose trees are searched together, and steps of a search held at once.
FOREST_ROWS = 65_536
FRONTIER = 400_000
#: Shingle hashes whose bits are counted at once.
BIT_BLOCK = 65_536


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of one text, unsigned."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) < words:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BIT_BLOCK):
        block = hashes[at : at + BIT_BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_groups(radius: int, extra: int) -> list[int]:
    """Masks of `radius + extra` groups of neighbouring bits that cover all bits."""
    cuts = np.linspace(0, BITS, radius + extra + 1).astype(int)
    return [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts[:-1], cuts[1:])]


def shard_masks(rows: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> list[int]:
    """Bit masks whose values name shards: finer ones, and more, as the fingerprints grow.

    Any two fingerprints within the radius agree on at least one mask.
    """
    extra = 1
    while extra < 4 and rows >> int(extra * BITS / (radius + extra)) >= shard_rows:
        extra += 1
    groups = bit_groups(radius, extra)
    return [sum(chosen) for chosen in combinations(groups, extra)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


class Forest:
    """BK-trees of several shards side by side, one tree per shard, in arrays."""

    def __init__(self, points: np.ndarray, tree: np.ndarray):
        """points: distinct within a tree; tree: the tree number of each point, ascending."""
        self.points = points
        self.child = np.full((len(points), BITS + 1), -1, np.int32)
        firsts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, int)
        self.trees, self.roots = tree[firsts], firsts
        at = np.repeat(firsts, np.diff(np.r_[firsts, len(points)]))
        waiting = np.setdiff1d(np.arange(len(points)), firsts, assume_unique=True)
        at = at[waiting]
        while len(waiting):
            far = np.bitwise_count(points[waiting] ^ points[at]).astype(np.int64)
            empty = self.child[at, far] < 0
            slot = at[empty] * (BITS + 1) + far[empty]
            _, first = np.unique(slot, return_index=True)
            self.child.ravel()[slot[first]] = waiting[empty][first]
            at = self.child[at, far]
            stays = at != waiting
            waiting, at = waiting[stays], at[stays]

    def near(self, points: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(searched, found) positions within the radius, block by block."""
        place = np.searchsorted(self.trees, tree)
        sizes = np.diff(np.r_[self.roots, len(self.points)])
        cost = np.cumsum(sizes[place])
        block = cost // FRONTIER
        for b in np.unique(block):
            asked = np.flatnonzero(block == b)
            node = self.roots[place[asked]]
            while len(asked):
                far = np.bitwise_count(points[asked] ^ self.points[node]).astype(np.int64)
                hit = far <= radius
                yield asked[hit], node[hit]
                edges = far[:, None] + np.arange(-radius, radius + 1)
                next_node = self.child[node[:, None], np.clip(edges, 0, BITS)]
                follow = (edges >= 0) & (edges <= BITS) & (next_node >= 0)
                asked = np.broadcast_to(asked[:, None], follow.shape)[follow]
                node = next_node[follow]


class Union:
    """Which positions belong together, each named by its smallest."""

    def __init__(self, size: int):
        self.name = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.name[a], self.name[b]
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.name, high, low)
            while True:
                further = self.name[self.name]
                if np.array_equal(further, self.name):
                    break
                self.name = further
            a, b = low, high


def _search(groups: np.ndarray, searched: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, one that it belongs with) over whole groups of rows.

    groups: ascending numbers. Rows with `searched` 0 form the tree of their
    group; they are searched in it too, unless the group has rows with 1, which
    are only searched.
    """
    points = fps.view(np.uint64)
    planted = np.flatnonzero(searched == 0)
    forest = Forest(points[planted], groups[planted])
    mixed = np.isin(groups, groups[searched == 1])
    asked = np.flatnonzero(np.isin(groups, forest.trees) & (~mixed | (searched == 1)))
    union = Union(len(fps))
    for a, b in forest.near(points[asked], groups[asked], radius):
        apart = asked[a] != planted[b]
        union.add(asked[a][apart], planted[b][apart])
    linked = np.flatnonzero(union.name != np.arange(len(fps)))
    return fps[linked], fps[union.name[linked]]


def _searcher(radius: int):
    """Rows (mask, bits, tree, asks, searched, fp) that come sorted by group, group after group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
            a, b = _search(group, rows[4], np.ascontiguousarray(rows[5]), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def numbered(rows: np.ndarray) -> np.ndarray:
            return np.cumsum(np.r_[False, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if sum(x.shape[1] for x in held) < FOREST_ROWS:
                continue
            rows = np.concatenate(held, axis=1)
            group = numbered(rows)
            end = np.searchsorted(group, group[-1])  # the last group may go on
            held = [rows[:, end:]]
            if end:
                yield out(rows[:, :end], group[:end])
        if held:
            rows = np.concatenate(held, axis=1)
            yield out(rows, numbered(rows))

    return run


def links(distinct: DataFrame, rows: int, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b): fingerprints that belong together, enough of them to connect every link.

    `distinct` has each of the `rows` fingerprints once, in column fp.
    """
    names = [
        F.struct(F.lit(i).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits"))
        for i, m in enumerate(shard_masks(rows, radius))
    ]
    members = distinct.select("fp", F.explode(F.array(*names)).alias("shard")).select("fp", "shard.mask", "shard.bits")
    crowded = members.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > part_rows)
    crowded = stored(crowded, "crowded")
    if crowded.isEmpty():
        dealt = members.withColumn("parts", F.lit(1))
    else:
        parts = F.coalesce(F.ceil(F.col("n") / part_rows), F.lit(1)).cast("int")
        dealt = members.join(crowded, ["mask", "bits"], "left").withColumn("parts", parts)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int"))
    # a part is the tree for itself and for later parts, and is searched in the trees of earlier ones
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(
            F.least(F.col("part"), other).cast("long").alias("tree"),
            F.greatest(F.col("part"), other).cast("long").alias("asks"),
            F.when(other >= F.col("part"), 0).otherwise(1).cast("long").alias("searched"),
        ),
    )
    group = ["mask", "bits", "tree", "asks"]
    spread = dealt.select("mask", "bits", "fp", F.explode(meetings).alias("r"))
    spread = spread.select("mask", "bits", "r.tree", "r.asks", "r.searched", "fp")
    spread = spread.repartition(shuffle_partitions(distinct.sparkSession), *group)
    spread = spread.sortWithinPartitions(*group, "searched", "fp")
    return spread.mapInArrow(_searcher(radius), "a long, b long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _linked(docs: DataFrame, doc_id: str, text: str, words: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all documents; the distinct ones; of those, the ones that link, with their component's name."""
    known = stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = stored(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    stars = components(links(distinct, distinct.count(), radius))
    nodes = stars.select(F.col("node").alias("fp"), "component")
    nodes = nodes.union(stars.select(F.col("component").alias("fp"), "component").distinct())
    return known, distinct, distinct.join(nodes, "fp").select("fp", "component", "first")


def _named(known: DataFrame, distinct: DataFrame, of_nodes: DataFrame) -> DataFrame:
    smallest = of_nodes.groupBy("component").agg(F.min("first").alias("smallest"))
    linked = of_nodes.join(smallest, "component").select("fp", "smallest")
    # a document whose fingerprint is its own and links to none is its own component
    names = distinct.join(linked, "fp", "left").where("n > 1 OR smallest IS NOT NULL")
    names = names.select("fp", F.coalesce("smallest", "first").alias("component_id"))
    return known.join(names, "fp", "left").select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (its smallest doc_id)."""
    return _named(*_linked(docs, doc_id, text, words, radius))


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, repeats: bool = True
) -> DataFrame:
    """The documents without those of which another of their component stays: the smallest doc_id does.

    Of several fingerprints with that doc_id the smallest stays. Rows that repeat
    both the doc_id and the fingerprint that stay all stay; without `repeats`,
    one of them. Where no doc_id occurs twice, it alone says which rows go.
    """
    known, distinct, of_nodes = _linked(docs, doc_id, text, words, radius)
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = _named(known, distinct, of_nodes)
        lost = stored(found.where("NOT doc_id <=> component_id").select(F.col("doc_id").alias("lost_id")), "lost")
        return docs.join(lost, docs[doc_id].eqNullSafe(lost["lost_id"]), "left_anti")
    # a null doc_id stays only where its component has no other
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("least")
    of_nodes = stored(of_nodes, "members")
    kept = of_nodes.groupBy("component").agg(least).select("least.first", "least.fp")
    kept = kept.union(distinct.join(of_nodes, "fp", "left_anti").select("first", "fp"))
    kept = stored(kept.toDF("kept_id", "kept_fp"), "kept")

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    mark = f"fingerprint_{uuid.uuid4().hex}"
    marked = docs.withColumn(mark, made(F.col(text)))
    same = marked[doc_id].cast("long").eqNullSafe(kept["kept_id"]) & (marked[mark] == kept["kept_fp"])
    rows = marked.join(kept, same, "left_semi")
    return (rows if repeats else rows.dropDuplicates([doc_id, mark])).drop(mark)
