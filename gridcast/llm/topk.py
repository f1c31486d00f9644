"""Exact top-k search by an impact-ordered index, score at a time.

Vectors are integers; the score of a query and a candidate is their inner
product. Candidates are dealt into shards and queries into blocks, and each
shard meets each block of the stated query set. For a shard an index is built:
every dimension has posting segments, the candidates whose component lies in the
same quantised step. For a query the segments of all dimensions are ordered by
impact, the largest that the component can add to the score, and processed from
the largest impact down; each posting adds the segment's impact to its
candidate's sum.

After some segments, all impacts still to come are at most the next one's. A
candidate's score is therefore at most its sum, plus the next impact for every
dimension begun in which it has not been met, plus what each dimension not begun
can add. The k-th best score of the leaders so far, scored exactly, is the mark;
candidates whose upper bound is below it are out: that is the proof on which
processing stops, once few candidates remain. What remains is scored again
exactly, and the exact scores decide. The best of all shards are merged by query.

Defined cases. Null vectors and ids take no part, nor do vectors with null or
non-finite components. Shorter vectors count as filled up with zeros. A query
never meets rows of its own id; repeated rows count once. Ties go to the smaller
id. With fewer candidates than k all are returned, and empty tables give empty
results. Other columns are not read. Components may be as large as a long; bounds
allow for what doubles round off, and exact scores are computed in longs, or in
Python's integers where products might pass them. A component or a best score
that no long holds is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.session import shuffle_partitions, stored

TOP = 5
LEVELS = 64
SHARD_ROWS = 32_768
BLOCK_ROWS = 2_048
#: Candidates of a shard and queries of a block, at least, where more of them would serve more tasks.
LEAST_ROWS = 8_192
LEAST_ASKED = 256
#: Shares of a query's segments after which the bounds are looked at.
LOOKS = (0.3, 0.45, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Leaders whose exact scores set the mark, for each of the best wanted.
LEADERS = 4


def integer_vector(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null if one is null or not finite."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.raise_error(F.lit("a component is too large for a long")).cast("long")
    whole = F.transform(wide, lambda x: F.when(F.abs(x * scale) < float(1 << 62), F.floor(x * scale)).otherwise(large))
    return F.when(~F.coalesce(odd, F.lit(True)), whole)


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products without rounding or overflow."""
    most = int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(len(query), 1)
    if most < 1 << 63:
        return vectors @ query
    found = vectors.astype(object) @ query.astype(object)
    if any(not -(1 << 63) <= s < 1 << 63 for s in found):
        raise OverflowError("a score is too large for a long")
    return found.astype(np.int64)


class Index:
    """Posting segments of one shard by dimension and quantised step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        count, dims = vectors.shape
        postings = np.argsort(self.vectors, axis=0, kind="stable").T
        dim, first, size, low, high = [], [], [], [], []
        for d in range(dims):
            values = self.vectors[postings[d], d]
            step = max(1, -(-(int(values[-1]) - int(values[0]) + 1) // levels))
            at = np.flatnonzero(np.r_[True, np.diff((values - values[0]) // step) > 0])
            ends = np.r_[at[1:], count]
            dim.append(np.full(len(at), d))
            first.append(at + d * count)
            size.append(ends - at)
            low.append(values[at])
            high.append(values[ends - 1])
        self.postings = postings.ravel()
        self.dim, self.first, self.size = np.concatenate(dim), np.concatenate(first), np.concatenate(size)
        self.low, self.high = np.concatenate(low).astype(float), np.concatenate(high).astype(float)
        self.read = 0.0  # share of the last query's segments that were processed

    def _postings(self, segments: np.ndarray) -> np.ndarray:
        """The candidates of the segments, one after the other."""
        size = self.size[segments]
        start = self.first[segments] - np.r_[0, np.cumsum(size)[:-1]]
        return self.postings[np.repeat(start, size) + np.arange(size.sum())]

    def search(self, query: np.ndarray, top: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the best `top`, ties to the smaller id."""
        weight = query[self.dim].astype(float)
        most = np.maximum(weight * self.low, weight * self.high)
        least = np.minimum(weight * self.low, weight * self.high)
        floor = np.full(len(query), np.inf)
        np.minimum.at(floor, self.dim, least)
        impact = most - floor[self.dim]  # what the segment adds at most, from the dimension's lowest value on
        rounding = 1e-12 * float(np.abs(most).sum() + np.abs(least).sum())
        order = np.argsort(-impact, kind="stable")
        unbegun = np.zeros(len(query))  # what dimensions not begun can add
        np.maximum.at(unbegun, self.dim, impact)
        begun = np.zeros(len(query), bool)
        allowed = np.flatnonzero(self.ids != own)
        k = min(top, len(allowed))
        if not k:
            return self.ids[:0], np.zeros(0, np.int64)
        count = len(self.ids)
        sums, met = np.zeros(count), np.zeros(count)
        at = 0
        for look in LOOKS:
            upto = math.ceil(look * len(order))
            part = order[at:upto]
            at = upto
            if len(part):
                found = self._postings(part)
                sums += np.bincount(found, np.repeat(impact[part], self.size[part]), count)
                met += np.bincount(found, minlength=count)
                begun[self.dim[part]] = True
                unbegun[begun] = 0.0
            coming = impact[order[at]] if at < len(order) else 0.0
            upper = (sums + coming * (begun.sum() - met))[allowed] + float(unbegun.sum() + floor.sum())
            leaders = allowed[np.argpartition(-upper, min(LEADERS * k, len(upper)) - 1)[: LEADERS * k]]
            marks = self.vectors[leaders].astype(float) @ query.astype(float)
            mark = np.partition(marks, len(marks) - k)[len(marks) - k]
            possible = allowed[upper >= mark - 0.5 - rounding]
            if len(possible) <= max(8 * top, count // 32):
                break
        self.read = look
        exact = exact_scores(self.vectors[possible], query)
        best = np.lexsort([self.ids[possible], -exact])[:top]
        return self.ids[possible][best], exact[best]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    """Rows (shard, block, asks, vec_id, vector) that come sorted, whole groups at a time."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
            if row[:2] != key:
                if held:
                    yield held
                key, held = row[:2], []
            held.append((row[2], row[3], np.asarray(row[4].values.to_numpy(zero_copy_only=False), np.int64)))
    if held:
        yield held


def _searcher(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            dims = max(len(v) for _, _, v in rows)
            ids = np.array([i for _, i, _ in rows], np.int64)
            asks = np.array([a for a, _, _ in rows]) == 1
            vectors = np.zeros((len(rows), dims), np.int64)
            for r, (_, _, v) in enumerate(rows):
                vectors[r, : len(v)] = v
            if asks.all() or not dims:
                continue
            index = Index(ids[~asks], vectors[~asks])
            out = [(q, *index.search(v, top, q)) for q, v in zip(ids[asks].tolist(), vectors[asks])]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in out]), pa.int64()), pa.array(np.concatenate([s for _, _, s in out]), pa.int64())],
                    ["query_id", "vec_id", "score"],
                )

    return run


def top_k(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", top: int = TOP, scale: int = 256,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` best candidates of each query row.

    `is_query` is a condition on `vec_id`.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integer_vector(F.col(embedding), scale).alias("v"))
    rows = stored(rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").distinct(), "vectors")
    queries = rows.where(is_query)
    count, asked = rows.count(), queries.count()
    tasks = 2 * shuffle_partitions(vectors.sparkSession)
    shards = max(1, math.ceil(count / shard_rows), min(tasks, count // LEAST_ROWS))
    blocks = max(1, math.ceil(asked / block_rows), min(math.ceil(tasks / shards), asked // LEAST_ASKED))

    def part(number: int, salt: str) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(number)).cast("int")

    candidates = rows.select(part(shards, "shard").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("asks"), "vec_id", "v")
    asking = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part(blocks, "block").alias("block"), F.lit(1).alias("asks"), "vec_id", "v")
    met = candidates.unionByName(asking).repartition(shuffle_partitions(vectors.sparkSession), "shard", "block")
    found = met.sortWithinPartitions("shard", "block", "asks").mapInArrow(_searcher(top), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
