"""Mixing against plain sorting and prefix sums."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from gridcast.llm import mixing


def plain_targets(sizes):
    """By sharing out and capping until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = left / max(1, sum(weight[s] for s in names if s not in capped))
        new = {s for s in names if s not in capped and weight[s] * share > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in capped else weight[s] * share for s in names}
        capped |= new


def plain(docs, labels):
    quality = {}
    for i, q in labels:
        if q is not None:
            quality[i] = max(q, quality.get(i, q))
    sizes, rows = {}, {}
    for i, t, s in docs:
        n = len((t or "").encode().split())
        u = (int(hashlib.md5(f"mix/{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        rows.setdefault(s, []).append((-math.log(u) / {0: 0.5, 1: 2.0}.get(quality.get(i), 1.0), i, n))
        sizes[s] = sizes.get(s, 0) + n
    out = []
    for s, target in plain_targets(sizes).items():
        epochs = int(target // sizes[s]) if sizes[s] else 0
        rest, upto = target - epochs * sizes[s], 0
        for key in sorted({r[0] for r in rows[s]}):
            tied = [r for r in rows[s] if r[0] == key]
            own = sum(r[2] for r in tied)
            upto += own
            take = epochs + (rest > 0 and 2 * upto - own <= 2 * rest)
            out += [(i, s, n, sizes[s], round(target, 6), take) for _, i, n in tied]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.times) for r in df.collect()), key=str)


DOCS = [(i, "word " * (i * 7 % 23), f"s{i * i % 11}" if i % 3 else "hot") for i in range(600)]
DOCS += [(700, None, None), (701, "", None), (702, "a b", None), (703, "x", "tiny"), (704, "", "empty"), (None, "q q", "hot"), (None, "q", "hot"), (5, "word " * 12, "s3"), (705, "é " * 60_000, "long"), (706, "u\x0bv\u00a0w", "Z")]
LABELS = [(i, i % 2) for i in range(0, 600, 2)] + [(4, 1), (3, None), (9, 7), (700, 1)]


def tables(spark):
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in DOCS], "doc_id long, text string, source string, times int, quality string")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int")


def test_plan(spark, monkeypatch):
    docs, labels = tables(spark)
    want = plain(DOCS, LABELS)
    assert got(mixing.plan(docs, labels)) == want
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)  # many key ranges
    assert got(mixing.plan(docs, labels)) == want


def test_words_come_near_their_targets(spark):
    docs, labels = tables(spark)
    rows = mixing.plan(docs, labels).groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("times").alias("times"))
    for r in rows.collect():
        assert abs(r.taken - r.target) <= r.most / 2 + 1e-6 and r.times <= 3


def test_mixed_rows(spark):
    docs, labels = tables(spark)
    rows = mixing.mixed(docs, labels)
    assert rows.columns == docs.columns
    want = {}
    for i, s, n, _, _, times in plain(DOCS, LABELS):
        want[i, s] = want.get((i, s), 0) + times
    have = {(r.doc_id, r.source): r["count"] for r in rows.groupBy("doc_id", "source").count().collect()}
    assert have == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("name", ["_one", "_ONE", "_id", "_source", "Times", "range", "key"])
def test_mixed_rows_keep_clashing_columns(spark, name):
    docs, labels = tables(spark)
    docs = docs.drop("times").withColumn(name, F.col("doc_id") * 2)
    made = mixing.mixed(docs, labels)
    assert made.columns == docs.columns and made.where(f"NOT (`{name}` <=> doc_id * 2)").count() == 0 and made.count() > 0


def test_empty(spark):
    docs, labels = tables(spark)
    assert mixing.plan(docs.where(F.lit(False)), labels).count() == 0
    assert got(mixing.plan(docs, labels.where(F.lit(False)))) == plain(DOCS, [])
