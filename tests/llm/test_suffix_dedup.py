"""Passage removal against a plain dictionary of all strings."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridcast.llm import suffix_dedup as S


def plain(rows):
    """[(doc_id, text)] to sorted (doc_id, n_bytes, n_removed, n_spans, sha256)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    order = lambda i: S.LAST_ID if i is None else i
    for i, t in texts:
        for p in range(len(t) - 49):
            s = t[p : p + 50]
            least[s] = min(order(i), least.get(s, order(i)))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = bytes(gone).replace(b"\1\0", b"\1 ").count(b" ") + (gone[-1:] == b"\1")
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, parts=3, **sizes):
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, tokens string, base long").repartition(parts)
    got = S.digest(S.suffix_dedup(docs, **sizes)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = S.digest(S.suffix_dedup(docs)).collect()
    assert sorted(map(tuple, got), key=str) == plain([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("block, piece", [(S.BLOCK, S.PIECE), (300, 97)])
def test_odd_rows(spark, block, piece):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé漢", k=rng.randint(1, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, line = text(40), "A line that is common to many documents, with fifty bytes and more."
    rows = [(i, text(rng.randint(0, 30)) + rng.choice(["", passage, passage[20:90], line]) + text(rng.randint(0, 30))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "short"), (63, line[:50]), (64, line[:49]), (65, line[1:51]), (66, "ab" * 400), (67, "ab" * 300), (68, "x" * 120)]
    rows += [(69, rows[3][1]), (70, rows[3][1]), (70, rows[3][1]), (70, passage + "!" + passage), (None, passage), (None, line), (71, line * 20), (5, line * 3), (72, "x" * 49 + "y")]
    check(spark, rows, block=block, piece=piece)


def test_hot_passage_and_empty_table(spark):
    passage = "This passage stands in every one of the documents, word for word, and is rather long. " * 3
    rows = [(i, f"{i} {passage} {i * i}") for i in range(300)]
    check(spark, rows, 20)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.suffix_dedup(empty).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (500, 50), dtype=np.uint8)
    rows[::3] = rows[0]
    rows[1::7, :20] = rows[1, :20]
    rows[5::9, :] = 255
    order, shared = S.suffix_order(rows)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(r.tobytes() for r in rows)
    for a, b, n in zip(texts, texts[1:], shared[1:]):
        assert n == next((k for k in range(50) if a[k] != b[k]), 50)


def test_packed_numbers():
    a, b = np.arange(5) - 2, np.zeros(0, np.int64)
    for x, y in zip(S.unpack(S.pack(a, b)), (a, b)):
        assert (x == y).all() and len(x) == len(y)


def test_spans_stay_whole_numbers(spark):
    made = S.suffix_dedup(spark.createDataFrame([(1, "q" * 60), (2, "q" * 70)], "doc_id long, text string"))
    assert {(r.doc_id, tuple(r.starts), tuple(r.ends), bytes(r.kept)) for r in made.collect()} == {(1, (), (), b"q" * 60), (2, (0,), (70,), b"")}
    assert made.where(F.col("kept").isNull()).count() == 0


def listed(text, buckets):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([0])], ["doc_id", "text", "row"])
    return [b for made in S._token_hashes(buckets, (S.BLOCK, S.PIECE))(iter([batch])) for b in made.to_pylist()]


def test_a_block_costs_the_same_at_any_number_of_buckets():
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(140_000))[: 1 << 20]
    listed(text, 200)
    took = []
    for buckets in (200, 1_000_000):
        start = time.perf_counter()
        made = listed(text, buckets)
        took.append(time.perf_counter() - start)
        assert len(made) <= S.GROUPS + 1
        assert sum(len(b["blob"]) for b in made) < 1 << 20
    assert took[1] < 2 * took[0] + 0.2


def test_lists_are_cut_again_and_many_buckets_give_the_same(spark, monkeypatch):
    """Every bucket far smaller than the texts: two deals of hashes, hashed parts of ranges."""
    for name, value in (("HASH_BUCKET", 64), ("SUFFIX_BUCKET", 128), ("GROUPS", 3), ("SPLITTERS", 5), ("REGROUPED", 50)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcde", k=4)) for _ in range(30)]
    passage = " ".join(rng.choices(words, k=60))
    rows = [(i, " ".join(rng.choices(words, k=20)) + (passage[i : i + 120] if i % 2 else "")) for i in range(40)] + [(3, passage), (None, passage), (None, passage[::-1])]
    check(spark, rows)


def test_lists_of_one_id_grow_with_its_rows(spark):
    """Rows of one id are told of their own tokens: the numbers joined grow in proportion."""
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=25)) for _ in range(400)]
    joined = []
    for n in (100, 200, 400):
        rows = [(i % 2 if i < n else None, passages[i % n] + f" {i} " + passages[(i * 7) % n]) for i in range(2 * n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        numbered, repeated = S._numbered(docs, "doc_id", "text")
        assert repeated and numbered.select("doc_id", "row").distinct().count() == len(set(rows))
        hashes = numbered.mapInArrow(S._token_hashes(8, (S.BLOCK, S.PIECE)), "bucket long, kind int, blob binary").repartition(4, "bucket").sortWithinPartitions("bucket")
        told = hashes.mapInArrow(S._shared_tokens, "doc_id long, row long, token long")
        lists = told.groupBy("doc_id", "row").agg(F.collect_set("token").alias("tokens"))
        joined.append(numbered.join(lists, ["doc_id", "row"]).agg(F.sum(F.size("tokens"))).first()[0])
    assert joined[1] < 2.5 * joined[0] and joined[2] < 2.5 * joined[1]
    check(spark, rows[:120] + [(5, passages[0])] * 30 + [(None, passages[0])] * 30)
