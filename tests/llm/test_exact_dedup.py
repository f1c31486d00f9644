"""Chunk recipes against plain grouping of texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridcast.llm import exact_dedup


def plain(rows):
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in texts.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [
    (5, "a  b"), (3, "a\tb"), (4, "a b "), (9, None), (8, ""), (7, "  "), (6, " "), (3, "a b"), (None, "x"), (None, "y"), (2, "y"),
    (11, "Long. " * 9000), (10, "Long.\n" * 9000), (12, "é" * 30_000), (13, "é" * 30_000), (14, "é" * 30_001), (15, "A b"), (16, "A b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, keep_id string, recipe long")


def test_odd_rows(spark):
    got = exact_dedup.exact_groups(frame(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)


def test_empty_table(spark):
    docs = frame(spark, ROWS).where(F.lit(False))
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0


def test_chunks_join_to_the_text(spark):
    docs = frame(spark, ROWS).where("text IS NOT NULL")
    cut = docs.select("text", exact_dedup.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in cut)
    assert max(len(x) for r in cut for x in r.c) <= exact_dedup.CHUNK_MAX


def test_shared_chunks_have_one_identifier(spark):
    draw = random.Random(5)
    tail = " ".join("".join(draw.choices("abcdefghijklmnopqrst ", k=60)) + "." for _ in range(200))
    docs = spark.createDataFrame([(1, "Other words here. " * 30 + tail), (2, "Something else, of another length. " * 40 + tail)], "doc_id long, text string")
    a, b = (r.recipe for r in exact_dedup.recipes(docs).orderBy("doc_id").collect())
    assert a != b and len(set(a) & set(b)) >= 5


@pytest.mark.parametrize("weak", [lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_clashing_identifiers_are_replaced(spark, weak):
    docs = frame(spark, ROWS)
    assert not exact_dedup.clashes(docs.where("text IS NOT NULL"), weak).isEmpty()
    made = exact_dedup.recipes(docs, identifiers=(weak, exact_dedup.sha256)).collect()
    assert len({tuple(r.recipe) for r in made}) == len({r.text_sha256 for r in made})
    with pytest.raises(ValueError):
        exact_dedup.recipes(docs, identifiers=(weak,))


def test_deduplicate_keeps_one_row_of_each_text(spark):
    once = [r for r in ROWS if r not in ((3, "a b"),) and r[0] is not None]
    got = exact_dedup.deduplicate(frame(spark, once))
    assert got.columns == ["doc_id", "text", "keep_id", "recipe"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in plain(once) if r[3])
    again = exact_dedup.deduplicate(frame(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in again) == sorted(str(x) for x in {(r[0], r[4]) for r in plain(ROWS) if r[3]} for x in [x[0]])
