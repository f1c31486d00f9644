"""Line dedup against plain counting, and its reversals."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import line_dedup
from gridcast.llm.line_dedup import CuckooFilter, Filters, LineIndex


def plain(rows, counted=None, least_docs=3, least_chars=1):
    """rows: (doc_id, text); counted: the documents whose lines count."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = Counter()
    for _, text in rows if counted is None else counted:
        n.update({key(x) for x in (text or "").split("\n")})
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or n[key(x)] < least_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ODD = [
    (1, "Same line\nown 1\n"), (2, " same LINE\t\nown 2"), (3, "x\n\nSAME line \r\nx"), (4, None), (5, ""), (6, "\n\n\n"), (None, "null id\nsame line"),
    (7, "é\nÉ"), (8, "é\nown 8"), (9, "É"), (9, "É"), (10, "a \na"), (11, "a "), (12, " a\na  "), (13, "w " * 50_000 + "\nsame line"),
    (14, "same line\n" * 30_000 + "end"),
]


def frame(spark, rows, extra=True):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumn("n", F.lit(1)).withColumn("key", F.lit("x")).withColumn("Filter", F.lit(0)) if extra else made


def rows_of(df):
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("filter_bytes", [line_dedup.FILTER_BYTES, 0])
@pytest.mark.parametrize("least_chars", [1, 2])
def test_odd_rows(spark, filter_bytes, least_chars):
    docs = frame(spark, ODD).repartition(3)
    index = line_dedup.built(docs, 3, least_chars, filter_bytes=filter_bytes)
    assert rows_of(line_dedup.cleaned(docs, index, filter_bytes=filter_bytes)) == plain(ODD, least_chars=least_chars)


def test_empty_table(spark):
    docs = frame(spark, ODD).where(F.lit(False))
    index = line_dedup.built(docs)
    assert index.counts.count() == 0 and line_dedup.cleaned(docs, index).count() == 0


def drawn(seed, n):
    draw = random.Random(seed)
    return [(i, "\n".join(f"line {min(draw.randrange(60), draw.randrange(60))}" for _ in range(draw.randrange(12)))) for i in range(n)]


def test_insertions_and_deletions_are_reversible(spark):
    first, more = drawn(1, 60), drawn(2, 80)
    one, two = frame(spark, first, False), frame(spark, more, False)
    index = line_dedup.built(one, 8)
    both = line_dedup.inserted(index, two)
    assert rows_of(line_dedup.cleaned(two, both)) == plain(more, first + more, 8)
    back = line_dedup.deleted(both, two)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    assert rows_of(line_dedup.cleaned(one, back)) == plain(first, None, 8)
    none = line_dedup.deleted(back, one)
    assert none.counts.count() == 0 and none.filters.count() == 0
    with pytest.raises(ValueError):
        line_dedup.deleted(back, two)


def test_more_keys_than_the_filters_were_made_for(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    rows = [(i, "\n".join(f"l{j}" for j in range(i % 300))) for i in range(600)]
    few, rest = frame(spark, rows[:20], False), frame(spark, rows[20:], False)
    index = line_dedup.built(few, 2)
    grown = line_dedup.inserted(index, rest)
    assert grown.bits > index.bits + 1  # dealt anew into more shards
    assert rows_of(line_dedup.cleaned(rest, grown)) == plain(rows[20:], rows, 2)
    fewer = line_dedup.deleted(grown, rest)
    assert rows_of(line_dedup.cleaned(few, fewer)) == plain(rows[:20], None, 2)


def test_index_is_read_again(spark, tmp_path):
    docs = frame(spark, ODD)
    line_dedup.built(docs, 3).write(str(tmp_path / "index"))
    again = LineIndex.read(spark, str(tmp_path / "index"))
    assert rows_of(line_dedup.cleaned(docs, again)) == plain(ODD)


def test_mistakes_of_filters_are_known(spark):
    """Of many rare lines some hit a filter, and none of them goes."""
    line = F.concat(F.lit("line "), F.col("id").cast("string"))
    key = F.substring(F.unhex(F.sha2(line, 256)), 1, 16).alias("key")
    counts = spark.range(300_000).select(key, F.when(F.col("id") % 2 == 0, 10).otherwise(9).cast("long").alias("n"))
    index = line_dedup._filtered(counts, 10, 1, line_dedup.FILTER_BYTES)
    assert 0 < index.mistakes.count() < 100
    wrong = index.mistakes.join(spark.range(300_000).select(key, line.alias("text")), "key").select("text")
    docs = wrong.withColumn("doc_id", F.lit(1)).unionByName(spark.createDataFrame([("line 2\nline 3", 2)], "text string, doc_id int"))
    made = line_dedup.cleaned(docs, index).collect()
    assert {r.n_dropped for r in made if r.doc_id == 1} == {0} and [r.text for r in made if r.doc_id == 2] == ["line 3"]


def test_cuckoo_filter():
    draw = np.random.default_rng(4)
    keys = draw.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    made = CuckooFilter.of(keys)
    know = lambda f, k: Filters(0, {0: f.bytes()}).know([bytes(8) + int(x).to_bytes(8, "big") for x in k])
    assert know(made, keys).all()
    made.remove(keys[:10_000])
    assert know(made, keys[10_000:]).all() and know(made, keys[:10_000]).mean() < 0.01
    assert made.add(keys[:10_000]) and know(made, keys).all()
    small = CuckooFilter.sized(8)
    assert not small.add(keys[:100])
