"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridcast.llm import collocations
from gridcast.session import stored


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain_counts(rows, max_words):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, max_words + 1):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    return f, n


def plain(rows, max_words=3, least=10, top=2000):
    f, n = plain_counts(rows, max_words)
    common = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in common.items():
        covers = [b for (x, v), b in common.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 50 * a for b in covers):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def drawn(seed, docs=40, words=9, spaces=(" ",)):
    draw = random.Random(seed)
    kinds = ["a", "B", "cé", "É", "of", "the", "×9", "-", "x" * 40]
    passage = " ".join(draw.choice(kinds) for _ in range(30))
    out = []
    for i in range(docs):
        text = "".join(draw.choice(kinds[:words]) + draw.choice([*spaces, " ", " ", ". ", ",", "\n"]) for _ in range(draw.randrange(80)))
        out.append((draw.choice(["en", "fr", None, "und"]), text + (passage if i % 3 == 0 else "")))
    return out


ODD = [("en", None), ("en", ""), (None, " \t\n"), ("en", "a b " * 3000), ("fr", "z" * 20_000 + " b"), ("", "a. b! c?"), ("en", "...")]


def frame(spark, rows):
    made = spark.createDataFrame(rows, "lang string, text string")
    return made.withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1)).withColumn("Chunk", F.lit(2))


@pytest.mark.parametrize("max_words, period", [(3, 16), (3, 1), (3, 3), (2, 2), (4, 2)])
def test_equals_plain_counting(spark, max_words, period):
    rows = drawn(max_words + period, spaces=("  ", "\t")) + ODD
    got = collocations.collocations(frame(spark, rows).repartition(3), max_words, 5, 50, period=period)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, max_words, 5, 50)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("en", "...")], [("en", "a b c")]):
        assert collocations.collocations(frame(spark, rows)).count() == 0


def test_every_word_is_owned_once(spark):
    rows = drawn(7) + ODD
    _, n = plain_counts(rows, 1)
    for period in (1, 2, 50):
        made = collocations.dictionary(frame(spark, rows), 3, period=period)
        sizes = made.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
        assert {r.lang: r.n for r in sizes.collect()} == {k: v for k, v in n.items() if v}


def test_equal_passages_give_equal_chunks():
    draw = random.Random(3)
    passage = " ".join("".join(draw.choices("abcdefg", k=5)) for _ in range(400))
    texts = [f"{i} other words {i} before {passage} and after {i}".encode() for i in range(50)]
    found = collocations.parse(texts)
    assert sum(own for (_, own), n in found.items() if n == 50) > 350  # all but the passage's ends
    assert sum(own * n for (_, own), n in found.items()) == sum(len(t.split()) for t in texts)


def test_one_word_repeated_is_one_chunk_or_few():
    for period in (1, 16):
        found = collocations.parse([b"a " * 100_000], period=period)
        assert sum(own * n for (_, own), n in found.items()) == 100_000 and len(found) <= 4


def test_a_filter_that_is_full_changes_no_count(spark):
    rows = drawn(11)
    chunks = stored(collocations.dictionary(frame(spark, rows)), "chunks")
    few, many = (collocations.frequent_phrases(chunks, 3, 4, bits) for bits in (64, 1 << 20))
    f, _ = plain_counts(rows, 3)
    for words, (a, b) in enumerate(zip(few, many), 1):
        want = sorted((k[0], " ".join(k[1]), n) for k, n in f.items() if n >= 4 and len(k[1]) == words)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_037_000_501_234
    one = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 11), ("en", "c", 10**15)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", big), ("en", "b c", big - 1)], one.schema)
    three = spark.createDataFrame([("en", "a b c", 12)], one.schema)
    got = {r.phrase: tuple(r) for r in collocations.scored([one, two, three]).collect()}
    assert got["a b"] == ("en", "a b", big, big + 7, big + 11, 10**6 * big * big // ((big + 7) * (big + 11)))
    assert got["a b c"][3:] == (big + 7, big - 1, 0)  # both cuts floor to 0: the first one counts


def test_first_rows_do_not_depend_on_parts(spark):
    rows = [("en", f"p {i % 50} {i}", 10 + i % 7, i % 5) for i in range(500)] + [("fr", "q r", 10, 1)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = [sorted(map(tuple, collocations.first_rows(phrases, 40, parts).collect())) for parts in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 41


def test_blocks_hold_every_row(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 10)
    texts = ["", "abc", None, "x" * 50, "y", "", "zz" * 3, "w" * 10, "v"]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * n), pa.array(texts[a : a + n], pa.string())], ["l", "t"]) for a, n in ((0, 4), (4, 0), (4, 5))]
    blocks = list(collocations._blocks(iter(batches), 1))
    assert [t for b in blocks for t in b.column(1).to_pylist()] == texts and len(blocks) > 3
