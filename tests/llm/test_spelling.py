"""Spelling variants against all single edits of every word."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridcast.llm import spelling


def plain_words(rows, least_chars=7, least_count=2, spoilt=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spoilt == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= least_chars
    return {w: c for w, c in n.items() if c >= least_count}


def plain_near(words):
    shapes = {}
    for w in words:
        for i in range(len(w)):
            shapes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), found in shapes.items():
        if a + b in words:
            found = found | {a + b}
        for w in found:  # all differ in this one place; the shorter one is near to all of them
            near[w] |= found - {w}
    return near


def plain(words, times=10):
    near, out = plain_near(words), []
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], None if form[w] is None else words[form[w]], root))
    return sorted(out)


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def rows_of(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(map(tuple, df.collect()))


def drawn(seed, n, letters="abé", low=7, high=10):
    draw = random.Random(seed)
    return {"".join(draw.choices(letters, k=draw.randint(low, high))): int(10 ** draw.uniform(0, 4)) for _ in range(n)}


@pytest.mark.parametrize("words", [
    drawn(1, 300), drawn(2, 200, "ab"), drawn(3, 300, "abcdefgh×÷ÿÀ", 7, 8), drawn(4, 60, "a", 7, 40),
    {"a" * k: 10 ** (k % 5) for k in range(7, 30)},
], ids=["three", "two", "many", "one", "chain"])
def test_equals_all_edits(spark, words):
    assert rows_of(spelling.spelling_variants(table(spark, words).repartition(3))) == plain(words)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_short_words(spark, least):
    words = drawn(least, 60, "abc", least, 5)
    assert rows_of(spelling.spelling_variants(table(spark, words), least)) == plain(words)


def test_edits_at_every_place(spark):
    word = "abcdefghijk"
    words = {word: 1000, "zzzzzzzz": 5}
    words |= {word[:i] + word[i + 1 :]: 20 for i in range(11)} | {word[:i] + "m" + word[i:]: 30 for i in range(12)} | {word[:i] + "n" + word[i + 1 :]: 40 for i in range(11)}
    made = rows_of(spelling.spelling_variants(table(spark, words)))
    assert made == plain(words)
    assert {r[0]: r[2] for r in made}[word] == 34


def test_forms_are_followed_to_the_last(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "aabbbbb": 100_000, "abbbbbb": 10**6, "abbbbbc": 10**6}
    made = {r[0]: r[5] for r in rows_of(spelling.spelling_variants(table(spark, words)))}
    assert made["aaaaaaa"] == "abbbbbb" and made["abbbbbc"] == "abbbbbc"


def test_very_long_words_take_few_levels(spark):
    draw = random.Random(6)
    long = "".join(draw.choices("abcdef", k=200_000))
    words = {long: 50, long[:-1]: 3, long[:99_999] + "z" + long[100_000:]: 2, long[1:]: 600, "shorter": 2}
    made = {r[0]: r[1:] for r in rows_of(spelling.spelling_variants(table(spark, words)))}
    assert made[long][1] == 3 and made[long][2] == long[1:] and made["shorter"] == (2, 0, None, None, "shorter")
    assert made[long[1:]][1] == 1 and made[long[:-1]][4] == long[1:]


ODD = [
    (1, None), (2, ""), (3, "no! word? here"), (None, "nullidword nullidword nullidword"), (4, "Wörterbuch wörterbuch WÖRTERBUCH"), (5, "Ärztehaus ärztehaus"),
    (6, "abcdefg abcdefh " * 40), (6, "abcdefg abcdefh " * 40), (7, "x" * 100_000 + " " + "x" * 100_000), (8, "a×b÷cÿde a×b÷cÿde aĀbcdefgh"),
]


def test_words_of_odd_rows(spark):
    draw = random.Random(8)
    more = [(i, " ".join("".join(draw.choices("abcd", k=8)) for _ in range(40))) for i in range(100)]
    docs = spark.createDataFrame(ODD + more, "doc_id long, text string").withColumns({"n": F.lit("x"), "word": F.lit(1), "Pos": F.lit(2)})
    want = plain_words(ODD + more)
    assert dict(map(tuple, spelling.word_counts(docs).collect())) == want
    assert rows_of(spelling.spelling_variants(spelling.word_counts(docs))) == plain(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(docs)).count() == 0
