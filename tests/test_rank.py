import random

import pytest
from pyspark.sql import functions as F

from gridcast.operators.rank import chrono_split, first_rows, key_ordinal, last_rows, rank_cutoff, row_ordinal


def shuffled_rows(seed, n=200):
    """One series with most of the rows, few distinct times, many ties."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        series = "hot" if r.random() < 0.7 else r.choice("abc")
        ts = f"2024-01-{r.randint(1, 3):02d} 0{r.randint(0, 2)}:00:0{r.randint(0, 1)}.{r.choice(['000001', '5', '0'])}"
        rows.append((series, ts, i - 50))
    return rows


def brute(rows):
    by = {}
    for s, t, i in rows:
        by.setdefault(s, []).append((t, i))
    return {s: sorted(v) for s, v in by.items()}


@pytest.fixture
def ties(frame):
    rows = [(s, t.ljust(26, "0"), i) for s, t, i in shuffled_rows(1)]
    return brute(rows), frame(rows, "series_id string, ts ntz, id long").repartition(5)


@pytest.mark.parametrize("fraction", [0.005, 0.7, 1.0])
def test_split_with_ties(ties, fraction):
    want, df = ties
    got = {(r["series_id"], r["id"]): r["is_train"] for r in chrono_split(df, fraction, tie="id").collect()}
    assert len(got) == sum(map(len, want.values()))
    for s, ordered in want.items():
        for place, (_, i) in enumerate(ordered):
            assert got[s, i] == (place < int(len(ordered) * fraction))


@pytest.mark.parametrize("n", [7, 1000])
def test_first_and_last(ties, n):
    want, df = ties
    first = {(r["series_id"], r["id"]) for r in first_rows(df, n, tie="id").collect()}
    last = {(r["series_id"], r["id"]) for r in last_rows(df, n, tie="id").collect()}
    assert first == {(s, i) for s, v in want.items() for _, i in v[:n]}
    assert last == {(s, i) for s, v in want.items() for _, i in v[-n:]}


@pytest.mark.parametrize("leaf_rows", [3, 1000])
def test_ordinal(ties, leaf_rows):
    want, df = ties
    got = {(r["series_id"], r["id"]): r["ordinal"] for r in row_ordinal(df, tie="id", leaf_rows=leaf_rows).collect()}
    assert got == {(s, i): p for s, v in want.items() for p, (_, i) in enumerate(v, 1)}


def test_tables_too_large_to_broadcast_are_shuffled(ties, monkeypatch):
    want, df = ties
    monkeypatch.setattr("gridcast.operators.align.attach.__defaults__", ("left", None, 0))
    got = {(r["series_id"], r["id"]) for r in first_rows(df, 7, tie="id").collect()}
    assert got == {(s, i) for s, v in want.items() for _, i in v[:7]}


def test_cutoff_of_large_and_negative_numbers(spark):
    values = [-(1 << 50), -7, -6, 0, 5, (1 << 45) + 3, 1 << 60]
    series = range(1, len(values) + 1)
    df = spark.createDataFrame([(s, v) for s in series for v in values], "series_id int, v long")
    ranks = spark.createDataFrame([(s, s) for s in series], "series_id int, rank long")
    cut = rank_cutoff(df, ranks, [("v", F.col("v"), (1 << 42, 1 << 21, 1))], ["series_id"])
    assert {r["series_id"]: r["v_cut"] for r in cut.collect()} == dict(zip(series, values))


def test_keys_are_numbered_in_order(spark):
    keys = [f"s{i:03d}" for i in range(100)]
    df = spark.createDataFrame([(k,) for k in keys * 3], "series_id string").repartition(9)
    got = {r["series_id"]: r["ordinal"] for r in key_ordinal(df).collect()}
    assert got == {k: i for i, k in enumerate(keys, 1)}
