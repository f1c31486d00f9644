"""Top-k search against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank int, score string"


def plain(rows, is_query, top=5):
    known = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in known:
        if not is_query(q):
            continue
        scores = sorted({(-sum(x * y for x, y in zip(a, b)), c) for c, b in known if c != q})[:top]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 3 == 0, **sizes).collect()))


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 37, "block_rows": 9}])
def test_all_pairs(spark, sizes):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(230)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(500, [0.0] * 12), (501, [1e3] + [0.0] * 11), (9, rows[9][1])]
    rows += [(600, None), (603, []), (606, [1.0, None]), (609, [float("nan")] * 12), (612, [float("inf")] * 12), (None, [1.0] * 12), (615, [0.5, -0.5])]
    assert run(spark, rows, **sizes) == plain(rows, lambda q: q % 3 == 0)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-1.0, 0.25])]
    assert run(spark, rows) == plain(rows, lambda q: q % 3 == 0)
    assert run(spark, rows[:1]) == [] and run(spark, [(1, [1.0])]) == []


def test_processing_stops_on_proof_and_stays_exact(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(-20, 20, (3000, 16)), rng.integers(200, 256, (6, 16))])
    index = topk.Index(np.arange(len(vectors)), vectors)
    looked = []
    real = np.bincount
    monkeypatch.setattr(topk.np, "bincount", lambda *a, **k: looked.append(1) or real(*a, **k))
    query = rng.integers(1, 100, 16)
    ids, scores = index.search(query, 5, -1)
    want = np.lexsort([np.arange(len(vectors)), -(vectors @ query)])[:5]
    assert ids.tolist() == want.tolist() and scores.tolist() == (vectors @ query)[want].tolist()
    assert len(looked) < len(topk.LOOKS)


@pytest.mark.parametrize("seed", range(4))
def test_proof_comes_early_on_dense_vectors(seed):
    """Unit vectors without any structure, as embeddings may be: every query stops before its last segments."""
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(3000, 48))
    vectors = np.floor(256 * made / np.linalg.norm(made, axis=1, keepdims=True)).astype(np.int64)
    ids = rng.permutation(len(vectors))
    index = topk.Index(ids, vectors)
    for own in range(0, 3000, 300):
        query = vectors[own]
        found, scores = index.search(query, 5, ids[own])
        others = np.flatnonzero(ids != ids[own])
        want = others[np.lexsort([ids[others], -(vectors[others] @ query)])[:5]]
        assert found.tolist() == ids[want].tolist() and scores.tolist() == (vectors[want] @ query).tolist()
        assert index.read < 1.0


def test_zero_constant_and_opposed_vectors():
    """Dimensions in which all are equal, queries of zeros, negative components, ties everywhere."""
    rng = np.random.default_rng(9)
    vectors = np.column_stack([np.full(400, 7), rng.integers(-2, 3, (400, 5)), np.zeros(400, int)]).astype(np.int64)
    index = topk.Index(np.arange(400), vectors)
    for query in [np.zeros(7, np.int64), -vectors[3], vectors[5] * np.array([1, -1, 1, -1, 0, 3, 9])]:
        found, scores = index.search(query, 6, 11)
        others = np.delete(np.arange(400), 11)
        want = others[np.lexsort([others, -(vectors[others] @ query)])[:6]]
        assert found.tolist() == want.tolist() and scores.tolist() == (vectors[want] @ query).tolist()


@pytest.mark.parametrize("size", [1e3, 1e6, 1e8, 5e6])
def test_large_components(spark, size):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-size, size) for _ in range(3)]) for i in range(60)] + [(90, [size, -size, size]), (91, [size, -size, size * (1 - 1e-9)])]
    if size < 1e8:
        assert run(spark, rows) == plain(rows, lambda q: q % 3 == 0)
    else:  # scores beyond a long
        with pytest.raises(Exception, match="too large for a long"):
            run(spark, rows)


def test_components_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="too large for a long"):
        run(spark, [(0, [1e30]), (3, [1.0])])


def test_exact_scores_where_products_pass_longs():
    vectors = np.array([[1 << 40, 1 << 40], [(1 << 40) + 1, -(1 << 40)]])
    query = np.array([1 << 40, -(1 << 40) + 3])
    want = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors]
    assert topk.exact_scores(vectors[:1], query).tolist() == want[:1]
    with pytest.raises(OverflowError):
        topk.exact_scores(vectors, query)
