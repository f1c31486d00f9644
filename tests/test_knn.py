import numpy as np
import pandas as pd
import pytest

from gridcast.operators import knn as K
from gridcast.operators.knn import knn_regress


def squared(x, t):
    """Plain left-to-right sum; the built-in one compensates and breaks ties otherwise."""
    total = 0.0
    for a, b in zip(x, t):
        total += (a - b) * (a - b)
    return total


def brute(train, queries, k):
    out = {}
    for q, x in queries:
        d = [(squared(x, t), i, y) for i, t, y in train]
        out[q] = float(np.mean([y for _, _, y in sorted(d)[:k]]))
    return out


def as_frames(spark, train, queries):
    t = spark.createDataFrame([(i, *x, y) for i, x, y in train], "id long, a double, b double, c double, y double")
    q = spark.createDataFrame([(i, *x) for i, x in queries], "id long, a double, b double, c double")
    return t.repartition(4), q.repartition(4)


@pytest.mark.parametrize("k", [1, 5])
def test_equals_brute_force_with_clusters_copies_and_busy_tiles(spark, k):
    r = np.random.default_rng(k)
    tight = r.normal(0, 0.01, (150, 3))
    wide = r.uniform(-5, 5, (150, 3))
    copies = np.tile([[1.0, 1.0, 1.0]], (60, 1))
    points = np.round(np.concatenate([tight, wide, copies]), 3)
    train = [(i, tuple(map(float, x)), float(i % 17)) for i, x in enumerate(points)]
    asked = np.round(np.concatenate([r.normal(0, 0.02, (120, 3)), r.uniform(-6, 6, (30, 3)), copies[:5]]), 3)
    queries = [(i, tuple(map(float, x))) for i, x in enumerate(asked)]
    t, q = as_frames(spark, train, queries)
    got = knn_regress(t, q, ["a", "b", "c"], "y", "id", k, tile_rows=16, queries_per_task=20)
    assert {r["id"]: r["prediction"] for r in got.collect()} == pytest.approx(brute(train, queries, k))


def test_rows_that_agree_in_some_features_are_cut_by_others(spark):
    r = np.random.default_rng(7)
    train = [(i, (1.0, 2.0, float(x)), float(i)) for i, x in enumerate(np.round(r.uniform(0, 9, 200), 4))]
    train += [(200 + i, tuple(map(float, x)), 0.0) for i, x in enumerate(np.round(r.uniform(0, 9, (40, 3)), 4))]
    t, q = as_frames(spark, train, [(i, (1.0, 2.0, i / 10)) for i in range(90)])
    sizes = K._tiled(t, ["a", "b", "c"], 240, 5)[0].groupBy("_tile").count().collect()
    assert max(x["count"] for x in sizes) <= 5 and sum(x["count"] for x in sizes) == 240
    got = knn_regress(t, q, ["a", "b", "c"], "y", "id", tile_rows=5)
    queries = [(i, (1.0, 2.0, i / 10)) for i in range(90)]
    assert {r["id"]: r["prediction"] for r in got.collect()} == pytest.approx(brute(train, queries, 5))


def test_one_feature(spark):
    r = np.random.default_rng(8)
    train = [(i, (float(x), 0.0, 0.0), float(i % 9)) for i, x in enumerate(np.round(r.normal(0, 1, 900), 3))]
    queries = [(i, (float(x), 0.0, 0.0)) for i, x in enumerate(np.round(r.normal(0, 2, 200), 3))]
    t, q = as_frames(spark, train, queries)
    sizes = K._tiled(t, ["a"], 900, 8)[0].groupBy("_tile").count().collect()
    assert len(sizes) > 80
    got = knn_regress(t, q, ["a"], "y", "id", tile_rows=8)
    assert {r["id"]: r["prediction"] for r in got.collect()} == pytest.approx(brute(train, queries, 5))


@pytest.mark.parametrize("part_rows", [40, 10_000])
def test_a_bounded_upper_tree_with_long_tiles_in_parts(spark, monkeypatch, part_rows):
    """Two tiles at most in the upper tree: tasks cut them by trees of their own, and long ones are dealt into parts."""
    monkeypatch.setattr(K, "TREE_TILES", 2)
    monkeypatch.setattr(K, "LEAF_ROWS", 8)
    r = np.random.default_rng(11)
    points = np.round(np.concatenate([r.normal(0, 1, (260, 3)), np.tile([[0.5, 0.5, 0.5]], (40, 1))]), 2)
    train = [(i, tuple(map(float, x)), float(i % 13)) for i, x in enumerate(points)]
    queries = [(i, tuple(map(float, x))) for i, x in enumerate(np.round(r.normal(0, 1.5, (80, 3)), 2))]
    t, q = as_frames(spark, train, [*queries, (99, (0.5, 0.5, 0.5))])
    assert K._tiled(t, ["a", "b", "c"], 300, 8)[0].select("_tile").distinct().count() <= 8
    got = knn_regress(t, q, ["a", "b", "c"], "y", "id", 5, tile_rows=8, queries_per_task=30, part_rows=part_rows)
    want = brute(train, [*queries, (99, (0.5, 0.5, 0.5))], 5)
    assert {r["id"]: r["prediction"] for r in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("seed", range(5))
def test_leaves_of_one_task_equal_comparing_all(seed):
    r = np.random.default_rng(seed)
    points = np.round(r.normal(0, 1, (700, 2)), 1)  # many ties
    points[:90] = points[0]
    ids, asked = r.permutation(700), np.round(r.normal(0, 2, (150, 2)), 1)
    got = K.Leaves(points, ids, 7, 10).nearest(asked)
    want = K._compared(asked, points, ids, 7)
    assert got[0].tolist() == want[0].tolist()
    assert ids[got[1]].tolist() == ids[want[1]].tolist() and got[2].tolist() == want[2].tolist()


def test_a_walk_of_one_tasks_leaves_compares_few_rows(monkeypatch):
    r = np.random.default_rng(3)
    seen = []
    real = K._compared
    monkeypatch.setattr(K, "_compared", lambda a, p, i, k: seen.append(len(a) * len(p)) or real(a, p, i, k))
    K.Leaves(r.uniform(0, 1, (100_000, 2)), np.arange(100_000), 5, 128).nearest(r.uniform(0, 1, (200, 2)))
    assert sum(seen) < 200 * 100_000 / 50


def test_fewer_rows_than_neighbours(spark):
    t, q = as_frames(spark, [(1, (0.0, 0.0, 0.0), 2.0), (2, (9.0, 9.0, 9.0), 4.0)], [(1, (1.0, 1.0, 1.0))])
    assert knn_regress(t, q, ["a", "b", "c"], "y", "id").first()["prediction"] == 3.0
    assert knn_regress(t.limit(0), q, ["a", "b", "c"], "y", "id").first()["prediction"] is None


def even_tree(levels, wide):
    """A tree that halves the unit box along one feature after the other, with its boxes."""
    tree, boxes, open_ = K.Tree(), {0: (np.zeros(wide), np.ones(wide))}, [0]
    for level in range(levels):
        f, grown = level % wide, []
        for node in open_:
            low, high = boxes.pop(node)
            middle = (low[f] + high[f]) / 2
            tree.split(node, f, [middle])
            for child, edge in ((tree.left[node], high), (tree.right[node], low)):
                part = [low.copy(), high.copy()]
                part[1 if edge is high else 0][f] = middle
                boxes[child] = tuple(part)
                grown.append(child)
        open_ = grown
    rows = [
        {"_tile": t, "_n": 8, **{f"_lo{i}": low[i] for i in range(wide)}, **{f"_hi{i}": high[i] for i in range(wide)}}
        for t, (low, high) in boxes.items()
    ]
    return tree, rows


def test_nodes_visited_stay_near_constant():
    points = np.random.default_rng(1).uniform(0, 1, (500, 2))
    visits = []
    for levels in (10, 17):
        tree, rows = even_tree(levels, 2)
        boxes = K.Boxes(tree, rows, ["a", "b"], 5)
        reach = np.full(500, 0.5 / 2**levels)  # the area of half a tile
        _, found, visited = boxes.tiles(points, reach, boxes._home(points), False)
        visits.append((visited / 500, len(found) / 500))
    assert visits[1][0] < 2.2 * visits[0][0] and visits[1][0] < 100
    assert visits[1][1] < 1.5 * visits[0][1] + 1


def test_only_near_tiles_are_searched():
    tree = K.Tree()
    tree.split(0, 0, [1.0, 11.0])
    order = K._walk(tree.frame(), np.array([[0.5], [10.5], [20.5]]))
    where = dict(zip(order.tolist(), (0.0, 10.0, 20.0)))
    boxes = K.Boxes(tree, [{"_tile": t, "_n": 8, "_lo0": lo, "_hi0": lo + 1} for t, lo in where.items()], ["a"], 8)
    home = pd.concat(boxes.home(iter([pd.DataFrame({"a": [0.5, 20.5, 4.0]})])))
    assert dict(zip(home["a"], home["_tile"].map(where))) == {0.5: 0.0, 20.5: 20.0, 4.0: 10.0}
    asked = pd.DataFrame({"a": [0.5, 20.5, 4.0, 4.0], "_reach": [1.0, 100.0, None, 16.0]})
    others = pd.concat(boxes.others(iter([asked])))
    assert sorted(zip(others["a"], others["_tile"].map(where))) == [(4.0, 0.0), (4.0, 0.0), (4.0, 20.0), (20.5, 10.0)]
