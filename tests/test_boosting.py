"""Boosting against plain numpy, its stop, and trees inside a recursion."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.operators import boosting
from gridcast.operators.boosting import Boosting, Split, tree_value
from gridcast.operators.forecast import recursive_trees


def plain_tree(x, r, cuts, depth):
    """Leaf means by the same rule: least squared error, first feature and cut of equals."""
    best, found = 0.0, None
    if depth:
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left = x[:, f] <= c
                if 0 < left.sum() < len(r):
                    gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
                    if gain > best * (1 + 1e-9) and gain > 1e-12:
                        best, found = gain, (f, c, left)
    if found is None:
        return r.mean()
    f, c, left = found
    return f, c, plain_tree(x[left], r[left], cuts, depth - 1), plain_tree(x[~left], r[~left], cuts, depth - 1)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_boost(x, y, valid, settings):
    cuts = [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in (sorted(set(x[~valid, f])) for f in range(x.shape[1]))]
    margin = np.full(len(y), y[~valid].mean())
    step, best, best_at, waited, errors = settings.step, None, -1, 0, []
    at_best = margin
    for i in range(settings.rounds):
        tree = plain_tree(x[~valid], (y - margin)[~valid], cuts, settings.depth)
        if not isinstance(tree, tuple):
            break
        margin = margin + step * np.array([plain_value(tree, row) for row in x])
        error = ((y - margin)[valid] ** 2).mean()
        errors.append((step, error))
        if best is None or error < best:
            best, best_at, waited, at_best = error, i, 0, margin
            continue
        waited += 1
        if i - best_at >= settings.patience:
            break
        if waited >= settings.plateau:
            step, waited = max(step * settings.factor, settings.least_step), 0
    return errors, best_at + 1, at_best


def drawn(spark, n=300, seed=0):
    draw = np.random.default_rng(seed)
    x = np.stack([draw.integers(0, 12, n), draw.integers(0, 5, n), draw.integers(0, 2, n)], axis=1).astype(float)
    y = np.sin(x[:, 0]) * 3 + x[:, 1] * x[:, 2] + draw.normal(size=n)
    valid = draw.random(n) < 0.3
    rows = [(i, *map(float, r), float(v), bool(t)) for i, (r, v, t) in enumerate(zip(x, y, valid))]
    return x, y, valid, spark.createDataFrame(rows, "id long, a double, b double, c double, y double, valid boolean")


@pytest.mark.parametrize("settings", [
    Boosting(rounds=25, depth=2, step=0.8, patience=3, plateau=1), Boosting(rounds=6, depth=3, step=0.5, patience=30, plateau=2),
    Boosting(rounds=15, depth=1, step=1.0, patience=2, plateau=5),
], ids=["stops", "runs", "stumps"])
def test_equals_plain_boosting(spark, settings):
    x, y, valid, rows = drawn(spark)
    model = settings.fit(rows.repartition(3), ["a", "b", "c"], "y", "valid")
    errors, length, margin = plain_boost(x, y, valid, settings)
    assert [r.step for r in model.rounds] == [s for s, _ in errors]
    np.testing.assert_allclose([r.error for r in model.rounds], [e for _, e in errors])
    assert len(model.trees) == length
    got = [r.prediction for r in model.transform(rows).orderBy("id").collect()]
    np.testing.assert_allclose(got, margin)


def test_nothing_is_fitted_after_the_stop(spark, monkeypatch):
    _, _, _, rows = drawn(spark, seed=5)
    calls, real = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda *a, **k: calls.append(1) or real(*a, **k))
    model = Boosting(rounds=60, depth=3, step=1.0, patience=2, plateau=9).fit(rows, ["a", "b", "c"], "y", "valid")
    assert len(calls) == len(model.rounds) == len(model.trees) + 2 < 60


def test_vector_features_and_missing_values(spark):
    from gridcast.operators.models import xy_split

    _, _, _, rows = drawn(spark)
    gaps = rows.withColumn("a", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("a")))
    model = Boosting(rounds=3, depth=2, step=0.5).fit(gaps, ["a", "b"], "y", "valid")
    named = {r.id: r.prediction for r in model.transform(gaps).collect()}
    assert len(named) == 300
    right = Boosting(rounds=1, depth=1, step=1.0).fit(gaps.where("a IS NULL OR isnan(a) OR a > 5").withColumn("b", F.lit(0.0)), ["a"], "y", "valid")
    assert len(right.trees) <= 1
    filled = rows.withColumn("a", F.coalesce("a", F.lit(0.0)))
    vectors = model.transform(xy_split(filled, ["a", "b"], "y", ["id"]))
    plain = {r.id: r.prediction for r in model.transform(filled).collect()}
    assert {r.id: r.prediction for r in vectors.collect()} == plain


def test_many_values_are_cut_at_quantiles(spark):
    rows = spark.range(5000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("few"), F.lit(1.0).alias("one"))
    cuts = boosting.feature_cuts(rows, ["x", "few", "one"], 16)
    assert len(cuts["x"]) == 15 and np.allclose(np.diff(cuts["x"]), 312.5, atol=10)
    assert cuts["few"] == [0.5, 1.5] and cuts["one"] == []


def test_edge_tables(spark):
    _, _, _, rows = drawn(spark)
    with pytest.raises(ValueError):
        Boosting().fit(rows.limit(0), ["a"], "y", "valid")
    flat = Boosting(rounds=5).fit(rows.withColumn("y", F.lit(2.0)), ["a"], "y", "valid")
    assert flat.trees == () and flat.base == 2.0 and {r.prediction for r in flat.transform(rows).collect()} == {2.0}
    alone = Boosting(rounds=4, depth=1).fit(rows.withColumn("valid", F.lit(False)), ["a"], "y", "valid")
    assert len(alone.trees) == 4 and {r.error for r in alone.rounds} == {None}


def test_trees_inside_the_recursion(spark):
    tree = Split("last", 5.0, Split("hour", 2.5, 7.0, 1.0), Split("last", 8.0, 3.0, 0.5))
    model = boosting.BoostedTrees(("last", "hour"), 1.0, (tree, Split("last", 2.0, 1.5, -0.5)), ())
    start = datetime(2024, 1, 1, 22)
    state = spark.createDataFrame([("a", [4.0, 6.0]), ("b", [1.0, 9.0])], "series_id string, state array<double>")
    state = state.withColumn("last_ts", F.lit(start).cast("timestamp_ntz"))
    made = recursive_trees(state, model, lambda past, ts: {"last": F.element_at(past, -1), "hour": F.hour(ts)}, 6, timedelta(hours=1))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    got = {(r.series_id, r.step): r.prediction for r in made.collect()}

    def branch(t, of):
        while isinstance(t, Split):
            t = t.left if of[t.feature] <= t.cut else t.right
        return t

    for name, last in (("a", 6.0), ("b", 9.0)):
        for i in range(1, 7):
            of = {"last": last, "hour": (start + timedelta(hours=i)).hour}
            last = 1.0 + sum(branch(t, of) for t in model.trees)
            assert got[name, i] == last
    one = spark.range(1).select(tree_value(3.5, F.col).alias("x")).first()
    assert one.x == 3.5
