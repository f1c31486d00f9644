"""Models from sums of products against numpy on the rows; search and epochs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.operators import epochs
from gridcast.operators import models as M
from gridcast.operators.gram import Penalised, cross_validate_linear, gram_matrices, mean_squares, slopes, solve
from gridcast.operators.search import Choice, Steps, draw_trials, linear_search, random_search
from gridcast.plans.direct import direct_forecast_all_steps, with_all_steps


def drawn(spark, n=400, offset=0.0, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3)) @ np.array([[1.0, 0.4, 0], [0, 2, 0.3], [0, 0, 0.5]]) + offset
    y = x @ [1.5, -0.7, 0.0] + draw.normal(size=n) + 3
    fold = draw.integers(0, 5, n)
    rows = [(i, *map(float, r), float(v), int(k)) for i, (r, v, k) in enumerate(zip(x, y, fold))]
    return x, y, fold, spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int")


def plain_fit(x, y, model, sweeps=3000):
    mean, std = x.mean(0), x.std(0)
    z = (x - mean) / std
    if not model.alpha:
        w = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    else:
        w = np.zeros(x.shape[1])
        for _ in range(sweeps):
            for j in range(len(w)):
                rest = y - y.mean() - z @ w + z[:, j] * w[j]
                c = (z[:, j] * rest).mean()
                w[j] = np.sign(c) * max(abs(c) - model.alpha * model.ratio, 0) / ((z[:, j] ** 2).mean() + model.alpha * (1 - model.ratio))
    w = w / std
    return y.mean() - mean @ w, w


MODELS = {"linear": Penalised(), "ridge": Penalised(0.5, 0.0), "lasso": Penalised(0.3, 1.0), "net": Penalised(0.4, 0.5), "zero": Penalised(1e6, 1.0)}


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_folds_equal_fits_on_the_rows(spark, offset):
    x, y, fold, rows = drawn(spark, offset=offset)
    got = {(r.model, r.fold): r for r in cross_validate_linear(rows.repartition(3), MODELS, ["a", "b", "c"], "y", "fold", 5).collect()}
    assert len(got) == len(MODELS) * 5
    for name, model in MODELS.items():
        for k in range(5):
            b, w = plain_fit(x[fold != k], y[fold != k], model, 300)
            rest = y[fold == k] - b - x[fold == k] @ w
            r = got[name, k]
            assert r.n == (fold == k).sum() and r.mse == pytest.approx((rest**2).mean(), rel=1e-5) and r.mae == pytest.approx(abs(rest).mean(), rel=1e-5)
            assert r.r2 == pytest.approx(1 - (rest**2).mean() / y[fold == k].var(), rel=1e-4, abs=1e-6)


def test_agrees_with_spark_ml(spark):
    _, _, _, rows = drawn(spark)
    ml = {"linear": M.linear(), "lasso": M.lasso(0.3, tol=1e-12), "net": M.elastic_net(0.4, 0.5, tol=1e-12)}
    want = {(r.model, r.fold): r.mse for r in M.cross_validate(rows, ml, ["a", "b", "c"], "y", folds=5).collect()}
    got = {(r.model, r.fold): r.mse for r in cross_validate_linear(rows, {k: MODELS[k] for k in ml}, ["a", "b", "c"], "y", folds=5).collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], rel=1e-4) for k in want)


def test_missing_values_and_dependent_features(spark):
    x, y, _, rows = drawn(spark)
    gaps = rows.withColumn("b", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("b")))
    gaps = gaps.withColumns({"flat": F.lit(4.0), "twice": F.col("a") * 2})
    gram = gram_matrices(gaps, ["a", "b", "flat", "twice", "y"], [])[()]
    kept = np.array([i % 5 != 0 and i % 7 != 0 for i in range(len(y))])
    assert gram.n == kept.sum()
    np.testing.assert_allclose(gram.means[:2], x[kept][:, :2].mean(0))
    w = solve(gram, ["a", "b", "flat", "twice"], ["y"], Penalised())
    b, plain = plain_fit(x[kept][:, :2], y[kept], Penalised())
    assert w[1, 0] + 2 * w[4, 0] == pytest.approx(plain[0]) and w[2, 0] == pytest.approx(plain[1]) and w[3, 0] == 0
    assert mean_squares(gram, ["a", "b", "flat", "twice"], ["y"], w)[0] == pytest.approx(((y[kept] - b - x[kept][:, :2] @ plain) ** 2).mean())
    assert gram_matrices(gaps.limit(0), ["a", "y"], ["fold"]) == {}
    assert cross_validate_linear(gaps.limit(0), MODELS, ["a"], "y").count() == 0


def test_lasso_meets_its_conditions():
    draw = np.random.default_rng(3)
    z = draw.normal(size=(50, 6))
    q, c = z.T @ z / 50, draw.normal(size=6)
    w = slopes(q, c, Penalised(0.3, 1.0))
    slack = c - q @ w
    assert np.all(abs(slack) <= 0.3 + 1e-9) and np.allclose(slack[w != 0], 0.3 * np.sign(w[w != 0])) and (w == 0).any()


def test_all_steps_are_fitted_in_one_pass(spark):
    draw = np.random.default_rng(4)
    series = draw.normal(size=260).cumsum()
    rows = [(i < 180, [(float(v),) for v in series[i : i + 5]], [float(v) for v in series[i + 5 : i + 17]]) for i in range(240)]
    frames = spark.createDataFrame(rows, "is_train boolean, history array<struct<v:double>>, labels array<double>")
    weights, errors = direct_forecast_all_steps(frames, "v", [1, 3], 12, "is_train")
    x = np.array([[1, r[1][-1][0], r[1][-3][0]] for r in rows])
    y = np.array([r[2] for r in rows])
    want = np.linalg.lstsq(x[:180], y[:180], rcond=None)[0]
    np.testing.assert_allclose(weights, want, rtol=1e-6, atol=1e-8)
    got = errors.orderBy("step").collect()
    assert [r.n for r in got] == [60] * 12
    np.testing.assert_allclose([r.mse for r in got], ((y - x @ want)[180:] ** 2).mean(0))
    predicted = [r.predictions for r in with_all_steps(frames, "v", [1, 3], weights).collect()]
    np.testing.assert_allclose(predicted, x @ want, rtol=1e-6, atol=1e-8)
    with pytest.raises(ValueError):
        direct_forecast_all_steps(frames.where("NOT is_train"), "v", [1], 12, "is_train")


def test_trials_are_drawn_once_and_again_the_same():
    space = {"units": Steps(100, 400, 50), "activation": Choice(("relu", "tanh"))}
    trials = draw_trials(space, 9, seed=2)
    assert trials == draw_trials(space, 9, seed=2) and trials != draw_trials(space, 9, seed=3)
    assert len({tuple(t.values()) for t in trials}) == 9 and all(t["units"] in range(100, 401, 50) for t in trials)
    assert len(draw_trials(space, 99)) == 14
    counts = Counter(draw_trials({"a": Steps(0, 9, 1)}, 1, seed=s)[0]["a"] for s in range(2000))
    assert set(counts) == set(range(10)) and max(counts.values()) < 260


def test_executions_are_averaged():
    found = random_search([{"x": 1}, {"x": 3}, {"x": 3.0}], lambda t, e: t["x"] * (-1.0) + e, executions=3)
    assert [(r["trial"], r["error"], r["is_best"]) for r in found] == [(0, 0.0, False), (1, -2.0, True), (2, -2.0, False)]


def test_linear_search_equals_fits_on_the_rows(spark):
    x, y, _, rows = drawn(spark)
    trials = [{"alpha": 0.5}, {"alpha": 0.0, "features": "a,c"}, {"alpha": 0.2, "ratio": 1.0}]
    got = linear_search(rows, trials, {c: c for c in "abc"}, "y", ["id"], executions=2)
    from gridcast.functions.values import hash_unit

    errors = []
    for e in range(2):
        aside = np.array([r[0] for r in rows.orderBy("id").select(hash_unit(["id"], 7 + e) < 0.2).collect()])
        for trial in trials:
            use = ["abc".index(c) for c in trial.get("features", "a,b,c").split(",")]
            b, w = plain_fit(x[~aside][:, use], y[~aside], Penalised(trial["alpha"], trial.get("ratio", 0.0)), 300)
            errors.append(((y[aside] - b - x[aside][:, use] @ w) ** 2).mean())
    want = [(errors[i] + errors[i + 3]) / 2 for i in range(3)]
    assert [r["error"] for r in got] == pytest.approx(want) and [r["is_best"] for r in got] == [w == min(want) for w in want]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_an_epoch_is_a_permutation(n):
    seen = [epochs.permuted(np.arange(n), n, epochs.epoch_keys(9, e)) for e in range(4)]
    assert all(sorted(s.tolist()) == list(range(n)) for s in seen)
    if n >= 64:
        assert len({tuple(s.tolist()) for s in seen}) == 4
        assert abs(np.corrcoef(seen[0], seen[1])[0, 1]) < 0.3 and abs(np.corrcoef(np.arange(n), seen[0])[0, 1]) < 0.3


def test_epochs_of_a_table(spark):
    rows = spark.range(500).withColumnRenamed("id", "number").withColumn("x", F.col("number") * 2)
    made = epochs.shuffled_epochs(rows.repartition(7), 500, 64, 3)
    assert made.columns == ["number", "x", "epoch", "batch", "slot"]
    assert "Exchange" not in epochs.shuffled_epochs(spark.range(500), 500, 64, 3, "id")._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    for e in range(3):
        places = sorted((r.batch, r.slot) for r in got if r.epoch == e)
        assert places == [(i // 64, i % 64) for i in range(500)] and sorted(r.number for r in got if r.epoch == e) == list(range(500))
    again = {(r.number, r.epoch): (r.batch, r.slot) for r in epochs.shuffled_epochs(rows, 500, 64, 3).collect()}
    assert again == {(r.number, r.epoch): (r.batch, r.slot) for r in got}
    assert epochs.shuffled_epochs(rows.limit(0), 0, 64, 2).count() == 0


def test_a_fitted_model_predicts_from_columns_and_vectors(spark):
    x, y, _, rows = drawn(spark)
    model = Penalised(0.2, 0.0).fit(rows, ["a", "b", "c"], "y")
    b, w = plain_fit(x, y, Penalised(0.2, 0.0), 300)
    want = b + x @ w
    np.testing.assert_allclose([r.prediction for r in model.transform(rows).orderBy("id").collect()], want)
    vectors = M.xy_split(rows, ["a", "b", "c"], None, ["id", "b"])
    np.testing.assert_allclose([r.prediction for r in model.transform(vectors).orderBy("id").collect()], want)
    with pytest.raises(ValueError):
        Penalised().fit(rows.limit(0), ["a"], "y")
