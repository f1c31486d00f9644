from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridcast.operators import frames as W
from gridcast.operators.forecast import latest_state, recursive_linear, recursive_model
from gridcast.operators.grid import calendar_ordinal
from gridcast.operators.models import linear, xy_split
from gridcast.operators.sampling import hash_fold, sample_series, shuffle_batches
from gridcast.plans.many_series import forecast_many, segment_values

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
T0 = datetime(2024, 1, 1)


def series(frame, lengths, missing=()):
    rows = [
        (s, (T0 + i * HOUR).isoformat(sep=" "), None if (s, i) in missing else float(i), float(i * i))
        for s, n in lengths.items()
        for i in range(n)
    ]
    return frame(rows, "series_id string, ts ntz, x double, y double").repartition(3)


def brute(n, history, target, stride, single):
    out = {}
    for i in range(history, n - target):
        past = [(float(j), float(j * j)) for j in range(i - history, i, stride)]
        out[i] = past, (float((i + target) ** 2) if single else [float(j * j) for j in range(i, i + target)])
    return out


@pytest.mark.parametrize(
    "history,target,stride,single,chunk", [(6, 3, 2, False, 1), (6, 3, 2, False, 4096), (5, 2, 3, True, 1), (4, 1, 4, False, 1)]
)
def test_frames_equal_brute_force(frame, history, target, stride, single, chunk):
    df = series(frame, {"a": 150, "b": history + target, "c": history + target + 1})
    cut = W.sliding_frames(df, ["x", "y"], "y", history, target, HOUR, stride, single, chunk=chunk)
    got = {"a": {}, "b": {}, "c": {}}
    for r in cut.collect():
        at = (r["ts"] - T0) // HOUR
        got[r["series_id"]][at] = [tuple(s) for s in r["history"]], r["label" if single else "labels"]
    assert got["a"] == brute(150, history, target, stride, single)
    assert len(got["b"]) == 0 and len(got["c"]) == 1


def test_frames_keep_missing_labels(frame):
    cut = W.sliding_frames(series(frame, {"a": 6}, {("a", 3)}), ["y"], "x", 2, 2, HOUR)
    assert {(r["ts"] - T0) // HOUR: r["labels"] for r in cut.collect()} == {2: [2.0, None], 3: [None, 4.0]}


def test_anchors_of_a_split(frame):
    cut = W.sliding_frames(series(frame, {"a": 40}), ["x"], "y", 4, 2, HOUR)
    train = W.anchors_between(cut, 4, HOUR, end="2024-01-01 20:00:00")
    rest = W.anchors_between(cut, 4, HOUR, start="2024-01-01 20:00:00")
    assert sorted((r["ts"] - T0) // HOUR for r in train.collect()) == list(range(4, 20))
    assert sorted((r["ts"] - T0) // HOUR for r in rest.collect()) == list(range(24, 38))


def test_random_windows(frame):
    df = calendar_ordinal(series(frame, {"a": 50, "b": 20}), HOUR, "2024-01-01 00:00:00")
    limits = df.groupBy("series_id").agg(F.count("*").alias("n"))
    starts = W.window_starts(limits, 2, 5, 10, seed=1)
    drawn = {(r["series_id"], r["batch"], r["sample"]): r["start"] for r in starts.collect()}
    assert len(drawn) == 20
    assert all(0 <= v < (40 if s == "a" else 10) for (s, _, _), v in drawn.items())
    for r in W.random_windows(df, starts, 10, ["x"]).collect():
        first = drawn[r["series_id"], r["batch"], r["sample"]]
        assert [s["x"] for s in r["steps"]] == [float(i) for i in range(first, first + 10)]


def test_series_too_short_for_a_window(frame):
    limits = series(frame, {"a": 10}).groupBy("series_id").agg(F.count("*").alias("n"))
    assert W.window_starts(limits, 1, 3, 10, seed=1).count() == 0


def test_batches_are_full_and_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    one = {r["key"]: (r["batch"], r["slot"]) for r in shuffle_batches(df.repartition(1), 64, ["key"]).collect()}
    many = {r["key"]: (r["batch"], r["slot"]) for r in shuffle_batches(df.repartition(13), 64, ["key"]).collect()}
    assert one == many and len(set(one.values())) == 1000
    sizes = [sum(b == i for b, _ in one.values()) for i in range(16)]
    assert sizes == [64] * 15 + [40]
    other = {r["key"]: (r["batch"], r["slot"]) for r in shuffle_batches(df, 64, ["key"], seed=7).collect()}
    assert other != one


def test_folds_and_samples_repeat(spark):
    df = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 30).alias("series_id"), "id")
    folds = hash_fold(df, 10, ["id"]).groupBy("fold").count().collect()
    assert len(folds) == 10
    a, b = (sample_series(df.repartition(p), 4) for p in (1, 9))
    assert {r["series_id"] for r in a.collect()} == {r["series_id"] for r in b.collect()}
    assert a.count() == 40


def test_recursion_with_weights_and_with_a_model(frame):
    df = series(frame, {"a": 30, "b": 2})
    state = latest_state(df, "x", 3, HOUR)
    assert {r["series_id"]: r["state"] for r in state.collect()} == {"a": [27, 28, 29], "b": [0, 0, 1]}
    ahead = recursive_linear(state, [1, 2], [2.0, -1.0], 0.0, 12, HOUR)
    got = {(r["series_id"], r["step"]): (r["ts"], r["prediction"]) for r in ahead.collect()}
    assert got["a", 12] == (datetime(2024, 1, 2, 17), 41.0) and len(got) == 24

    lagged = df.where("series_id = 'a'").withColumns({"l1": F.col("x") - 1, "l2": (F.col("x") * 7) % 5})
    model = linear().fit(xy_split(lagged, ["l1", "l2"], "x"))
    features = lambda now: xy_split(
        now.withColumns({"l1": F.element_at("state", -1), "l2": F.element_at("state", -2)}), ["l1", "l2"], None, ["series_id", "last_ts", "state"]
    )
    stepped = recursive_model(state, model, features, 12, HOUR, cut_every=5)
    direct = recursive_linear(state, [1, 2], model.coefficients, model.intercept, 12, HOUR)
    want = {(r["series_id"], r["step"], r["ts"]): r["prediction"] for r in direct.collect()}
    assert {(r["series_id"], r["step"], r["ts"]): r["prediction"] for r in stepped.collect()} == pytest.approx(want)


def test_segments_and_many_series(frame):
    rows = [
        (s, (T0 + i * DAY).isoformat(sep=" "), None if i == 3 else float(10 + i % 7 * k))
        for k, s in enumerate("abcd", 1)
        for i in range(42)
    ]
    daily = frame(rows, "series_id string, ts ntz, value double").withColumn("ts", F.to_date("ts"))
    sizes = {r["segment"]: r["n_days"] for r in W.segment_table(daily, 7).collect()}
    assert sizes == {"train_history": 28, "train_target": 7, "val_history": 28, "val_target": 7}
    encoded = segment_values(daily, 7)
    means = encoded.where(F.col("segment").endswith("_history")).groupBy("series_id", "part").agg(F.avg("scaled").alias("m"))
    assert all(abs(r["m"]) < 1e-9 for r in means.collect())
    _, scored, errors = forecast_many(daily, 7, [7])
    assert scored.count() == 28 and scored.where("truth is null").count() == 0
    assert errors.first()["mae"] < 0.5
