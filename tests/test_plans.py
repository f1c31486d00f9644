from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gridcast.operators import rank
from gridcast.operators.analog import analog_day, day_distances, in_season
from gridcast.plans.analog_features import analog_day_rows, forecast_features
from gridcast.plans.dataset import sensor_grid
from gridcast.plans.training import prepare, train_and_score
from gridcast.queries import QUERIES
from gridcast.session import release, stored
from gridcast.sources.landing import hourly_profile

FEATURES = ["temperature", "precipitation"]


def hours(day, shift, skip=()):
    start = datetime.fromisoformat(day)
    return [
        ((start + timedelta(hours=h)).isoformat(sep=" "), 20.0 + h + shift, None if h % 2 else 0.0)
        for h in range(24)
        if h not in skip
    ]


def test_analog_day_over_years(spark, frame):
    rows = (
        hours("2017-08-03", 0.5) + hours("2018-08-03", -0.5) + hours("2019-07-30", 0.1, skip=[5]) + hours("2019-06-01", 0.0)
    )
    past = frame(rows, "ts ntz, temperature double, precipitation double").where(in_season("ts", (7, 24), (8, 8)))
    target = hourly_profile(spark, {"temperature": [20.0 + h for h in range(24)], "precipitation": [0.0]})
    d = {str(r["day"]): r["mse"] for r in day_distances(past, target, FEATURES).collect()}
    assert d == pytest.approx({"2017-08-03": (0.5 / 23) ** 2 / 2, "2018-08-03": (0.5 / 23) ** 2 / 2})
    exact = spark.createDataFrame([("2018-08-03", 0.25), ("2017-08-03", 0.25)], "day string, mse double")
    assert analog_day(exact).first()["day"] == "2017-08-03"  # the first of equals


def test_distance_to_an_unscaled_target(spark, frame):
    past = frame(hours("2017-08-03", 0.0), "ts ntz, temperature double, precipitation double")
    target = hourly_profile(spark, {"temperature": [20.0 + h for h in range(24)], "precipitation": [0.0]})
    want = sum((h / 23 - (20 + h)) ** 2 for h in range(24)) / 24 / 2
    got = day_distances(past, target, FEATURES, scale_target=False).first()["mse"]
    assert got == pytest.approx(want)


def test_features_of_a_day(frame):
    rows = [
        ("s", "2017-08-02 23:59:00", 9.0, 9.0),
        ("s", "2017-08-03 00:00:00", 10.0, 5.0),
        ("s", "2017-08-03 00:10:00", None, 7.0),
        ("s", "2017-08-03 00:20:00", 4.0, 2.0),
        ("s", "2017-08-03 00:45:00", 8.0, None),
        ("s", "2017-08-03 00:50:00", 8.0, 30.0),
    ]
    df = frame(rows, "series_id string, ts ntz, t double, sun double")
    winner = frame([("s", "2017-08-03")], "series_id string, ts ntz").select("series_id", F.to_date("ts").alias("day"))
    day = analog_day_rows(df, winner, ["series_id"])
    got = forecast_features(day, ["t"], ["sun"], date=31, month=7).orderBy("ts").collect()
    assert [r["t"] for r in got] == [5.0, 4.0, 0.0, 8.0]
    assert [r["sun"] for r in got] == [0.0, 0.0, 0.0, 0.0]  # down, then from an empty bucket
    assert [r["difference"] for r in got] == [214.0, 0.0, 0.0, 214.03125]
    assert {(r["result"], r["date"], r["month"], r["hour"]) for r in got} == {(0.0, 31, 7, 0)}


def test_steps_start_anew_in_each_file(frame):
    rows = [("s", "a.csv", "2020-01-31 23:45:00", 1.0), ("s", "b.csv", "2020-02-01 00:00:00", 5.0), ("s", "b.csv", "2020-02-01 00:15:00", 6.0)]
    df = frame(rows, "series_id string, source_file string, ts ntz, rain double")
    steps = lambda **o: [r["rain"] for r in sensor_grid(df, ["rain"], ["rain"], **o).orderBy("ts").collect()]
    assert steps(per_source=True) == [None, None, 1.0]
    assert steps() == [None, 4.0, 1.0]


def test_training_and_scoring(frame):
    start = datetime(2020, 1, 1)
    rows = [
        ("s", (start + timedelta(minutes=15 * i)).isoformat(sep=" "), float(3 * (i % 7)), float(i % 7), -1.0, i / 96 + 0.5)
        for i in range(96 * 12)
    ]
    data = frame(rows, "series_id string, ts ntz, result double, x double, sun double, difference double")
    ready = prepare(data, ["x", "sun", "difference"], clipped=["sun"])
    first = ready.orderBy("ts").first()
    assert (first["sun"], first["difference"]) == (0.0, 0.0)
    holdouts = [("2020-01-05 00:00:00", "2020-01-06 00:00:00")]
    model, predicted, errors = train_and_score(
        ready, ["x", "sun", "difference"], holdouts, GBTRegressor(maxIter=3, maxDepth=4, seed=1), capacity=100
    )
    r = errors.first()
    assert predicted.count() == 97 and r["n"] == 97
    assert r["rmse"] < 1.0 and r["capacity_error"] == pytest.approx(r["mse"] / 100)
    assert {p["truth"] for p in predicted.collect()} == {3.0 * i for i in range(7)}


@pytest.mark.parametrize(
    "name",
    ["resample_diff", "grid_lead", "dataset_build", "sliding_frames", "chrono_split", "row_ordinal", "random_windows",
     "minmax_scale", "log_demean", "day_distances", "many_series_encode", "corr_long", "join_daily_to_fine"],
)
def test_plan_has_no_pairing_of_all_rows(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert all("], [" in line for line in windows)  # each has partition columns


def test_scratch_tables_are_deleted(spark):
    rows = stored(spark.range(5).toDF("x"), "some")
    place = Path(rows.inputFiles()[0].removeprefix("file://")).parent
    assert rows.count() == 5 and place.exists()
    release(spark)
    assert not place.exists()


def test_rows_of_all_months_reach_the_wide_table(spark, tmp_path):
    """Days come from the data: none of them is dropped by a list."""
    days = ["2023-11-30", "2024-01-15", "2024-03-02"]
    rows = [(i, f"{d} 10:00:00", i % 3, "a", float(i), "{}") for i, d in enumerate(days * 4)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", events.ts.cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    out = QUERIES["unpivot_long"](spark, str(tmp_path))
    assert out.agg({"value": "sum"}).first()[0] == sum(r[4] for r in rows)
    assert out.count() == 3 * 94


def test_offsets_of_ordinals_are_counts_of_days(spark, frame):
    rows = [("a", f"2024-01-{d:02d} {h:02d}:00:00", d * 100 + h) for d in range(1, 9) for h in range(24)]
    df = frame(rows, "series_id string, ts ntz, id long")
    seen, real = [], rank.attach
    rank.attach = lambda left, small, *a, **k: seen.append(k["known_rows"]) or real(left, small, *a, **k)
    try:
        out = rank.row_ordinal(df, tie="id").collect()
    finally:
        rank.attach = real
    assert seen == [8] and sorted(r["ordinal"] for r in out) == list(range(1, 193))
