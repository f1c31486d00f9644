from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from gridcast.operators.grid import block_sum, bucket_sum, grid_diff, grid_lead, grid_shift, resample_mean, spine, time_bounds

QUARTER = timedelta(minutes=15)

GAPPY = [
    ("a", "2024-01-01 00:01:00", 1.0),
    ("a", "2024-01-01 00:14:59.999999", 3.0),
    ("a", "2024-01-01 00:15:00", 5.0),
    ("a", "2024-01-01 01:10:00", None),
    ("a", "2024-01-01 02:00:00", float("nan")),
    ("a", "2024-01-01 02:01:00", 8.0),
    ("a", "2024-01-01 02:20:00", 9.5),
    ("a", "2024-01-01 03:59:00", None),
    ("b", "1969-12-31 23:50:00", 2.0),
    ("b", "1970-01-01 00:20:00", 4.0),
    ("c", "2024-03-05 07:07:07", 1.0),
]


def expected(rows, step, diff=False):
    pdf = pd.DataFrame(rows, columns=["series_id", "ts", "value"])
    pdf["ts"] = pd.to_datetime(pdf["ts"], format="ISO8601")
    out = {}
    for s, g in pdf.groupby("series_id"):
        r = g.set_index("ts")["value"].astype(float).resample(step).mean()
        out.update({(s, t.to_pydatetime()): v for t, v in (r.diff() if diff else r).items()})
    return out


def collected(df, column="value"):
    return {(r["series_id"], r["ts"]): np.nan if r[column] is None else r[column] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-12)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
@pytest.mark.parametrize("partitions", [1, 7])
def test_mean_and_diff_equal_pandas(frame, chunk, partitions):
    df = frame(GAPPY, "series_id string, ts ntz, value double").repartition(partitions)
    grid = resample_mean(df, QUARTER, ["value"], chunk=chunk)
    same(collected(grid), expected(GAPPY, "15min"))
    same(collected(grid_diff(grid, ["value"], QUARTER, chunk=chunk)), expected(GAPPY, "15min", diff=True))


def test_step_that_does_not_divide_a_day_starts_at_midnight(frame):
    df = frame(GAPPY, "series_id string, ts ntz, value double")
    grid = resample_mean(df, timedelta(hours=7), ["value"])
    same(collected(grid), expected(GAPPY, "7h"))


def test_subsecond_step(frame):
    rows = [("a", "2024-01-01 00:00:00.1", 1.0), ("a", "2024-01-01 00:00:00.9", 2.0)]
    grid = resample_mean(frame(rows, "series_id string, ts ntz, value double"), timedelta(milliseconds=250), ["value"])
    same(collected(grid), expected(rows, "250ms"))


def test_no_rows(frame):
    df = frame([], "series_id string, ts ntz, value double")
    assert grid_diff(resample_mean(df, QUARTER, ["value"]), ["value"], QUARTER).count() == 0


def test_result_does_not_depend_on_session_zone(spark, frame):
    df = frame(GAPPY, "series_id string, ts ntz, value double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = [("a", "2024-03-10 01:50:00", 1.0), ("a", "2024-03-10 03:10:00", 2.0)]  # clocks change there
        same(collected(resample_mean(frame(rows, "series_id string, ts ntz, value double"), QUARTER, ["value"])), expected(rows, "15min"))
        same(collected(resample_mean(df, QUARTER, ["value"])), expected(GAPPY, "15min"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_known_bounds_lengthen_the_grid(frame):
    df = frame(GAPPY, "series_id string, ts ntz, value double").where("series_id = 'c'")
    bounds = frame([("c", "2024-03-05")], "series_id string, ts ntz").select(
        "series_id", F.col("ts").alias("first_ts"), F.expr("ts + INTERVAL 23 HOUR 59 MINUTE").alias("last_ts")
    )
    assert resample_mean(df, QUARTER, ["value"], bounds=bounds).count() == 96


def test_spine_is_spread_over_tasks(frame):
    rows = [("a", "2020-01-01", 0.0), ("a", "2021-01-01", 0.0)]
    grid = spine(time_bounds(frame(rows, "series_id string, ts ntz, value double")), QUARTER, chunk=1000)
    assert grid.count() == 366 * 96 + 1
    assert grid.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("chunk", [1, 2, 5, 4096])
def test_shift_by_several_steps_over_chunk_edges(frame, chunk):
    rows = [("a", f"2024-01-01 {h:02d}:00:00", float(h)) for h in range(24) if h != 7]
    df = frame(rows, "series_id string, ts ntz, value double")
    moved = grid_shift(df, {"back": ("value", -3), "ahead": ("value", 5)}, timedelta(hours=1), chunk=chunk)
    for r in moved.collect():
        h = int(r["value"])
        assert r["back"] == (h - 3 if h - 3 >= 0 and h - 3 != 7 else None)
        assert r["ahead"] == (h + 5 if h + 5 < 24 and h + 5 != 7 else None)


def test_lead_cuts_the_tail_but_keeps_missing_values(frame):
    rows = [("a", f"2024-01-01 0{h}:00:00", None if h == 3 else float(h)) for h in range(5)]
    ahead = grid_lead(frame(rows, "series_id string, ts ntz, value double"), ["value"], 2, timedelta(hours=1))
    assert {r["ts"].hour: r["value_ahead"] for r in ahead.collect()} == {0: 2.0, 1: None, 2: 4.0}


def test_sum_of_hours_is_sum_of_quarters(frame):
    df = frame([r for r in GAPPY if r[2] == r[2]], "series_id string, ts ntz, value double")
    total = df.agg(F.sum("value")).first()[0]
    for step in (QUARTER, timedelta(hours=1)):
        assert bucket_sum(df, step, ["value"]).agg(F.sum("value")).first()[0] == total


def test_incomplete_block_is_an_error(spark):
    lines = spark.createDataFrame([(i, 1.0) for i in range(1, 8)], "pos long, value double")
    with pytest.raises(SparkRuntimeException, match="block 1 has 3 rows"):
        block_sum(lines, "value", 4).collect()
    assert {r["block"]: r["value"] for r in block_sum(lines, "value", 4, strict=False).collect()} == {0: 4.0, 1: 3.0}
