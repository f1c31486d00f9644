import pytest
from pyspark.sql import functions as F

from gridcast.functions import timecols as T
from gridcast.functions import values as V
from gridcast.operators import columns as C
from gridcast.operators.align import align_full, unique_by


def test_clip_keeps_missing_and_fill_takes_nan(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (None,), (float("nan"),)], "x double")
    clipped = [r["x"] for r in C.clip_negatives(df, ["x"]).collect()]
    assert clipped[:3] == [0.0, 0.5, None] and clipped[3] != clipped[3]
    assert [r["x"] for r in C.fill_missing(df, ["x"]).collect()] == [-1.0, 0.5, 0.0, 0.0]
    assert [r["x"] for r in C.keep_positive(df, "x").collect()] == [0.5]


def test_threshold(spark):
    df = spark.createDataFrame([(-1.0,), (0.0099,), (0.01,), (2.0,)], "x double")
    assert [r["x"] for r in C.threshold_to_zero(df, ["x"]).collect()] == [0.0, 0.0, 0.01, 2.0]


def test_cast_cuts_toward_zero(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,)], "x double")
    assert [r["x"] for r in C.cast_columns(df, {"x": "int"}).collect()] == [1, -1]


@pytest.mark.parametrize("closed,left", [("neither", 1), ("left", 0)])
def test_holdout_start_row(frame, closed, left):
    rows = [(f"2020-01-31 {h:02d}:{m:02d}:00",) for h in range(24) for m in (0, 15, 30, 45)] + [("2020-02-01 00:00:00",)]
    kept = C.drop_holdout(frame(rows, "ts ntz"), [("2020-01-31 00:00:00", "2020-02-01 00:00:00")], closed=closed)
    assert kept.count() == left + 1


def test_slice_of_seven_days_has_both_ends(frame):
    rows = [(f"2020-05-{d} {h:02d}:{m:02d}:00",) for d in range(23, 32) for h in range(24) for m in (0, 15, 30, 45)]
    df = frame(rows, "ts ntz")
    assert C.slice_inclusive(df, "2020-05-24 00:00:00", "2020-05-31 00:00:00").count() == 7 * 96 + 1
    assert C.slice_inclusive(df, "2020-05-24", "2020-05-31").count() == 8 * 96


def test_year_wrap(frame):
    df = frame([("2019-12-31 18:00:00",), ("2020-01-01 00:00:00",), ("2020-01-01 06:00:00",)], "ts ntz")
    days = [r[0] for r in df.select(T.wrap_year(T.days_since("ts", "2019-01-01 00:00:00"))).collect()]
    assert days == [364.75, 365.0, 0.25]


def test_offset_time_keeps_wall_clock(spark):
    df = spark.createDataFrame([("2019-07-01T00:15:00+09:00",)], "t string")
    assert df.select(T.parse_offset_time("t").alias("t")).first()["t"].isoformat() == "2019-07-01T00:15:00"


def test_text_that_is_no_time(spark):
    df = spark.createDataFrame([("2019-07-01 00:15",), ("no",)], "t string")
    assert [str(r[0]) for r in df.select(T.parse_time("t")).collect()] == ["2019-07-01 00:15:00", "None"]


def test_micros_round_trip(frame):
    df = frame([("1931-05-06 07:08:09.123456",), ("2099-12-31 23:59:59.999999",)], "ts ntz")
    assert df.where(T.at_micros(T.micros("ts")) == F.col("ts")).count() == 2
    assert df.where(T.at_micros(T.micros(F.col("ts"))) == F.col("ts")).count() == 2


def test_wrong_names_fail(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="no such columns"):
        C.drop_columns(df, ["a", "zz"])
    with pytest.raises(ValueError, match="names for"):
        C.rename_by_position(df, ["a"])


def test_unpivot_and_pivot_are_inverse(spark):
    wide = spark.createDataFrame([("p", 1.0, None), ("q", 0.0, 4.0)], "Page string, `2015-07-01` double, `2015-07-02` double")
    long = C.unpivot(wide, "Page")
    assert long.count() == 4 and long.where("value is null").count() == 1
    back = C.pivot(long.withColumn("ts", F.col("ts").cast("string")), "Page", ["2015-07-01", "2015-07-02"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_duplicate_keys_fail_in_alignment(frame):
    a = frame([("s", "2024-01-01", 1.0), ("s", "2024-01-01", 2.0)], "series_id string, ts ntz, x double")
    b = frame([("s", "2024-01-01", 3.0), ("s", "2024-01-02", 4.0)], "series_id string, ts ntz, y double")
    with pytest.raises(Exception, match="duplicate key"):
        align_full(a, b).collect()
    joined = align_full(a.limit(1), b)
    assert joined.count() == 2 and joined.where("x is null").count() == 1
    assert unique_by(b, ["series_id", "ts"]).count() == 2


def test_repeat_rows(frame):
    from datetime import timedelta

    df = frame([("2024-01-01 03:00:00", 7.0)], "ts ntz, x double")
    got = [(r["ts"].hour, r["x"]) for r in C.repeat_rows(df, 3, timedelta(hours=1)).orderBy("ts").collect()]
    assert got == [(3, 7.0), (4, 7.0), (5, 7.0)]


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], [9.0, 8.0])], "h array<double>, t array<double>")
    row = df.select(
        V.teacher_forced("h", "t").alias("fed"),
        V.tail("h", 2).alias("tail"),
        V.tail("t", 9).alias("short"),
        V.relative_steps(F.size("t")).alias("steps"),
        V.relative_steps(0).alias("none"),
        V.reshape("h", 2).alias("blocks"),
        V.row_rmse(F.slice("h", 1, 2), "t").alias("rmse"),
    ).first()
    assert row["fed"] == [1, 2, 3, 4, 5, 9]
    assert row["tail"] == [4, 5] and row["short"] == [9, 8]
    assert row["steps"] == [-2, -1] and row["none"] == []
    assert row["blocks"] == [[1, 2], [3, 4], [5]]
    assert row["rmse"] == pytest.approx(50**0.5)
