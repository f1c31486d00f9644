"""Stores and layouts: what they open, what they do not move, and that rows stay the same."""

import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from gridcast.operators.align import align_full, co_located, match_truth, sample_at
from gridcast.operators.columns import slice_inclusive
from gridcast.operators.frame_batches import frame_batches, frame_chunks
from gridcast.operators.frames import sliding_frames
from gridcast.plans.many_series import every_day
from gridcast.session import release
from gridcast.sources import csv as S
from gridcast.sources.days import on_days, read_days, write_days
from gridcast.sources.landing import landed_pages, read_numbered_pages

HOUR = timedelta(hours=1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def readings(spark):
    ts = F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0)")
    return spark.range(24 * 12).select(F.lit("s").alias("series_id"), ts.alias("ts"), (F.col("id") % 17).cast("double").alias("value"))


def test_co_located_tables_are_joined_without_a_shuffle(spark, readings):
    other = readings.where("value > 3").withColumnRenamed("value", "other").withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        left, right = co_located(readings, buckets=4), co_located(other, buckets=4)
        made = {
            "full": (align_full(left, right), align_full(readings, other)),
            "sample": (sample_at(left, right, {"at": "other"}), sample_at(readings, other, {"at": "other"})),
            "match": (match_truth(left, right), match_truth(readings, other)),
        }
        for name, (near, far) in made.items():
            assert "Exchange" not in plan_of(near), name
            assert "Exchange" in plan_of(far), name
            assert rows_of(near) == rows_of(far), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_co_located_tables_go_with_release(spark, readings):
    table = co_located(readings, buckets=2)
    listed = lambda: {r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("co_located")}
    assert listed() and table.count() == 288
    release(spark)
    assert not listed()


def test_a_slice_opens_its_days_only(spark, readings, tmp_path):
    path = str(tmp_path / "days")
    write_days(readings, path)
    for start, end in (("2024-03-04 06:00:00", "2024-03-06 00:00:00"), ("2024-03-04", "2024-03-05"), ("2024-03-11 22:00:00", None)):
        got = read_days(spark, path, start, end)
        want = slice_inclusive(readings, start, end) if end else readings.where(f"ts >= TIMESTAMP_NTZ '{start}'")
        assert rows_of(got.drop("day")) == rows_of(want)
        opened = {r[0].split("day=")[1][:10] for r in got.select(F.input_file_name()).distinct().collect()}
        assert opened == {str(r[0]) for r in want.select(F.to_date("ts")).distinct().collect()}
        assert "PartitionFilters: [isnotnull(day" in plan_of(got)
    with pytest.raises(ValueError):
        read_days(spark, path, None, "2024-03-05")
    assert read_days(spark, path).count() == 288


def test_the_analog_day_opens_its_folder_only(spark, readings, tmp_path):
    path = str(tmp_path / "days")
    write_days(readings, path)
    stored = read_days(spark, path)
    winner = stored.groupBy("series_id", "day").agg(F.sum("value").alias("x")).orderBy("x", "day").limit(1)
    got = on_days(stored, winner, ("series_id",))
    assert "dynamicpruning" in plan_of(got)
    day = winner.first()["day"]
    assert rows_of(got.select("ts", "value")) == rows_of(readings.where(F.to_date("ts") == F.lit(day)).select("ts", "value"))


def test_numbered_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = spark.range(40).select((F.col("id") % 8 + 3).cast("int").alias("page"), F.array(F.struct("id", F.lit("x").alias("name"))).alias("item"))
    rows.write.partitionBy("page").json(path)
    schema = "item ARRAY<STRUCT<id: BIGINT, name: STRING>>"
    assert landed_pages(spark, path) == list(range(3, 11))
    whole = read_numbered_pages(spark, path, schema, "item")
    assert whole.columns == ["page", "id", "name"] and {(r.page, r.id) for r in whole.collect()} == {(i % 8 + 3, i) for i in range(40)}
    rest = read_numbered_pages(spark, path, schema, "item", after=8, last=9)
    assert {r.page for r in rest.collect()} == {9} and "PartitionFilters: [isnotnull(page" in plan_of(rest)
    assert read_numbered_pages(spark, path, schema, "item", after=10).count() == 0
    with pytest.raises(FileNotFoundError, match="11, 12"):
        read_numbered_pages(spark, path, schema, "item", after=9, last=12)
    with pytest.raises(FileNotFoundError, match="1, 2"):
        read_numbered_pages(spark, path, schema, "item", after=0)


def test_korean_text_by_the_jvm_and_in_python(spark, tmp_path):
    from gridcast.queries.files import KOREAN, SERIES_SCHEMA

    rows = spark.createDataFrame([("서울, \"시\"", "2024-01-01 00:00:00", 1.5), (None, "2024-01-01 01:00:00", None)], "`지점` string, `일시` string, `기온(°C)` double")
    setting = spark.conf.get(S.JVM_CHARSETS, "false")
    for writes in (False, True):
        path = str(tmp_path / f"w{writes}")
        S.write_korean_csv(rows, path, in_python=writes)
        jvm, python = (S.read_korean_csv(spark, path, KOREAN, SERIES_SCHEMA, in_python=p) for p in (False, True))
        assert "Python" not in plan_of(jvm) and "Python" in plan_of(python)
        assert rows_of(jvm) == rows_of(python) and jvm.where("series_id = '서울, \"시\"'").count() == 1
    assert spark.conf.get(S.JVM_CHARSETS, "false") == setting


def test_every_day_of_every_series(spark):
    days = spark.createDataFrame([("a", "2024-02-28", 2.0), ("b", "2024-03-02", 5.0), ("b", "2024-03-01", None)], "series_id string, ts string, value double")
    made = every_day(days.withColumn("ts", F.to_date("ts")))
    got = {(r.series_id, str(r.ts)): r.value for r in made.collect()}
    want = [str(r[0]) for r in spark.sql("SELECT explode(sequence(DATE '2024-02-28', DATE '2024-03-02'))").collect()]
    assert got == {(s, d): {("a", "2024-02-28"): 2.0, ("b", "2024-03-02"): 5.0}.get((s, d), 0.0) for s in "ab" for d in want}
    assert len(made.columns) == 3 and made.schema["ts"].dataType.simpleString() == "date"
    assert every_day(days.withColumn("ts", F.to_date("ts")).limit(0)).count() == 0


@pytest.mark.parametrize("stride", [1, 3])
def test_frame_batches_hold_the_frames(spark, stride):
    ts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0)")
    rows = spark.range(900).where("id NOT IN (300, 301, 640)").crossJoin(spark.range(2).select(F.col("id").alias("s")))
    rows = rows.select(F.col("s").alias("series_id"), ts.alias("ts"), (F.col("id") % 13).cast("double").alias("a"), F.when(F.col("id") % 50 != 0, F.sqrt("id") + F.col("s")).alias("b"))
    frames = sliding_frames(rows, ["a", "b"], "b", 12, 5, HOUR, stride=stride, chunk=100)
    want = {}
    for r in frames.collect():
        want[r.series_id, r.ts] = [v for h in r.history for v in (h.a, h.b)], list(r.labels)
    chunks = frame_chunks(rows, ["a", "b"], 12, 5, HOUR, chunk=100)
    got, plain = {}, lambda v: [None if math.isnan(x) else x for x in v]
    for r in frame_batches(chunks, ["a", "b"], "b", 12, 5, HOUR, 7, stride, chunk=100).collect():
        assert 0 < len(r.anchors) <= 7
        wide = len(r.x) // len(r.anchors)
        for i, at in enumerate(r.anchors):
            assert (r.series_id, at) not in got
            got[r.series_id, at] = plain(r.x[i * wide : (i + 1) * wide]), plain(r.y[i * 5 : i * 5 + 5])
    assert got == want and len(got) > 1500


def test_frame_chunks_are_little_more_than_the_input(spark):
    ts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 15 * id, 0)")
    rows = spark.range(60_000).select(F.lit("s").alias("series_id"), ts.alias("ts"), F.rand(1).alias("v"))
    chunks = frame_chunks(rows, ["v"], 960, 96, timedelta(minutes=15))
    held = chunks.agg(F.sum(F.size("positions")), F.count("*")).first()
    assert held[0] <= 1.2 * 60_000 and held[1] >= 60_000 // 8448  # several chunks
    assert frame_batches(chunks.limit(0), ["v"], "v", 960, 96, timedelta(minutes=15), 32).count() == 0
