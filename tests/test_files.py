import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridcast.plans.dataset import build_dataset
from gridcast.plans.submission import hourly_submission, keyless_submission
from gridcast.sources import csv as S
from gridcast.sources import schemas
from gridcast.sources.landing import hourly_profile, parse_json, read_json_pages

# A forecast day at 15 minutes and its hourly sums, in line order.
QUARTERS = """
1.091984589262306495e-02 6.298274081092326837e-03 1.089258925950527084e-02 1.166756872228719155e-02
-5.580533547857775140e-03 1.402301357308402378e-03 -3.087704782826825641e-03 5.065540431737899224e-03
-2.988637404764070936e-03 -1.462706249625608107e-02 3.465995400540530357e-03 -9.785498205503447705e-03
2.502368586622178066e-04 1.562171993864699959e-03 4.195634502463041829e-03 9.514085039572789740e-03
1.153155812302939509e-01 3.424640798108577466e-01 3.838495032048746536e-01 3.660017025895360154e-01
"""
HOURS = [3.977827795550785417e-02, -2.200396541638298745e-03, -2.393520270598306632e-02, 1.552212839456274668e-02, 1.207630866835562422e00]


@pytest.fixture
def lines(spark, tmp_path):
    path = tmp_path / "day.csv"
    path.write_text("\n".join(QUARTERS.split()) + "\n")
    return S.read_ordered_numbers(spark, str(path))


def test_known_hourly_sums(lines):
    sums = keyless_submission(lines, limit=None).orderBy("block").collect()
    assert [r["value"] for r in sums] == pytest.approx(HOURS, abs=1e-12)
    kept = {r["block"]: r["value"] for r in keyless_submission(lines).collect()}
    assert kept[0] == pytest.approx(3.348e-02, abs=1e-5) and kept[1] == 0.0


def test_hourly_sums_by_time(frame):
    rows = [("s", f"2020-07-31 0{i // 4}:{i % 4 * 15:02d}:00", float(v)) for i, v in enumerate(QUARTERS.split())]
    df = frame(rows, "series_id string, ts ntz, prediction double")
    got = [r["prediction"] for r in hourly_submission(df, limit=None).orderBy("ts").collect()]
    assert got == pytest.approx(HOURS, abs=1e-12)


def test_line_numbers_survive_many_blocks(spark, tmp_path):
    for name, start in (("a.csv", 0), ("b.csv", 5000)):
        (tmp_path / name).write_text("".join(f"{start + i}.5\n" for i in range(3000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        numbered = S.read_ordered_numbers(spark, str(tmp_path))
        assert S.read_csv(spark, str(tmp_path), "value double", header=False).rdd.getNumPartitions() > 10
        start = F.when(F.col("source_file") == "a.csv", 0).otherwise(5000)
        assert numbered.where(F.col("value") == start + F.col("pos") - 0.5).count() == 6000
        run = S.number_across_files(numbered)
        assert run.agg(F.max("pos"), F.count_distinct("pos")).first() == (6000, 6000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_ordered_sink_keeps_order_and_digits(spark, tmp_path):
    df = spark.range(50).select((49 - F.col("id")).alias("pos"), (F.col("id") / 7).alias("v")).repartition(5)
    S.write_ordered_numbers(df, str(tmp_path / "out"), "v", ["pos"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [float(t) for t in text.split()] == [(49 - i) / 7 for i in range(50)]


KOREAN_ROW = "포항,2017-08-03 00:01,25.1,0.0,90,4.0,1002.3,1005.0,95,0.01,NaN\n"


def korean_file(path, header=None):
    header = ",".join(header or schemas.MINUTE_HEADERS)
    path.write_bytes((header + "\n" + KOREAN_ROW + "포항,2017-08-03 00:02,,0.0,90,4.0,1002.3,1005.0,95,0.02,60\n").encode("euc-kr"))
    return str(path)


def test_korean_file(spark, tmp_path):
    df = S.read_korean_csv(spark, korean_file(tmp_path / "m.csv"), schemas.MINUTE_HEADERS, schemas.WEATHER_MINUTE)
    a, b = df.orderBy("ts").collect()
    assert a["series_id"] == "포항" and str(a["ts"]) == "2017-08-03 00:01:00"
    assert a["solar_radiation"] == 0.01 and a["solar_intensity"] is None
    assert b["temperature"] is None and b["solar_intensity"] == 60.0


def test_korean_header_in_another_order_is_an_error(spark, tmp_path):
    swapped = list(schemas.MINUTE_HEADERS)
    swapped[-1], swapped[-2] = swapped[-2], swapped[-1]
    path = korean_file(tmp_path / "m.csv", swapped)
    with pytest.raises(Exception, match="CSV header does not conform|header"):
        S.read_korean_csv(spark, path, schemas.MINUTE_HEADERS, schemas.WEATHER_MINUTE).collect()


def test_round_trip_of_missing_values(spark, frame, tmp_path):
    df = frame([("a", "2024-01-01 00:15:00", None), ("a", "2024-01-01 00:30:00", 60.0)], "series_id string, ts ntz, value double")
    S.write_csv(df, str(tmp_path / "o"))
    back = S.read_csv(spark, str(tmp_path / "o"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back.agg(F.avg("value"), F.count("value")).first() == (60.0, 1)


def test_one_folder_per_source(spark, frame, tmp_path):
    df = frame([("x.csv", "2024-01-01", 1.0), ("y.csv", "2024-01-02", 2.0)], "source_file string, ts ntz, value double")
    S.write_per_source(df, str(tmp_path / "o"))
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if p.is_dir()) == ["source_file=x.csv", "source_file=y.csv"]


def test_json(spark, tmp_path):
    page = {"response": {"body": {"items": {"item": [{"tm": "2010-01-01 01:00", "ta": "1.5"}, {"tm": "2010-01-01 02:00"}]}}}}
    (tmp_path / "p.json").write_text(json.dumps(page))
    schema = "response STRUCT<body: STRUCT<items: STRUCT<item: ARRAY<STRUCT<tm: STRING, ta: STRING>>>>>"
    rows = read_json_pages(spark, str(tmp_path), schema, "response.body.items.item").collect()
    assert [(r["tm"], r["ta"]) for r in rows] == [("2010-01-01 01:00", "1.5"), ("2010-01-01 02:00", None)]
    df = spark.createDataFrame([('{"k": 3}',), ("nonsense",)], "p string")
    assert [r["o"] and r["o"]["k"] for r in parse_json(df, "p", "k INT", "o").collect()] == [3, None]


def test_profile_repeats_coarse_values(spark):
    p = hourly_profile(spark, {"temperature": list(range(24)), "wind": [1, 2, 3, 4, 5, 6, 7, 8], "rain": [0]})
    got = {r["hour"]: (r["temperature"], r["wind"], r["rain"]) for r in p.collect()}
    assert got[0] == (0.0, 1.0, 0.0) and got[5] == (5.0, 2.0, 0.0) and got[23] == (23.0, 8.0, 0.0)
    with pytest.raises(ValueError, match="do not divide"):
        hourly_profile(spark, {"wind": [1, 2, 3, 4, 5]})


def test_dataset_from_files(spark, tmp_path):
    """Station files by month and output text, to an aligned training set."""
    for month, day in (("01", "31"), ("02", "01")):
        rows = [f"131,2020-{month}-{day} 00:{m:02d},1,{m},1,1,1,1,1,{m},{m}" for m in range(0, 60, 5)]
        (tmp_path / f"m_2020-{month}.csv").write_bytes(("\n".join([",".join(schemas.MINUTE_HEADERS), *rows]) + "\n").encode("euc-kr"))
    (tmp_path / "out.txt").write_text("2020-01-31T00:15:00+09:00,7.5\n2020-03-01T00:00:00+09:00,1.0\n")
    readings = S.read_korean_csv(spark, str(tmp_path / "m_*.csv"), schemas.MINUTE_HEADERS, schemas.WEATHER_MINUTE)
    readings = readings.withColumn("source_file", F.substring(F.col("ts").cast("string"), 1, 7))
    output = S.read_solar_output(spark, str(tmp_path / "out.txt"), "131")
    data = build_dataset(readings, output, per_source=True)
    got = {str(r["ts"]): r for r in data.collect()}
    assert len(got) == 9 and set(schemas.TRAINING_SET.names) < set(data.columns)
    assert got["2020-01-31 00:00:00"]["solar_radiation"] == 0.0
    assert got["2020-01-31 00:15:00"]["solar_radiation"] == 15.0 and got["2020-01-31 00:15:00"]["result"] == 7.5
    assert got["2020-02-01 00:00:00"]["precipitation"] == 0.0
    assert got["2020-03-01 00:00:00"]["difference"] == 60.0 and got["2020-03-01 00:00:00"]["temperature"] == 0.0


def test_dates_without_a_file_schema_do_not_parse_as_text(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,location,avgTemp,minTemp,maxTemp\n2019-07-01,전국,20.5,,30\n")
    r = S.read_csv(spark, str(tmp_path / "d.csv"), schemas.DAILY_TEMPERATURE).first()
    assert str(r["date"]) == "2019-07-01" and r["minTemp"] is None
    plain = StructType([StructField("a", StringType()), StructField("b", DoubleType())])
    (tmp_path / "n.csv").write_text("x,1\ny,NaN\n")
    assert [r["b"] for r in S.read_keyed_csv(spark, str(tmp_path / "n.csv"), plain, series="s", header=False).collect()] == [1.0, None]
