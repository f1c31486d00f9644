from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from gridcast.functions.timecols import day_time
from gridcast.operators.columns import repeat_rows
from gridcast.operators.grid import bucket_sum, resample_mean
from gridcast.plans.dataset import QUARTER
from gridcast.queries.registry import GRID_15, query, readings, rnd, table, tidy
from gridcast.session import scratch_path
from gridcast.sources import csv as S
from gridcast.sources.days import read_days, write_days
from gridcast.sources.landing import parse_json, read_json_pages, read_numbered_pages

HOUR = timedelta(hours=1)

SERIES_SCHEMA = StructType(
    [
        StructField("series_id", StringType()),
        StructField("ts", TimestampNTZType()),
        StructField("value", DoubleType()),
    ]
)


def _grid(spark, sf):
    return resample_mean(readings(spark, sf), QUARTER, ["value"])


@query(
    "csv_roundtrip_nan",
    f"WITH {GRID_15} SELECT series_id, ts, {rnd('v')} AS value FROM r",
)
def csv_roundtrip_nan(spark, sf):
    path = scratch_path(spark, "csv")
    S.write_csv(_grid(spark, sf), path)
    return tidy(S.read_csv(spark, path, SERIES_SCHEMA))


@query(
    "csv_headerless",
    f"SELECT 'plant' AS series_id, date_trunc('second', ts)::TIMESTAMP AS ts, {rnd('value')} AS result FROM events",
)
def csv_headerless(spark, sf):
    path = scratch_path(spark, "headerless")
    rows = readings(spark, sf)
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    S.write_csv(rows.select(text.alias("datetime"), "value"), path, header=False)
    return tidy(S.read_solar_output(spark, path, "plant"))


KOREAN = {"지점": "series_id", "일시": "ts", "기온(°C)": "value"}


@query(
    "csv_euckr",
    f"""SELECT '지점 ' || event_type AS series_id, date_trunc('second', ts)::TIMESTAMP AS ts, {rnd('value')} AS value
FROM events""",
)
def csv_euckr(spark, sf):
    path = scratch_path(spark, "euckr")
    rows = readings(spark, sf).select(
        F.concat(F.lit("지점 "), "series_id").alias("지점"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("일시"),
        F.col("value").alias("기온(°C)"),
    )
    S.write_korean_csv(rows, path)
    return tidy(S.read_korean_csv(spark, path, KOREAN, SERIES_SCHEMA))


@query(
    "csv_per_source",
    f"WITH {GRID_15} SELECT series_id AS source_file, ts, {rnd('v')} AS value FROM r",
)
def csv_per_source(spark, sf):
    path = scratch_path(spark, "sources")
    S.write_per_source(_grid(spark, sf).withColumnRenamed("series_id", "source_file"), path)
    schema = StructType([f for f in SERIES_SCHEMA if f.name != "series_id"] + [StructField("source_file", StringType())])
    return tidy(S.read_csv(spark, path, schema))


@query(
    "csv_glob",
    f"""SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, {rnd('sum(value)', 4)} AS value,
  '.csv' AS suffix FROM events GROUP BY 1, 2""",
)
def csv_glob(spark, sf):
    path = scratch_path(spark, "glob")
    S.write_per_source(
        bucket_sum(readings(spark, sf), HOUR, ["value"]).withColumn("folder", F.col("series_id")), path, by="folder"
    )
    rows = S.read_csv(spark, f"{path}/folder=*/*.csv", SERIES_SCHEMA, with_source=True)
    suffix = F.substring(F.col("source_file"), -4, 4).alias("suffix")
    return tidy(rows.select("series_id", "ts", "value", suffix), 4)


@query(
    "ordered_numbers",
    f"""WITH h AS (SELECT time_bucket(INTERVAL '15 minutes', ts) ts, avg(value) v FROM events GROUP BY 1)
SELECT (row_number() OVER (ORDER BY ts))::BIGINT AS pos, {rnd('v')} AS value FROM h""",
)
def ordered_numbers(spark, sf):
    path = scratch_path(spark, "numbers")
    everything = readings(spark, sf).withColumn("series_id", F.lit("all"))
    means = everything.groupBy(F.window("ts", "15 minutes").start.alias("ts")).agg(F.avg("value").alias("value"))
    S.write_ordered_numbers(means, path, "value", ["ts"])
    lines = S.read_ordered_numbers(spark, path)
    return tidy(S.number_across_files(lines).select("pos", "value"))


@query(
    "json_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_props(spark, sf):
    rows = parse_json(table(spark, sf, "events"), "props", "k BIGINT", "page")
    return rows.select("event_id", F.col("page.k").alias("k"))


@query(
    "json_pages",
    f"SELECT event_type AS station, date_trunc('second', ts)::TIMESTAMP AS tm, {rnd('value')} AS ta FROM events",
)
def json_pages(spark, sf):
    path = scratch_path(spark, "pages")
    item = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("tm"), F.col("value").alias("ta"), F.col("event_type").alias("station"))
    pages = table(spark, sf, "events").select(F.struct(F.struct(F.array(item).alias("item")).alias("body")).alias("response"))
    pages.write.json(path)
    schema = "response STRUCT<body: STRUCT<item: ARRAY<STRUCT<tm: STRING, ta: DOUBLE, station: STRING>>>>"
    rows = read_json_pages(spark, path, schema, "response.body.item")
    return tidy(rows.select("station", F.col("tm").cast("timestamp_ntz").alias("tm"), "ta"))


@query(
    "json_pages_source",
    f"""SELECT event_id // 1000 + 1 AS page, event_type AS station, date_trunc('second', ts)::TIMESTAMP AS tm, {rnd('value')} AS ta FROM events
WHERE event_id >= 1000 AND event_id // 1000 <= (SELECT max(event_id) FROM events) // 1000""",
)
def json_pages_source(spark, sf):
    """Pages of a thousand events, read on from the second one."""
    path = scratch_path(spark, "numbered")
    item = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("tm"), F.col("value").alias("ta"), F.col("event_type").alias("station"))
    events = table(spark, sf, "events").withColumn("page", F.floor(F.col("event_id") / 1000) + 1)
    pages = events.select("page", F.struct(F.struct(F.array(item).alias("item")).alias("body")).alias("response"))
    pages.write.partitionBy("page").json(path)
    schema = "response STRUCT<body: STRUCT<item: ARRAY<STRUCT<tm: STRING, ta: DOUBLE, station: STRING>>>>"
    rows = read_numbered_pages(spark, path, schema, "response.body.item", after=1)
    return tidy(rows.select("page", "station", F.col("tm").cast("timestamp_ntz").alias("tm"), "ta"))


@query(
    "day_store_slice",
    f"SELECT event_type AS series_id, ts, {rnd('value')} AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-13'",
)
def day_store_slice(spark, sf):
    """A range of time from a store with a folder for each day."""
    path = scratch_path(spark, "days")
    write_days(readings(spark, sf), path)
    return tidy(read_days(spark, path, "2024-01-10 06:00:00", "2024-01-12").drop("day"))


@query(
    "upsample_repeat",
    f"""WITH d AS (SELECT event_type series_id, date_trunc('day', ts) + INTERVAL 3 HOUR * (hour(ts) // 3) ts, avg(value) v FROM events GROUP BY 1, 2)
SELECT series_id, (ts + INTERVAL 1 HOUR * i)::TIMESTAMP AS ts, {rnd('v')} AS value FROM d, generate_series(0, 2) t(i)""",
)
def upsample_repeat(spark, sf):
    rows = readings(spark, sf)
    start = day_time(F.to_date("ts"), F.hour("ts") - F.pmod(F.hour("ts"), F.lit(3)))
    coarse = rows.groupBy("series_id", start.alias("ts")).agg(F.avg("value").alias("value"))
    return tidy(repeat_rows(coarse, 3, HOUR))
