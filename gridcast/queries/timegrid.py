from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridcast.functions import timecols as T
from gridcast.operators.columns import clip_negatives, fill_missing
from gridcast.operators.grid import bucket_sum, calendar_ordinal, grid_diff, grid_lead, resample_mean
from gridcast.plans.dataset import QUARTER, with_calendar, with_day_offset
from gridcast.queries.registry import GRID_15, GRID_HOUR, query, readings, readings_two, rnd, table, tidy

HOUR = timedelta(hours=1)


@query(
    "resample_mean",
    f"WITH {GRID_15} SELECT series_id, ts, {rnd('v')} AS value, {rnd('k')} AS load FROM r",
)
def resample_mean_query(spark, sf):
    return tidy(resample_mean(readings_two(spark, sf), QUARTER, ["value", "load"]))


@query(
    "resample_odd_step",
    f"""
WITH lim AS (SELECT event_type series_id, date_trunc('day', min(ts)) AS o,
    (epoch_us(min(ts)) - epoch_us(date_trunc('day', min(ts)))) // 25200000000 AS lo,
    (epoch_us(max(ts)) - epoch_us(date_trunc('day', min(ts)))) // 25200000000 AS hi FROM events GROUP BY 1),
g AS (SELECT series_id, o, unnest(generate_series(lo, hi)) p FROM lim),
b AS (SELECT e.event_type series_id, (epoch_us(e.ts) - epoch_us(lim.o)) // 25200000000 p, avg(value) v
      FROM events e JOIN lim ON lim.series_id = e.event_type GROUP BY 1, 2)
SELECT g.series_id, (g.o + INTERVAL 7 HOUR * g.p)::TIMESTAMP AS ts, {rnd('b.v')} AS value
FROM g LEFT JOIN b USING (series_id, p)""",
)
def resample_odd_step(spark, sf):
    return tidy(resample_mean(readings(spark, sf), timedelta(hours=7), ["value"]))


@query(
    "resample_diff",
    f"""
WITH {GRID_15}, d AS (SELECT series_id, ts, v - lag(v) OVER (PARTITION BY series_id ORDER BY ts) AS dv FROM r)
SELECT series_id, ts, {rnd('coalesce(CASE WHEN dv < 0 THEN 0 ELSE dv END, 0)')} AS value,
  day(ts)::BIGINT AS date, month(ts)::BIGINT AS month, hour(ts)::BIGINT AS hour
FROM d""",
)
def resample_diff(spark, sf):
    steps = grid_diff(resample_mean(readings(spark, sf), QUARTER, ["value"]), ["value"], QUARTER)
    return tidy(with_calendar(fill_missing(clip_negatives(steps, ["value"]), ["value"])))


@query(
    "hourly_block_sum",
    f"""SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, {rnd('sum(value)', 4)} AS value
FROM events GROUP BY 1, 2""",
)
def hourly_block_sum(spark, sf):
    return tidy(bucket_sum(readings(spark, sf), HOUR, ["value"]), 4)


@query(
    "grid_lead",
    f"""WITH {GRID_HOUR}, l AS (SELECT series_id, ts, v, lead(v, 24) OVER w AS ahead, lead(ts, 24) OVER w AS t
  FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, ts, {rnd('v')} AS value, {rnd('ahead')} AS value_ahead FROM l WHERE t IS NOT NULL""",
)
def grid_lead_query(spark, sf):
    return tidy(grid_lead(resample_mean(readings(spark, sf), HOUR, ["value"]), ["value"], 24, HOUR))


@query(
    "grid_ordinal",
    f"""WITH {GRID_15} SELECT series_id, ts,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 900000000 AS ordinal FROM r""",
)
def grid_ordinal(spark, sf):
    grid = resample_mean(readings(spark, sf), QUARTER, ["value"])
    return tidy(calendar_ordinal(grid, QUARTER, "2024-01-01 00:00:00").drop("value"))


@query(
    "calendar_features",
    """SELECT event_id, day(ts)::BIGINT AS date, month(ts)::BIGINT AS month, hour(ts)::BIGINT AS hour,
  CAST(ts AS DATE) AS day FROM events""",
)
def calendar_features(spark, sf):
    rows = with_calendar(table(spark, sf, "events"))
    return tidy(rows.select("event_id", "date", "month", "hour", F.to_date("ts").alias("day")))


@query(
    "decimal_hour",
    f"SELECT event_id, {rnd('hour(ts) + minute(ts) / 15.0 * 0.25')} AS time FROM events",
)
def decimal_hour(spark, sf):
    return tidy(table(spark, sf, "events").select("event_id", T.decimal_hour("ts").alias("time")))


@query(
    "day_offset_wrapped",
    f"""WITH d AS (SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) / 86400000000.0 AS d
  FROM orders) SELECT o_orderkey, {rnd('CASE WHEN d > 365 THEN d - 365 ELSE d END')} AS difference FROM d""",
)
def day_offset_wrapped(spark, sf):
    rows = with_day_offset(table(spark, sf, "orders"), "1995-01-01 00:00:00", "o_orderdate")
    return tidy(rows.select("o_orderkey", "difference"))


@query(
    "parse_offset_time",
    """SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts, CAST(ts AS DATE) AS date FROM events""",
)
def parse_offset_time(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    rows = table(spark, sf, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", T.parse_offset_time("text").alias("ts"), F.to_date(F.substring("text", 1, 10)).alias("date"))


@query(
    "parse_time_text",
    """SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts,
  (CAST(o_orderdate AS DATE) - INTERVAL 60 DAY)::DATE AS shifted, 60::BIGINT AS days FROM orders""",
)
def parse_time_text(spark, sf):
    text = F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")
    rows = table(spark, sf, "orders").select("o_orderkey", T.parse_time(text, "yyyy/MM/dd HH:mm").alias("ts"))
    day = F.to_date("ts")
    shifted = rows.withColumn("shifted", F.date_sub(day, 60))
    return tidy(shifted.withColumn("days", F.date_diff(day, F.col("shifted"))))


@query(
    "day_time_keys",
    """SELECT o_orderkey, (date_trunc('day', o_orderdate) + INTERVAL 23 HOUR + INTERVAL 45 MINUTE)::TIMESTAMP AS day_end,
  strftime(o_orderdate, '%Y-%m-%d') || ' 23:45' AS day_end_text FROM orders""",
)
def day_time_keys(spark, sf):
    d = F.col("o_orderdate")
    parts = F.format_string("%04d-%02d-%02d 23:45", F.year(d), F.month(d), F.dayofmonth(d))
    return table(spark, sf, "orders").select(
        "o_orderkey", T.day_time(d, 23, 45).alias("day_end"), parts.alias("day_end_text")
    )
