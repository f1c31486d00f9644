from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridcast.operators.align import align_full, attach, co_located, join_on, match_truth, sample_at
from gridcast.operators.columns import keep_equal
from gridcast.operators.grid import bucket_sum, grid_shift, resample_mean
from gridcast.plans.dataset import QUARTER
from gridcast.queries.registry import GRID_15, GRID_HOUR, query, readings, rnd, table, tidy

HOUR = timedelta(hours=1)


def _daily_orders(spark, sf):
    """Orders per date and priority, as a station's daily table."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("location"))
        .agg(F.avg("o_totalprice").alias("avg_price"))
    )


def _daily_counts(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("location"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "join_two_keys",
    f"""WITH a AS (SELECT CAST(o_orderdate AS DATE) date, o_orderpriority location, avg(o_totalprice) p FROM orders GROUP BY 1, 2),
c AS (SELECT CAST(o_orderdate AS DATE) date, o_orderpriority location, count(*) n FROM orders GROUP BY 1, 2)
SELECT date, location, {rnd('p', 4)} AS avg_price, n::BIGINT AS n FROM a JOIN c USING (date, location)""",
)
def join_two_keys(spark, sf):
    return tidy(join_on(_daily_orders(spark, sf), _daily_counts(spark, sf), ["date", "location"]), 4)


@query(
    "join_daily_to_fine",
    f"""WITH a AS (SELECT CAST(o_orderdate AS DATE) date, o_orderpriority location, avg(o_totalprice) p FROM orders GROUP BY 1, 2)
SELECT date, location, {rnd('p', 4)} AS avg_price, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS amount
FROM a JOIN lineitem ON CAST(l_shipdate AS DATE) = date WHERE location = '1-URGENT'""",
)
def join_daily_to_fine(spark, sf):
    fine = table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("amount")
    )
    daily = keep_equal(_daily_orders(spark, sf), "location", "1-URGENT")
    return tidy(attach(fine, daily, ["date"], "inner"), 4)


@query(
    "align_full",
    f"""WITH {GRID_15}, h AS (SELECT event_type series_id, time_bucket(INTERVAL '1 hour', ts) - INTERVAL 5 DAY ts,
  sum(value) s FROM events GROUP BY 1, 2)
SELECT coalesce(r.series_id, h.series_id) AS series_id, coalesce(r.ts, h.ts)::TIMESTAMP AS ts, {rnd('h.s', 4)} AS result,
  {rnd('r.v', 4)} AS value FROM h FULL JOIN r ON h.series_id = r.series_id AND h.ts = r.ts""",
)
def align_full_query(spark, sf):
    sums = bucket_sum(readings(spark, sf), HOUR, ["value"]).withColumnRenamed("value", "result")
    earlier = sums.withColumn("ts", F.col("ts") - F.expr("INTERVAL 5 DAY"))
    return tidy(align_full(earlier, resample_mean(readings(spark, sf), QUARTER, ["value"])), 4)


@query(
    "sample_left",
    f"""WITH {GRID_15}, m AS (SELECT event_type series_id, date_trunc('minute', ts) ts, max(value) x FROM events GROUP BY 1, 2)
SELECT r.series_id, r.ts, {rnd('r.v')} AS value, {rnd('m.x')} AS at_start
FROM r LEFT JOIN m ON m.series_id = r.series_id AND m.ts = r.ts""",
)
def sample_left(spark, sf):
    rows = readings(spark, sf)
    minute = rows.groupBy("series_id", F.col("ts").cast("string").substr(1, 16).cast("timestamp_ntz").alias("ts")).agg(
        F.max("value").alias("value")
    )
    return tidy(sample_at(resample_mean(rows, QUARTER, ["value"]), minute, {"at_start": "value"}))


@query(
    "match_truth",
    f"""WITH {GRID_HOUR}, p AS (SELECT series_id, ts, v truth, lag(v, 24) OVER (PARTITION BY series_id ORDER BY ts) prediction FROM r)
SELECT series_id, ts, {rnd('truth')} AS truth, {rnd('prediction')} AS prediction FROM p WHERE prediction IS NOT NULL""",
)
def match_truth_query(spark, sf):
    hourly = resample_mean(readings(spark, sf), HOUR, ["value"])
    naive = grid_shift(hourly, {"prediction": ("value", -24)}, HOUR).dropna(subset=["prediction"])
    truth = hourly.withColumnRenamed("value", "truth")
    return tidy(match_truth(truth, naive.select("series_id", "ts", "prediction")))


@query(
    "align_co_located",
    f"""WITH {GRID_15}, h AS (SELECT event_type series_id, time_bucket(INTERVAL '1 hour', ts) - INTERVAL 5 DAY ts,
  sum(value) s FROM events GROUP BY 1, 2)
SELECT coalesce(r.series_id, h.series_id) AS series_id, coalesce(r.ts, h.ts)::TIMESTAMP AS ts, {rnd('h.s', 4)} AS result,
  {rnd('r.v', 4)} AS value FROM h FULL JOIN r ON h.series_id = r.series_id AND h.ts = r.ts""",
)
def align_co_located(spark, sf):
    """The full alignment of two bucketed tables, which moves no rows."""
    sums = bucket_sum(readings(spark, sf), HOUR, ["value"]).withColumnRenamed("value", "result")
    earlier = co_located(sums.withColumn("ts", F.col("ts") - F.expr("INTERVAL 5 DAY")))
    return tidy(align_full(earlier, co_located(resample_mean(readings(spark, sf), QUARTER, ["value"]))), 4)
