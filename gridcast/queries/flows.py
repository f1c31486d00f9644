from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridcast.operators.analog import in_season
from gridcast.operators.boosting import Boosting
from gridcast.operators.columns import fill_missing, slice_inclusive
from gridcast.operators.gram import Penalised
from gridcast.operators.grid import bucket_sum, resample_mean
from gridcast.operators.models import linear
from gridcast.plans.analog_features import analog_features
from gridcast.plans.dataset import QUARTER, build_dataset, sensor_grid
from gridcast.plans.forecast_day import forecast_day
from gridcast.plans.many_series import every_day, forecast_many, forecast_validation, segment_values
from gridcast.plans.submission import hourly_submission, keyless_submission
from gridcast.plans.training import fit_scaled, prepare, train_and_score
from gridcast.queries.registry import GRID_15, SPAN, daily_users, query, readings, readings_two, rnd, tidy
from gridcast.queries.sequences import _FILLED, _PROFILE, _profile, hourly
from gridcast.session import scratch_path, stored
from gridcast.sources.csv import number_across_files, read_ordered_numbers, write_ordered_numbers
from gridcast.sources.landing import hourly_profile


def _dataset(spark, sf, anchor="2023-01-01 00:00:00"):
    rows = readings_two(spark, sf)
    output = bucket_sum(rows, QUARTER, ["value"]).withColumnRenamed("value", "result")
    return build_dataset(rows, output, ["value", "load"], ["load"], anchor=anchor)


@query(
    "dataset_build",
    f"""WITH {GRID_15}, o AS (SELECT event_type series_id, time_bucket(INTERVAL '15 minutes', ts) ts, sum(value) s FROM events GROUP BY 1, 2),
d AS (SELECT series_id, ts, v, k - lag(k) OVER (PARTITION BY series_id ORDER BY ts) AS k,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2023-01-01')) / 86400000000.0 AS days FROM r)
SELECT d.series_id, d.ts, {rnd('coalesce(o.s, 0)', 4)} AS result, {rnd('coalesce(d.v, 0)', 4)} AS value, {rnd('coalesce(d.k, 0)', 4)} AS load,
  day(d.ts)::BIGINT AS date, month(d.ts)::BIGINT AS month, hour(d.ts)::BIGINT AS hour,
  {rnd('CASE WHEN days > 365 THEN days - 365 ELSE days END', 4)} AS difference
FROM d LEFT JOIN o ON o.series_id = d.series_id AND o.ts = d.ts""",
)
def dataset_build(spark, sf):
    return tidy(_dataset(spark, sf), 4)


@query(
    "dataset_per_source",
    f"""WITH e AS (SELECT event_type series_id, CAST(ts AS DATE) AS f, time_bucket(INTERVAL '15 minutes', ts) ts, value,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
lim AS (SELECT series_id, f, min(ts) lo, max(ts) hi FROM e GROUP BY 1, 2),
g AS (SELECT series_id, f, unnest(generate_series(lo, hi, INTERVAL '15 minutes')) ts FROM lim),
b AS (SELECT series_id, ts, avg(value) v, avg(k) k FROM e GROUP BY 1, 2)
SELECT g.series_id, g.ts, {rnd('b.v', 4)} AS value, {rnd('b.k - lag(b.k) OVER (PARTITION BY g.series_id, g.f ORDER BY g.ts)', 4)} AS load
FROM g LEFT JOIN b ON b.series_id = g.series_id AND b.ts = g.ts""",
)
def dataset_per_source(spark, sf):
    rows = readings_two(spark, sf).withColumn("source_file", F.to_date("ts").cast("string"))
    return tidy(sensor_grid(rows, ["value", "load"], ["load"], per_source=True), 4)


@query(
    "submission_hours",
    f"""WITH {GRID_15} SELECT series_id, date_trunc('hour', ts)::TIMESTAMP AS ts,
  {rnd('sum(CASE WHEN v - 20 < 0.01 THEN 0 ELSE v - 20 END)', 4)} AS prediction FROM r GROUP BY 1, 2""",
)
def submission_hours(spark, sf):
    grid = resample_mean(readings(spark, sf), QUARTER, ["value"])
    return tidy(hourly_submission(grid.select("series_id", "ts", (F.col("value") - 20).alias("prediction"))), 4)


@query(
    "submission_keyless",
    f"""WITH h AS (SELECT time_bucket(INTERVAL '15 minutes', ts) ts, avg(value) - 20 v FROM events GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY ts) AS pos, CASE WHEN v < 0.01 THEN 0 ELSE v END AS v FROM h)
SELECT ((pos - 1) // 4)::BIGINT AS block, {rnd('sum(v)', 4)} AS value FROM n GROUP BY 1""",
)
def submission_keyless(spark, sf):
    path = scratch_path(spark, "forecast")
    rows = readings(spark, sf).groupBy(F.window("ts", "15 minutes").start.alias("ts"))
    write_ordered_numbers(rows.agg((F.avg("value") - 20).alias("value")), path, "value", ["ts"])
    lines = number_across_files(read_ordered_numbers(spark, path))
    return tidy(keyless_submission(lines, keys=[], strict=False), 4)


@query(
    "submission_keyless_strict",
    f"""WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-10 23:45:00', INTERVAL '15 minutes')) AS ts),
b AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, avg(value) AS v FROM events GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY ts) AS pos, CASE WHEN coalesce(v, 0) - 20 < 0.01 THEN 0 ELSE coalesce(v, 0) - 20 END AS v FROM g LEFT JOIN b USING (ts))
SELECT ((pos - 1) // 4)::BIGINT AS block, {rnd('sum(v)', 4)} AS value FROM n GROUP BY 1""",
)
def submission_keyless_strict(spark, sf):
    """One whole day without times: 96 lines in blocks of four, as a submission needs them."""
    path = scratch_path(spark, "day")
    grid = fill_missing(resample_mean(readings(spark, sf).withColumn("series_id", F.lit("all")), QUARTER, ["value"]), ["value"])
    day = slice_inclusive(grid, "2024-01-10", "2024-01-10")
    write_ordered_numbers(day.select("ts", (F.col("value") - 20).alias("value")), path, "value", ["ts"])
    lines = number_across_files(read_ordered_numbers(spark, path))
    return tidy(keyless_submission(lines, keys=[]), 4)


@query(
    "analog_features_day",
    f"""WITH {_FILLED}, {_PROFILE}, x AS (SELECT f.series_id, CAST(f.ts AS DATE) AS day,
  (((value - v0) / v1 - (tv - v0) / v1) ** 2 + ((load - k0) / k1 - (tk - k0) / k1) ** 2) / 2 AS d FROM f JOIN t ON t.hour = hour(f.ts), s),
win AS (SELECT series_id, day FROM x GROUP BY 1, 2 HAVING count(*) = 24 ORDER BY avg(d), day, series_id LIMIT 1),
ev AS (SELECT event_type series_id, ts, time_bucket(INTERVAL '15 minutes', ts) bin, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k
  FROM events JOIN win ON win.series_id = event_type AND win.day = CAST(ts AS DATE)),
span AS (SELECT series_id, min(bin) lo, max(bin) hi FROM ev GROUP BY 1),
gg AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '15 minutes')) ts FROM span),
bb AS (SELECT series_id, bin AS ts, avg(value) v, avg(k) k FROM ev GROUP BY 1, 2),
dd AS (SELECT gg.series_id, gg.ts, v, k - lag(k) OVER (PARTITION BY gg.series_id ORDER BY gg.ts) AS dk FROM gg LEFT JOIN bb ON bb.series_id = gg.series_id AND bb.ts = gg.ts),
sm AS (SELECT series_id, ts, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS difference FROM ev)
SELECT dd.series_id, dd.ts, {rnd('coalesce(v, 0)', 4)} AS value, {rnd('coalesce(CASE WHEN dk < 0 THEN 0 ELSE dk END, 0)', 4)} AS load,
  0.0::DOUBLE AS result, 31::BIGINT AS date, 7::BIGINT AS month, hour(dd.ts)::BIGINT AS hour, {rnd('coalesce(sm.difference, 0)', 4)} AS difference
FROM dd LEFT JOIN sm ON sm.series_id = dd.series_id AND sm.ts = dd.ts""",
)
def analog_features_day(spark, sf):
    rows = readings_two(spark, sf)
    out = analog_features(
        hourly(spark, sf), rows, _profile(spark, sf), ["value", "load"], ["value"], ["load"], date=31, month=7
    )
    return tidy(out, 4)


HOLDOUTS = [(f"2024-01-{d} 00:00:00", f"2024-01-{d + 1} 00:00:00") for d in (10, 20, 28)]


@query("holdout_score")
def holdout_score(spark, sf):
    features = ["value", "load", "date", "month", "hour", "difference"]
    rows = stored(prepare(_dataset(spark, sf), features, clipped=["load"]), "prepared")
    model = Boosting(rounds=20, depth=4, step=0.3, patience=3, plateau=1)
    _, _, errors = train_and_score(rows, features, HOLDOUTS, model, capacity=7028)
    return tidy(errors, 4)


_TARGET = {"value": [30.0, 45.0, 60.0, 75.0, 70.0, 55.0, 40.0, 35.0]}
_HOURS = ", ".join(f"({h}, {_TARGET['value'][h // 3]}::DOUBLE)" for h in range(24))


@query(
    "forecast_day_linear",
    f"""WITH {GRID_15}, o AS (SELECT event_type series_id, time_bucket(INTERVAL '15 minutes', ts) ts, sum(value) s FROM events GROUP BY 1, 2),
y AS (SELECT r.series_id, r.ts, coalesce(o.s, 0) AS result, coalesce(r.v, 0) AS value FROM r LEFT JOIN o ON o.series_id = r.series_id AND o.ts = r.ts),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM y),
fit AS (SELECT regr_slope(result, value) AS b, regr_intercept(result, value) AS a FROM k WHERE i <= floor(n * 0.8)),
hl AS (SELECT event_type series_id, date_trunc('hour', min(ts)) lo, date_trunc('hour', max(ts)) hi FROM events GROUP BY 1),
hg AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '1 hour')) ts FROM hl),
hb AS (SELECT event_type series_id, date_trunc('hour', ts) ts, avg(value) v FROM events GROUP BY 1, 2),
t(hour, tv) AS (VALUES {_HOURS}), lim2 AS (SELECT min(tv) v0, max(tv) - min(tv) v1 FROM t),
x AS (SELECT hg.series_id, CAST(hg.ts AS DATE) AS day, ((coalesce(v, 0) - v0) / v1 - (tv - v0) / v1) ** 2 AS d
  FROM hg LEFT JOIN hb ON hb.series_id = hg.series_id AND hb.ts = hg.ts JOIN t ON t.hour = hour(hg.ts), lim2
  WHERE month(hg.ts) * 100 + day(hg.ts) BETWEEN 105 AND 120),
win AS (SELECT series_id, day FROM x GROUP BY 1, 2 HAVING count(*) = 24 ORDER BY avg(d), day, series_id LIMIT 1),
ev AS (SELECT event_type series_id, time_bucket(INTERVAL '15 minutes', ts) bin, value FROM events JOIN win ON win.series_id = event_type AND win.day = CAST(ts AS DATE)),
dg AS (SELECT series_id, unnest(generate_series(min(bin), max(bin), INTERVAL '15 minutes')) ts FROM ev GROUP BY series_id),
db AS (SELECT series_id, bin AS ts, avg(value) v FROM ev GROUP BY 1, 2),
p AS (SELECT dg.series_id, dg.ts, a + b * coalesce(v, 0) AS p FROM dg LEFT JOIN db ON db.series_id = dg.series_id AND db.ts = dg.ts, fit)
SELECT series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, {rnd('sum(CASE WHEN p < 0.01 THEN 0 ELSE p END)', 3)} AS prediction FROM p GROUP BY 1, 2""",
)
def forecast_day_linear(spark, sf):
    rows = stored(prepare(_dataset(spark, sf), ["value"], whole=()), "prepared")
    model, fit = fit_scaled(rows, ["value"], Penalised())
    target = hourly_profile(spark, _TARGET)
    season = hourly(spark, sf).where(in_season("ts", (1, 5), (1, 20)))
    day = analog_features(season, readings(spark, sf), target, ["value"], ["value"], [], date=31, month=7)
    return tidy(forecast_day(model, fit, day, ["value"]), 3)


_ONE_HOLDOUT = [
    f"SELECT '{a}' AS holdout, result AS y, a + b * value AS p FROM z, f WHERE ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'"
    for a, b in HOLDOUTS
]
_KEPT = " AND ".join(f"NOT (ts > TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}')" for a, b in HOLDOUTS)


@query(
    "holdout_score_linear",
    f"""WITH {GRID_15}, o AS (SELECT event_type series_id, time_bucket(INTERVAL '15 minutes', ts) ts, sum(value) s FROM events GROUP BY 1, 2),
z AS (SELECT r.series_id, r.ts, coalesce(o.s, 0) AS result, coalesce(r.v, 0) AS value FROM r LEFT JOIN o ON o.series_id = r.series_id AND o.ts = r.ts),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM z WHERE {_KEPT}),
f AS (SELECT regr_slope(result, value) AS b, regr_intercept(result, value) AS a FROM k WHERE i <= floor(n * 0.8)),
q AS ({" UNION ALL ".join(_ONE_HOLDOUT)})
SELECT holdout, count(*)::BIGINT AS n, {rnd('avg((y - p) * (y - p))', 4)} AS mse, {rnd('sqrt(avg((y - p) * (y - p)))', 4)} AS rmse,
  {rnd('avg(abs(y - p))', 4)} AS mae, {rnd('1 - avg((y - p) * (y - p)) / var_pop(y)', 4)} AS r2, {rnd('avg((y - p) * (y - p)) / 7028', 4)} AS capacity_error
FROM q GROUP BY 1""",
)
def holdout_score_linear(spark, sf):
    rows = stored(prepare(_dataset(spark, sf), ["value"], whole=()), "prepared")
    _, _, errors = train_and_score(rows, ["value"], HOLDOUTS, linear(), capacity=7028)
    return tidy(errors, 4)


def _every_day(spark, sf):
    """Every day of every user from the first to the last day of all, missing ones as 0."""
    return every_day(daily_users(spark, sf))


_WIDE = f"""{SPAN}, d AS (SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(ts AS DATE) AS ts, sum(value) AS value FROM events GROUP BY 1, 2),
g AS (SELECT series_id, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE ts FROM (SELECT DISTINCT series_id FROM d) u, span),
z AS (SELECT g.series_id, g.ts, coalesce(d.value, 0) AS value FROM g LEFT JOIN d USING (series_id, ts)),
bounds AS (SELECT 'train_history' AS segment, 'train' AS part, a AS lo, z - 14 AS hi FROM span UNION ALL SELECT 'train_target', 'train', z - 13, z - 7 FROM span
  UNION ALL SELECT 'val_history', 'val', a + 7, z - 7 FROM span UNION ALL SELECT 'val_target', 'val', z - 6, z FROM span),
w AS (SELECT series_id, ts, value, segment, part FROM z JOIN bounds ON ts BETWEEN lo AND hi),
m AS (SELECT series_id, part, avg(ln(1 + value)) AS a FROM w WHERE segment LIKE '%_history' GROUP BY 1, 2)"""


@query(
    "many_series_encode",
    f"""WITH {_WIDE} SELECT series_id, ts, segment, part, {rnd('value', 4)} AS value, {rnd('a', 4)} AS log_mean,
  {rnd('ln(1 + value) - a', 4)} AS scaled FROM w JOIN m USING (series_id, part)""",
)
def many_series_encode(spark, sf):
    return tidy(segment_values(_every_day(spark, sf), 7), 4)


_STEP = "0.1::DOUBLE + h[-1] * 0.3141592653::DOUBLE + h[-7] * 0.2718281828::DOUBLE"


@query(
    "many_series_recursion",
    f"""WITH RECURSIVE {_WIDE},
s AS (SELECT series_id, a, list(ln(1 + value) - a ORDER BY ts) AS h FROM w JOIN m USING (series_id, part)
  WHERE segment = 'val_history' GROUP BY 1, 2),
x(series_id, a, h, step) AS (SELECT series_id, a, h, 0 FROM s UNION ALL
  SELECT series_id, a, list_append(h, {_STEP}), step + 1 FROM x WHERE step < 7)
SELECT series_id, step::BIGINT AS step, (span.z - 7 + INTERVAL 1 DAY * step)::TIMESTAMP AS ts,
  {rnd('exp(h[-1] + x.a) - 1', 3)} AS prediction FROM x, span WHERE step > 0""",
)
def many_series_recursion(spark, sf):
    segments = segment_values(_every_day(spark, sf), 7)
    ahead = forecast_validation(segments, [1, 7], [0.3141592653, 0.2718281828], 0.1, 7)
    return tidy(ahead.drop("log_mean"), 3)


@query("many_series_forecast")
def many_series_forecast(spark, sf):
    _, scored, _ = forecast_many(_every_day(spark, sf), 7, [1, 2, 7])
    return tidy(scored.drop("log_mean"), 3)


@query(
    "many_series_one_lag",
    f"""WITH RECURSIVE {_WIDE},
e AS (SELECT series_id, part, segment, ts, a, ln(1 + value) - a AS s FROM w JOIN m USING (series_id, part)),
t AS (SELECT c.s AS y, p.s AS x FROM e c JOIN e p ON p.series_id = c.series_id AND p.ts = c.ts - 1
  WHERE c.part = 'train' AND p.part = 'train' AND c.segment = 'train_target'),
fit AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM t),
x(series_id, a, h, step) AS (SELECT series_id, e.a, s, 0 FROM e, span WHERE segment = 'val_history' AND ts = span.z - 7 UNION ALL
  SELECT series_id, a, b0 + b1 * h, step + 1 FROM x, fit WHERE step < 7)
SELECT x.series_id, x.step::BIGINT AS step, (span.z - 7 + INTERVAL 1 DAY * x.step)::TIMESTAMP AS ts,
  {rnd('exp(x.h + x.a) - 1', 3)} AS prediction, {rnd('z.value', 3)} AS truth
FROM span, x JOIN z ON z.series_id = x.series_id WHERE z.ts = span.z - 7 + x.step AND x.step > 0""",
)
def many_series_one_lag(spark, sf):
    _, scored, _ = forecast_many(_every_day(spark, sf), 7, [1])
    return tidy(scored.drop("log_mean"), 3)
