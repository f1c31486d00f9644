from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridcast.functions import values as V
from gridcast.functions.timecols import grid_pos, pos_start
from gridcast.operators import frames as W
from gridcast.operators.align import attach
from gridcast.operators.analog import analog_day, day_distances
from gridcast.operators.columns import fill_missing
from gridcast.operators.forecast import latest_state, recursive_linear
from gridcast.operators.frame_batches import frame_batches, frame_chunks
from gridcast.operators.grid import calendar_ordinal, resample_mean
from gridcast.queries.registry import GRID_HOUR, SPAN, daily_users, query, readings, readings_two, rnd, tidy
from gridcast.queries.sampling import _number

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def hourly(spark, sf):
    """Hourly grid of both measures, gaps as 0."""
    return fill_missing(resample_mean(readings_two(spark, sf), HOUR, ["value", "load"]), ["value", "load"])


_FILLED = f"""{GRID_HOUR}, f AS (SELECT series_id, ts, coalesce(v, 0) AS value, coalesce(k, 0) AS load,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM r)"""


@query(
    "sliding_frames",
    f"""WITH {_FILLED}, a AS (SELECT series_id, ts, i FROM f WHERE i >= 48 AND i < n - 24)
SELECT a.series_id, a.ts, 'history' AS part, ((h.i - a.i + 48) // 4)::BIGINT AS pos, {rnd('h.value')} AS value, {rnd('h.load')} AS load
FROM a JOIN f h ON h.series_id = a.series_id AND h.i >= a.i - 48 AND h.i < a.i AND (h.i - a.i + 48) % 4 = 0
UNION ALL
SELECT a.series_id, a.ts, 'labels', (l.i - a.i)::BIGINT, {rnd('l.value')}, NULL
FROM a JOIN f l ON l.series_id = a.series_id AND l.i >= a.i AND l.i < a.i + 24""",
)
def sliding_frames(spark, sf):
    cut = W.sliding_frames(hourly(spark, sf), ["value", "load"], "value", 48, 24, HOUR, stride=4)
    none = F.lit(None).cast("double")

    def step(part, pos, value, load):
        return F.struct(F.lit(part).alias("part"), pos.alias("pos"), value.alias("value"), load.alias("load"))

    past = F.transform("history", lambda s, i: step("history", i, s["value"], s["load"]))
    ahead = F.transform("labels", lambda v, i: step("labels", i, v, none))
    return tidy(cut.select("series_id", "ts", F.inline(F.concat(past, ahead))))


@query(
    "frame_batches",
    f"""WITH {_FILLED}, a AS (SELECT series_id, ts, i FROM f WHERE i >= 48 AND i < n - 24),
h AS (SELECT a.series_id, a.ts, sum(h.value) AS past, sum(h.load * (h.i - a.i)) AS weighted FROM a JOIN f h ON h.series_id = a.series_id
  AND h.i >= a.i - 48 AND h.i < a.i AND (h.i - a.i + 48) % 4 = 0 GROUP BY 1, 2),
l AS (SELECT a.series_id, a.ts, sum(l.value * (l.i - a.i + 1)) AS ahead FROM a JOIN f l ON l.series_id = a.series_id AND l.i >= a.i AND l.i < a.i + 24 GROUP BY 1, 2)
SELECT series_id, ts, {rnd('past', 4)} AS past, {rnd('weighted', 3)} AS weighted, {rnd('ahead', 3)} AS ahead FROM h JOIN l USING (series_id, ts)""",
)
def frame_batches_query(spark, sf):
    """The batches of all frames, each frame summed up from its place in the batch."""
    chunks = frame_chunks(hourly(spark, sf), ["value", "load"], 48, 24, HOUR)
    batches = frame_batches(chunks, ["value", "load"], "value", 48, 24, HOUR, 32, stride=4)

    def total(values, weight):
        return F.aggregate(F.transform(values, weight), F.lit(0.0), lambda acc, x: acc + x)

    def one(anchor, i):
        x, y = F.slice("x", i * 24 + 1, F.lit(24)), F.slice("y", i * 24 + 1, F.lit(24))
        past = total(x, lambda v, j: F.when(j % 2 == 0, v).otherwise(0.0))
        weighted = total(x, lambda v, j: F.when(j % 2 == 1, v * (F.floor(j / 2) * 4 - 48)).otherwise(0.0))
        return F.struct(anchor.alias("ts"), past.alias("past"), weighted.alias("weighted"), total(y, lambda v, j: v * (j + 1)).alias("ahead"))

    rows = batches.select("series_id", F.inline(F.transform("anchors", one)))
    return tidy(tidy(rows, 3).drop("past").join(tidy(rows.select("series_id", "ts", "past"), 4), ["series_id", "ts"]), 6)


@query(
    "single_step_frames",
    f"""WITH {_FILLED}, a AS (SELECT series_id, ts, i FROM f WHERE i >= 24 AND i < n - 12 AND ts < TIMESTAMP '2024-01-25'),
s AS (SELECT a.series_id, a.ts, sum(h.load) x, count(*) c FROM a JOIN f h ON h.series_id = a.series_id AND h.i >= a.i - 24
  AND h.i < a.i AND (h.i - a.i + 24) % 5 = 0 GROUP BY 1, 2)
SELECT a.series_id, a.ts, s.c::BIGINT AS steps, {rnd('s.x', 4)} AS total, {rnd('l.value', 4)} AS label
FROM a JOIN s ON s.series_id = a.series_id AND s.ts = a.ts JOIN f l ON l.series_id = a.series_id AND l.i = a.i + 12""",
)
def single_step_frames(spark, sf):
    cut = W.sliding_frames(hourly(spark, sf), ["load"], "value", 24, 12, HOUR, stride=5, single_step=True)
    chosen = W.anchors_between(cut, 24, HOUR, end="2024-01-25 00:00:00")
    total = F.aggregate("history", F.lit(0.0), lambda acc, s: acc + s["load"])
    return tidy(chosen.select("series_id", "ts", F.size("history").alias("steps"), total.alias("total"), "label"), 4)


@query(
    "random_windows",
    f"""WITH {_FILLED}, t AS (SELECT DISTINCT series_id, floor(n * 0.9)::BIGINT AS n FROM f),
d AS (SELECT series_id, n, b AS batch, s AS sample FROM t, generate_series(0, 1) x(b), generate_series(0, 7) y(s)),
w AS (SELECT series_id, batch, sample, {_number('series_id, batch, sample', 5, 15)} % (n - 168) AS start FROM d)
SELECT w.series_id, w.batch::BIGINT AS batch, w.sample::BIGINT AS sample, (f.i - w.start)::BIGINT AS pos, {rnd('f.value')} AS value
FROM w JOIN f ON f.series_id = w.series_id AND f.i >= w.start AND f.i < w.start + 168""",
)
def random_windows(spark, sf):
    rows = hourly(spark, sf)
    bounds = readings(spark, sf).groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    cells = grid_pos("hi", HOUR) - grid_pos("lo", HOUR) + 1
    first = bounds.select("series_id", pos_start(grid_pos("lo", HOUR), HOUR).alias("first_ts"), cells.alias("rows"))
    numbered = calendar_ordinal(attach(rows, first, ["series_id"]), HOUR, F.col("first_ts"))
    limits = first.select("series_id", F.floor(F.col("rows") * 0.9).alias("n"))
    starts = W.window_starts(limits, 2, 8, 168, 5)
    stacked = W.random_windows(numbered, starts, 168, ["value"])
    steps = stacked.select("series_id", "batch", "sample", F.posexplode("steps").alias("pos", "s"))
    return tidy(steps.select("series_id", "batch", "sample", "pos", "s.value"))


_SEGMENTS = f"""{SPAN}, bounds AS (SELECT 'train_history' AS segment, a AS lo, z - 14 AS hi FROM span UNION ALL SELECT 'train_target', z - 13, z - 7 FROM span
  UNION ALL SELECT 'val_history', a + 7, z - 7 FROM span UNION ALL SELECT 'val_target', z - 6, z FROM span)"""
_DAILY = "d AS (SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(ts AS DATE) AS ts, sum(value) AS value FROM events GROUP BY 1, 2)"


@query(
    "segment_table",
    f"WITH {_SEGMENTS} SELECT segment, lo AS first_day, hi AS last_day, (hi - lo + 1)::BIGINT AS n_days FROM bounds",
)
def segment_table(spark, sf):
    return tidy(W.segment_table(daily_users(spark, sf), 7))


@query(
    "walk_forward_segments",
    f"""WITH {_SEGMENTS}, {_DAILY}
SELECT series_id, ts, segment, {rnd('value')} AS value FROM d JOIN bounds ON ts BETWEEN lo AND hi""",
)
def walk_forward_segments(spark, sf):
    return tidy(W.walk_forward_segments(daily_users(spark, sf), 7))


def _dense_segments(spark, sf):
    days = resample_mean(daily_users(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), DAY, ["value"])
    return W.walk_forward_segments(fill_missing(days, ["value"]), 7)


_DENSE = f"""{_DAILY}, lim AS (SELECT series_id, min(ts) lo, max(ts) hi FROM d GROUP BY 1),
g AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE ts FROM lim),
z AS (SELECT g.series_id, g.ts, coalesce(d.value, 0) AS value FROM g LEFT JOIN d USING (series_id, ts))"""


@query(
    "teacher_forcing",
    f"""WITH {_SEGMENTS}, {_DENSE}, s AS (SELECT series_id, ts, value, segment FROM z JOIN bounds ON ts BETWEEN lo AND hi
  WHERE segment IN ('train_history', 'train_target')),
last AS (SELECT series_id, max(ts) AS t FROM s WHERE segment = 'train_target' GROUP BY 1 INTERSECT SELECT series_id, t FROM
  (SELECT series_id, max(ts) AS t FROM s WHERE segment = 'train_target' GROUP BY 1) x
  WHERE series_id IN (SELECT series_id FROM s WHERE segment = 'train_history'))
SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1)::BIGINT AS pos, {rnd('value')} AS value
FROM s JOIN last USING (series_id) WHERE ts < t""",
)
def teacher_forcing(spark, sf):
    parts = W.sequence_arrays(_dense_segments(spark, sf), "value", ["series_id", "segment"])
    history = parts.where("segment = 'train_history'").select("series_id", F.col("value").alias("history"))
    target = parts.where("segment = 'train_target'").select("series_id", F.col("value").alias("target"))
    fed = history.join(target, "series_id").select("series_id", V.teacher_forced("history", "target").alias("x"))
    return tidy(fed.select("series_id", F.posexplode("x").alias("pos", "value")))


@query(
    "tail_slice",
    f"""WITH {_SEGMENTS}, {_DENSE}, s AS (SELECT series_id, ts, value FROM z JOIN bounds ON ts BETWEEN lo AND hi
  WHERE segment = 'val_history'),
t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM s)
SELECT series_id, (-back)::BIGINT AS step, {rnd('value')} AS value FROM t WHERE back <= 5""",
)
def tail_slice(spark, sf):
    parts = W.sequence_arrays(_dense_segments(spark, sf).where("segment = 'val_history'"), "value")
    cut = parts.select("series_id", V.tail("value", 5).alias("x"))
    paired = cut.select("series_id", F.arrays_zip(V.relative_steps(F.size("x")).alias("step"), F.col("x").alias("value")).alias("p"))
    return tidy(paired.select("series_id", F.inline("p")))


@query(
    "relative_steps",
    f"""WITH {GRID_HOUR}, f AS (SELECT series_id, CAST(ts AS DATE) AS day, ts, coalesce(v, 0) AS value FROM r)
SELECT series_id, day, (row_number() OVER w - 1 - count(*) OVER (PARTITION BY series_id, day))::BIGINT AS step, {rnd('value')} AS value
FROM f WINDOW w AS (PARTITION BY series_id, day ORDER BY ts)""",
)
def relative_steps(spark, sf):
    rows = hourly(spark, sf).withColumn("day", F.to_date("ts"))
    daily = W.sequence_arrays(rows, "value", ["series_id", "day"])
    zipped = F.arrays_zip(V.relative_steps(F.size("value")).alias("step"), F.col("value").alias("value"))
    return tidy(daily.select("series_id", "day", F.inline(zipped)))


@query(
    "reshape_blocks",
    f"""WITH {_FILLED} SELECT series_id, CAST(ts AS DATE) AS day, ((row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts) - 1) // 4)::BIGINT AS block,
  {rnd('value')} AS value FROM f""",
)
def reshape_blocks(spark, sf):
    rows = hourly(spark, sf).withColumn("day", F.to_date("ts"))
    daily = W.sequence_arrays(rows, "value", ["series_id", "day"])
    blocks = daily.select("series_id", "day", F.posexplode(V.reshape("value", 4)).alias("block", "x"))
    return tidy(blocks.select("series_id", "day", "block", F.explode("x").alias("value")))


def _profile(spark, sf):
    """Hourly means over all series and days: the profile to look for."""
    return readings_two(spark, sf).groupBy(F.hour("ts").alias("hour")).agg(
        F.round(F.avg("value"), 6).alias("value"), F.round(F.avg("load"), 6).alias("load")
    )


_PROFILE = """t AS (SELECT hour(ts) AS hour, round(avg(value), 6) tv, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) tk FROM events GROUP BY 1),
s AS (SELECT min(tv) v0, max(tv) - min(tv) v1, min(tk) k0, max(tk) - min(tk) k1 FROM t)"""


@query(
    "day_distances",
    f"""WITH {_FILLED}, {_PROFILE}, x AS (SELECT f.series_id, CAST(f.ts AS DATE) AS day,
  (((value - v0) / v1 - (tv - v0) / v1) ** 2 + ((load - k0) / k1 - (tk - k0) / k1) ** 2) / 2 AS d FROM f JOIN t ON t.hour = hour(f.ts), s)
SELECT series_id, day, {rnd('avg(d)', 5)} AS mse FROM x GROUP BY 1, 2 HAVING count(*) = 24""",
)
def day_distances_query(spark, sf):
    return tidy(day_distances(hourly(spark, sf), _profile(spark, sf), ["value", "load"], ["series_id"]), 5)


@query(
    "analog_day",
    f"""WITH {_FILLED}, {_PROFILE}, x AS (SELECT f.series_id, CAST(f.ts AS DATE) AS day,
  (((value - v0) / v1 - (tv - v0) / v1) ** 2 + ((load - k0) / k1 - (tk - k0) / k1) ** 2) / 2 AS d FROM f JOIN t ON t.hour = hour(f.ts), s)
SELECT series_id, day, {rnd('avg(d)', 5)} AS mse FROM x GROUP BY 1, 2 HAVING count(*) = 24 ORDER BY avg(d), day, series_id LIMIT 1""",
)
def analog_day_query(spark, sf):
    distances = day_distances(hourly(spark, sf), _profile(spark, sf), ["value", "load"], ["series_id"])
    return tidy(analog_day(distances, ["series_id"]), 5)


@query(
    "analog_day_unscaled_target",
    f"""WITH {_FILLED}, {_PROFILE}, x AS (SELECT f.series_id, CAST(f.ts AS DATE) AS day,
  (((value - v0) / v1 - tv) ** 2 + ((load - k0) / k1 - tk) ** 2) / 2 AS d FROM f JOIN t ON t.hour = hour(f.ts), s)
SELECT series_id, day, {rnd('avg(d)', 3)} AS mse FROM x GROUP BY 1, 2 HAVING count(*) = 24""",
)
def analog_day_unscaled_target(spark, sf):
    rows, profile = hourly(spark, sf), _profile(spark, sf)
    return tidy(day_distances(rows, profile, ["value", "load"], ["series_id"], scale_target=False), 3)


LAGS, WEIGHTS, INTERCEPT = [1, 2, 7], [0.4142135623, 0.2360679775, 0.2449489743], 1.4142135623


@query(
    "recursive_ar_forecast",
    f"""WITH RECURSIVE {_DENSE}, e AS (SELECT series_id, max(ts) AS last_ts FROM z GROUP BY 1),
s AS (SELECT e.series_id, e.last_ts, list(coalesce(z.value, 0) ORDER BY p) AS h
  FROM e CROSS JOIN generate_series(-6, 0) q(p) LEFT JOIN z ON z.series_id = e.series_id AND z.ts = (e.last_ts + INTERVAL 1 DAY * p)::DATE
  GROUP BY 1, 2),
a(series_id, last_ts, h, step) AS (SELECT series_id, last_ts, h, 0 FROM s UNION ALL
  SELECT series_id, last_ts, list_append(h, 1.4142135623::DOUBLE + h[-1] * 0.4142135623::DOUBLE + h[-2] * 0.2360679775::DOUBLE + h[-7] * 0.2449489743::DOUBLE), step + 1 FROM a WHERE step < 60)
SELECT series_id, step::BIGINT AS step, (last_ts + INTERVAL 1 DAY * step)::TIMESTAMP AS ts, {rnd('h[-1]', 4)} AS prediction
FROM a WHERE step > 0""",
)
def recursive_ar_forecast(spark, sf):
    days = resample_mean(daily_users(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), DAY, ["value"])
    state = latest_state(fill_missing(days, ["value"]), "value", max(LAGS), DAY)
    return tidy(recursive_linear(state, LAGS, WEIGHTS, INTERCEPT, 60, DAY), 4)
