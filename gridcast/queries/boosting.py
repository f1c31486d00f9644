"""Boosting with a stop of its own, and its trees inside a recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.timecols import calendar
from gridcast.operators import models as M
from gridcast.operators.boosting import Boosting
from gridcast.operators.columns import fill_missing
from gridcast.operators.forecast import lag_features, latest_state, recursive_trees
from gridcast.operators.grid import resample_mean
from gridcast.operators.rank import chrono_split
from gridcast.operators.sampling import hash_split
from gridcast.operators.stats import error_metrics
from gridcast.plans.training import fit_forecaster
from gridcast.queries.learning import HOUR, LAG_FEATURES, _lagged
from gridcast.queries.registry import GRID_HOUR, query, readings, rnd, table, tidy
from gridcast.queries.sampling import _number
from gridcast.session import stored

_GAINS = """list_transform(range(1, len(n)), lambda i: list_sum(res[1:i]) ** 2 / list_sum(n[1:i])
  + list_sum(res[i + 1:]) ** 2 / list_sum(n[i + 1:]))"""
_SIDES = "list_sum(res[1:cut]) / list_sum(n[1:cut]) AS low, list_sum(res[cut + 1:]) / list_sum(n[cut + 1:]) AS high"


@query(
    "early_stop_stump",
    f"""WITH RECURSIVE x AS (SELECT hour(ts) AS h, value AS y, {_number('event_id', 42)} / 4294967296.0 < 0.33 AS is_test FROM events),
c AS (SELECT h, count(*) FILTER (NOT is_test) AS n, sum(y) FILTER (NOT is_test) AS s, count(*) FILTER (is_test) AS vn,
  coalesce(sum(y) FILTER (is_test), 0) AS vs, coalesce(sum(y * y) FILTER (is_test), 0) AS vq FROM x GROUP BY h),
l AS MATERIALIZED (SELECT list(n ORDER BY h) AS n, list(s ORDER BY h) AS s, list(vn ORDER BY h) AS vn, list(vs ORDER BY h) AS vs,
  sum(vq) AS vq, sum(s) / sum(n) AS base FROM c),
r(round, m, step, used, best, best_at, mse) AS (
  SELECT -1, list_transform(n, lambda z: base), 0.5::DOUBLE, 0::DOUBLE, 'inf'::DOUBLE, -1, 0::DOUBLE FROM l
  UNION ALL
  SELECT round + 1, moved, CASE WHEN error < best THEN step ELSE step / 2 END, step, least(error, best),
    CASE WHEN error < best THEN round + 1 ELSE best_at END, error
  FROM (SELECT *, (vq - 2 * list_sum(list_transform(range(1, len(n) + 1), lambda i: vs[i] * moved[i]))
      + list_sum(list_transform(range(1, len(n) + 1), lambda i: vn[i] * moved[i] ** 2))) / list_sum(vn) AS error
    FROM (SELECT *, list_transform(range(1, len(n) + 1), lambda i: m[i] + step * CASE WHEN i <= cut THEN low ELSE high END) AS moved
      FROM (SELECT *, {_SIDES}
        FROM (SELECT *, list_position(g, list_max(g)) AS cut
          FROM (SELECT *, {_GAINS} AS g
            FROM (SELECT r.*, l.*, list_transform(range(1, len(n) + 1), lambda i: s[i] - n[i] * m[i]) AS res FROM r, l
              WHERE round < 11 AND (round < 0 OR round - best_at < 2)))))))
)
SELECT round::BIGINT AS round, used AS step, {rnd('mse', 4)} AS mse, round <= max(best_at) OVER () AS kept FROM r WHERE round >= 0""",
)
def early_stop_stump(spark, sf):
    """Boosted stumps on the hour: every fitted round, with its step and validation error."""
    rows = table(spark, sf, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    rows = hash_split(rows, 0.33, ["event_id"])
    model = Boosting(rounds=12, depth=1, step=0.5, patience=2, plateau=1).fit(rows, ["hour"], "value", "is_test")
    made = [(i, r.step, r.error, i < len(model.trees)) for i, r in enumerate(model.rounds)]
    return tidy(spark.createDataFrame(made, "round long, step double, mse double, kept boolean"), 4)


@query("gbt_early_stop")
def gbt_early_stop(spark, sf):
    _, rows = _lagged(spark, sf)
    model = fit_forecaster(rows, LAG_FEATURES, "value", Boosting(rounds=30, depth=3, step=0.3, patience=4, plateau=2))
    scored = model.transform(M.xy_split(rows, LAG_FEATURES, "value", ["series_id"]))
    metrics = error_metrics(scored, "label", "prediction", ["series_id"])
    return tidy(metrics.withColumns({"trees": F.lit(len(model.trees)), "rounds": F.lit(len(model.rounds))}), 4)


@query("forecast_gbt")
def forecast_gbt(spark, sf):
    hourly, rows = _lagged(spark, sf)
    model = fit_forecaster(rows, LAG_FEATURES, "value", Boosting(rounds=12, depth=3, step=0.3, patience=3, plateau=1))
    state = latest_state(hourly, "value", 24, HOUR)

    def features(past, ts):
        return {f"lag_{k}": F.element_at(past, -k) for k in (1, 2, 24)} | calendar(ts)

    return tidy(recursive_trees(state, model, features, 24, HOUR), 4)


def _level(recent, day_before):
    """The recent hours and the same hour a day before as one of sixteen levels."""
    return F.least(F.floor((recent + day_before) / 30), F.lit(15)).cast("double")


def _stump_round(last: str, made: str, margin: str) -> str:
    """CTEs of one more stump on l (levels lv, counts n, sums s, base) with the margin so far as SQL of level z."""
    return f"""{made}_a AS (SELECT *, list_transform(range(1, len(n) + 1), lambda i: s[i] - n[i] * ({margin.replace('z', 'lv[i]')})) AS res FROM {last}),
{made}_g AS (SELECT *, {_GAINS} AS g FROM {made}_a), {made}_c AS (SELECT *, list_position(g, list_max(g)) AS cut FROM {made}_g),
{made}_s AS (SELECT *, {_SIDES} FROM {made}_c),
{made} AS (SELECT * EXCLUDE (res, g, cut, low, high), (lv[cut] + lv[cut + 1]) / 2 AS cut_{made}, 0.5 * low AS low_{made}, 0.5 * high AS high_{made} FROM {made}_s)"""


_ONE = "base + CASE WHEN z <= cut_one THEN low_one ELSE high_one END"
_TWO = f"{_ONE} + CASE WHEN z <= cut_two THEN low_two ELSE high_two END"


@query(
    "recursive_stump_forecast",
    f"""WITH RECURSIVE {GRID_HOUR}, f AS (SELECT series_id, ts, coalesce(v, 0) AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n,
  lag(coalesce(v, 0), 1) OVER w AS a, lag(coalesce(v, 0), 2) OVER w AS b, lag(coalesce(v, 0), 24) OVER w AS d
  FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
t AS (SELECT least(floor((a + b + d) / 30), 15)::DOUBLE AS level, count(*) AS n, sum(y) AS s FROM f
  WHERE i > 24 AND i - 24 <= floor((n - 24) * 0.8) GROUP BY 1),
l AS (SELECT list(level ORDER BY level) AS lv, list(n ORDER BY level) AS n, list(s ORDER BY level) AS s, sum(s) / sum(n) AS base FROM t),
{_stump_round('l', 'one', 'base')}, {_stump_round('one', 'two', _ONE)},
h AS (SELECT series_id, max(ts) AS last_ts, list(y ORDER BY ts) AS h FROM f WHERE i > n - 24 GROUP BY series_id),
q(series_id, last_ts, h, step) AS (SELECT series_id, last_ts, h, 0 FROM h UNION ALL
  SELECT series_id, last_ts, list_append(h, {_TWO}), step + 1
  FROM (SELECT q.*, two.*, least(floor((q.h[-1] + q.h[-2] + q.h[-24]) / 30), 15) AS z FROM q, two WHERE step < 24))
SELECT series_id, step::BIGINT AS step, last_ts + INTERVAL 1 HOUR * step AS ts, {rnd('h[-1]', 3)} AS prediction FROM q WHERE step > 0""",
)
def recursive_stump_forecast(spark, sf):
    """Two boosted stumps on the level of past hours, fed back for a day."""
    hourly = stored(fill_missing(resample_mean(readings(spark, sf), HOUR, ["value"]), ["value"]), "hourly")
    lagged = lag_features(hourly, "value", [1, 2, 24], HOUR)
    rows = lagged.withColumn("level", _level(F.col("lag_1") + F.col("lag_2"), F.col("lag_24")))
    train = chrono_split(rows, 0.8).where("is_train").withColumn("is_validation", F.lit(False))
    model = Boosting(rounds=2, depth=1, step=0.5).fit(train, ["level"], "value", "is_validation")
    state = latest_state(hourly, "value", 24, HOUR)

    def features(past, _):
        return {"level": _level(F.element_at(past, -1) + F.element_at(past, -2), F.element_at(past, -24))}

    return tidy(recursive_trees(state, model, features, 24, HOUR), 3)
