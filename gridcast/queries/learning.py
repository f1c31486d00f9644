from __future__ import annotations

from datetime import timedelta

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from gridcast.functions.timecols import calendar, decimal_hour
from gridcast.operators import models as M
from gridcast.operators.columns import fill_missing
from gridcast.operators.forecast import lag_features
from gridcast.operators.frames import sliding_frames
from gridcast.operators.grid import resample_mean
from gridcast.operators.knn import knn_regress
from gridcast.operators.rank import chrono_split
from gridcast.operators.sampling import hash_fold, hash_split
from gridcast.operators.scale import fit_standard, standardise
from gridcast.operators.stats import fold_summary
from gridcast.plans.direct import direct_forecast
from gridcast.queries.registry import GRID_HOUR, query, readings, rnd, table, tidy
from gridcast.queries.sampling import _number
from gridcast.session import stored

HOUR = timedelta(hours=1)
FEATURES = ["time", "day", "load"]


def _samples(spark, sf):
    """`events` as regression samples: value by time of day, day and load."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("value").alias("label_value"),
        decimal_hour("ts").alias("time"),
        F.dayofmonth("ts").cast("double").alias("day"),
        F.get_json_object("props", "$.k").cast("double").alias("load"),
    )


def _cv(spark, sf, models):
    rows = hash_split(_samples(spark, sf), 0.33, ["event_id"]).where("not is_test")
    scores = M.cross_validate(hash_fold(rows, 10, ["event_id"]), models, FEATURES, "label_value")
    return tidy(fold_summary(scores, ["rmse", "r2", "mae"]), 4)


@query("cart_cv")
def cart_cv(spark, sf):
    return _cv(spark, sf, {"cart": M.cart(maxDepth=5)})


@query("gbt_cv")
def gbt_cv(spark, sf):
    return _cv(spark, sf, {"gbt": M.boosted_trees(maxIter=3, maxDepth=3)})


@query(
    "linear_cv_one_feature",
    f"""WITH x AS (SELECT value AS y, CAST(json_extract(props, '$.k') AS DOUBLE) AS c, {_number('event_id', 21)} % 10 AS fold FROM events
  WHERE NOT ({_number('event_id', 42)} / 4294967296.0 < 0.33)),
f AS (SELECT k, regr_slope(y, c) AS b, regr_intercept(y, c) AS a FROM x, range(10) t(k) WHERE fold <> k GROUP BY k),
s AS (SELECT k, sqrt(avg((y - a - b * c) ** 2)) AS rmse, 1 - avg((y - a - b * c) ** 2) / var_pop(y) AS r2, avg(abs(y - a - b * c)) AS mae
  FROM x JOIN f ON fold = k GROUP BY k)
"""
    + " UNION ALL ".join(
        f"SELECT 'linear' AS model, '{m}' AS metric, {rnd(f'avg({m})', 4)} AS mean, {rnd(f'stddev_pop({m})', 4)} AS std FROM s"
        for m in ("rmse", "r2", "mae")
    ),
)
def linear_cv_one_feature(spark, sf):
    rows = hash_split(_samples(spark, sf), 0.33, ["event_id"]).where("not is_test")
    scores = M.cross_validate(hash_fold(rows, 10, ["event_id"]), {"linear": M.linear()}, ["load"], "label_value")
    return tidy(fold_summary(scores, ["rmse", "r2", "mae"]), 4)


_FOLDS = f"""x AS (SELECT event_id, value AS y, CAST(json_extract(props, '$.k') AS DOUBLE) AS c, {_number('event_id', 21)} % 10 AS fold FROM events
  WHERE NOT ({_number('event_id', 42)} / 4294967296.0 < 0.33)),
st AS (SELECT k, round(avg(c), 6) AS m, round(stddev_pop(c), 6) AS d, avg(y) AS ym FROM x, range(10) t(k) WHERE fold <> k GROUP BY k)"""


def _summary(model: str) -> str:
    """SQL of the fold summary from q: k, y, p."""
    scores = """s AS (SELECT k, sqrt(avg((y - p) ** 2)) AS rmse, 1 - avg((y - p) ** 2) / var_pop(y) AS r2, avg(abs(y - p)) AS mae FROM q GROUP BY k)
"""
    return scores + " UNION ALL ".join(
        f"SELECT '{model}' AS model, '{m}' AS metric, {rnd(f'avg({m})', 3)} AS mean, {rnd(f'stddev_pop({m})', 3)} AS std FROM s"
        for m in ("rmse", "r2", "mae")
    )


def _penalised(model: str, alpha: float, ratio: float) -> str:
    """One standardised feature: the slope is its covariance with the label, cut by the penalty and shrunk."""
    return f"""WITH {_FOLDS},
cov AS (SELECT k, avg((c - m) / d * (y - ym)) AS v, avg(((c - m) / d) ** 2) AS q, avg((c - m) / d) AS z FROM x, st WHERE fold <> k GROUP BY k),
w AS (SELECT k, sign(v) * greatest(abs(v) - {alpha * ratio}, 0) / (q + {alpha * (1 - ratio)}) AS w FROM cov),
q AS (SELECT k, y, ym + w * (c - m) / d AS p FROM x JOIN st ON fold = k JOIN w USING (k)), """ + _summary(model)


def _one_feature(spark, sf, models):
    rows = hash_split(_samples(spark, sf), 0.33, ["event_id"]).where("not is_test")
    scores = M.cross_validate(hash_fold(rows, 10, ["event_id"]), models, ["load"], "label_value", key="event_id")
    return tidy(fold_summary(scores, ["rmse", "r2", "mae"]), 3)


@query("lasso_one_feature", _penalised("lasso", 0.05, 1.0))
def lasso_one_feature(spark, sf):
    return _one_feature(spark, sf, {"lasso": M.lasso(0.05, tol=1e-12)})


@query("elastic_net_one_feature", _penalised("elastic_net", 0.2, 0.25))
def elastic_net_one_feature(spark, sf):
    return _one_feature(spark, sf, {"elastic_net": M.elastic_net(0.2, 0.25, tol=1e-12)})


@query(
    "model_comparison",
    f"""WITH {_FOLDS}, z AS (SELECT k, event_id, y, fold, (c - m) / d AS c FROM x, st),
e AS (SELECT q.k, q.event_id, q.y, t.y AS ty, t.event_id AS id, (q.c - t.c) * (q.c - t.c) AS d FROM z q JOIN z t ON q.k = t.k AND q.fold = q.k AND t.fold <> t.k),
q AS (SELECT k, event_id, any_value(y) AS y, list_avg(min_by(ty, (d, id), 5)) AS p FROM e GROUP BY k, event_id), """
    + _summary("nearest")
    + f""" UNION ALL SELECT * FROM (WITH {_FOLDS},
f AS (SELECT k, regr_slope(y, c) AS b, regr_intercept(y, c) AS a FROM x, range(10) t(k) WHERE fold <> k GROUP BY k),
q AS (SELECT k, y, a + b * c AS p FROM x JOIN f ON fold = k), """
    + _summary("linear")
    + ")",
)
def model_comparison(spark, sf):
    return _one_feature(spark, sf, {"nearest": M.Nearest(5, tile_rows=512), "linear": M.linear()})


_STUMP = f"""WITH x AS (SELECT event_id, value AS y, hour(ts)::DOUBLE AS c, {_number('event_id', 42)} / 4294967296.0 < 0.33 AS is_test FROM events),
t AS (SELECT * FROM x WHERE NOT is_test), v AS (SELECT DISTINCT c FROM t),
g AS (SELECT v.c AS cut, count(*) FILTER (WHERE t.c <= v.c) AS nl, count(*) FILTER (WHERE t.c > v.c) AS nr,
  var_pop(y) FILTER (WHERE t.c <= v.c) AS vl, var_pop(y) FILTER (WHERE t.c > v.c) AS vr,
  avg(y) FILTER (WHERE t.c <= v.c) AS yl, avg(y) FILTER (WHERE t.c > v.c) AS yr FROM t, v GROUP BY v.c),
b AS (SELECT * FROM g WHERE nr > 0 ORDER BY nl * vl + nr * vr LIMIT 1)
SELECT event_id, {rnd('CASE WHEN c <= cut THEN yl ELSE yr END', 4)} AS prediction FROM x, b WHERE is_test"""


def _stump(spark, sf, model):
    rows = table(spark, sf, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    rows = hash_split(rows, 0.33, ["event_id"])
    fitted = model.fit(M.xy_split(rows.where("not is_test"), ["hour"], "value"))
    scored = fitted.transform(M.xy_split(rows.where("is_test"), ["hour"], None, ["event_id"]))
    return tidy(scored.select("event_id", "prediction"), 4)


@query("cart_stump", _STUMP)
def cart_stump(spark, sf):
    """A tree of one split: the cut with the least variance on both sides, and the means there."""
    return _stump(spark, sf, M.cart(maxDepth=1))


@query("gbt_one_round", _STUMP)
def gbt_one_round(spark, sf):
    """The first round of boosting is one tree on the label itself."""
    return _stump(spark, sf, M.boosted_trees(maxIter=1, maxDepth=1))


_X = """x AS (SELECT event_id, value AS y, hour(ts) + minute(ts) / 15.0::DOUBLE * 0.25 AS a, day(ts)::DOUBLE AS b,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS c, """ + f"{_number('event_id', 42)} / 4294967296.0 < 0.33 AS is_test FROM events)"


@query(
    "knn_regress",
    f"""WITH {_X}, f AS (SELECT {', '.join(f'round(avg({v}), 6) m{v}, round(stddev_pop({v}), 6) s{v}' for v in 'abc')} FROM x WHERE NOT is_test),
z AS (SELECT event_id, y, is_test, {', '.join(f'({v} - m{v}) / s{v} AS {v}' for v in 'abc')} FROM x, f),
p AS (SELECT q.event_id, t.event_id AS id, t.y, (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c) AS d
  FROM z q, z t WHERE q.is_test AND NOT t.is_test),
n AS (SELECT event_id, unnest(min_by(y, (d, id), 5)) AS y FROM p GROUP BY 1)
SELECT event_id, {rnd('avg(y)', 4)} AS prediction FROM n GROUP BY 1""",
)
def knn_query(spark, sf):
    return _nearest(spark, sf, FEATURES, 512)


def _nearest(spark, sf, features, tile_rows):
    rows = hash_split(_samples(spark, sf), 0.33, ["event_id"])
    train = rows.where("not is_test")
    fit = fit_standard(train, features)
    fit = fit.select(*[F.round(c, 6).alias(c) for c in fit.columns])
    scaled = standardise(rows, fit, features)
    near = knn_regress(
        scaled.where("not is_test"), scaled.where("is_test"), features, "label_value", "event_id", tile_rows=tile_rows
    )
    return tidy(near.select("event_id", "prediction"), 4)


@query(
    "knn_one_feature",
    f"""WITH {_X}, f AS (SELECT round(avg(a), 6) m, round(stddev_pop(a), 6) s FROM x WHERE NOT is_test),
z AS (SELECT event_id, y, is_test, (a - m) / s AS a FROM x, f),
p AS (SELECT q.event_id, t.event_id AS id, t.y, (q.a - t.a) * (q.a - t.a) AS d FROM z q, z t WHERE q.is_test AND NOT t.is_test),
n AS (SELECT event_id, unnest(min_by(y, (d, id), 5)) AS y FROM p GROUP BY 1)
SELECT event_id, {rnd('avg(y)', 4)} AS prediction FROM n GROUP BY 1""",
)
def knn_one_feature(spark, sf):
    """One feature, cut into small tiles by as many splits as it takes."""
    return _nearest(spark, sf, ["time"], 32)


def _lagged(spark, sf):
    hourly = stored(fill_missing(resample_mean(readings(spark, sf), HOUR, ["value"]), ["value"]), "hourly")
    lagged = lag_features(hourly, "value", [1, 2, 24], HOUR)
    return hourly, lagged.withColumns(calendar("ts"))


LAG_FEATURES = ["lag_1", "lag_2", "lag_24", "date", "hour"]


@query("grid_search")
def grid_search(spark, sf):
    _, rows = _lagged(spark, sf)
    split = M.xy_split(chrono_split(rows, 0.8), LAG_FEATURES, "value", ["is_train"])
    tree = M.cart()
    grid = ParamGridBuilder().addGrid(tree.maxDepth, [2, 4, 6]).build()
    records, _ = M.grid_search(split.where("is_train"), split.where("not is_train"), tree, grid)
    trials = spark.createDataFrame(records, "trial int, maxDepth int, mse double")
    return tidy(trials.withColumn("is_best", F.col("mse") == min(r["mse"] for r in records)), 4)


@query(
    "ridge_search",
    f"""WITH {GRID_HOUR}, f AS (SELECT series_id, ts, coalesce(v, 0) AS y, lag(coalesce(v, 0)) OVER (PARTITION BY series_id ORDER BY ts) AS x,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) - 1 AS n FROM r),
l AS (SELECT *, i <= floor(n * 0.8) AS is_train FROM f WHERE i > 0),
m AS (SELECT covar_pop(y, x) AS c, var_pop(x) AS v, stddev_pop(y) AS s, avg(x) AS mx, avg(y) AS my FROM l WHERE is_train),
trials(trial, a) AS (VALUES (0, 0.0::DOUBLE), (1, 10.0::DOUBLE), (2, 1000.0::DOUBLE)),
e AS (SELECT trial, a, avg((y - my - c / (v + a / s) * (x - mx)) ** 2) AS mse FROM trials, m, l WHERE NOT is_train GROUP BY trial, a)
SELECT trial::BIGINT AS trial, a AS "regParam", {rnd('mse', 3)} AS mse, mse = min(mse) OVER () AS is_best FROM e""",
)
def ridge_search(spark, sf):
    hourly = fill_missing(resample_mean(readings(spark, sf), HOUR, ["value"]), ["value"])
    rows = stored(lag_features(hourly, "value", [1], HOUR), "lagged")
    split = M.xy_split(chrono_split(rows, 0.8), ["lag_1"], "value", ["is_train"])
    ridge = M.linear(standardization=False)
    grid = ParamGridBuilder().addGrid(ridge.regParam, [0.0, 10.0, 1000.0]).build()
    records, _ = M.grid_search(split.where("is_train"), split.where("not is_train"), ridge, grid)
    trials = spark.createDataFrame(records, "trial int, regParam double, mse double")
    return tidy(trials.withColumn("is_best", F.col("mse") == min(r["mse"] for r in records)), 3)


@query(
    "direct_forecast_one_lag",
    f"""WITH {GRID_HOUR}, f AS (SELECT series_id, ts, coalesce(v, 0) AS value, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY series_id) AS n FROM r),
a AS (SELECT series_id, ts, i, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS j, count(*) OVER (PARTITION BY series_id) AS m
  FROM f WHERE i >= 4 AND i < n - 24),
p AS (SELECT a.series_id, a.j <= floor(a.m * 0.8) AS is_train, h.value AS x, l.value AS y, l.i - a.i AS step
  FROM a JOIN f h ON h.series_id = a.series_id AND h.i = a.i - 1 JOIN f l ON l.series_id = a.series_id AND l.i >= a.i AND l.i < a.i + 24),
w AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM p WHERE is_train)
SELECT series_id, {rnd('avg((y - c - b * x) ** 2)', 3)} AS mse FROM p, w WHERE NOT is_train AND step >= 6 GROUP BY 1""",
)
def direct_forecast_one_lag(spark, sf):
    hourly = fill_missing(resample_mean(readings(spark, sf), HOUR, ["value"]), ["value"])
    frames = sliding_frames(hourly, ["value"], "value", 4, 24, HOUR)
    _, _, errors = direct_forecast(frames, "value", [1], M.linear(), skip=6)
    return tidy(errors, 3)
