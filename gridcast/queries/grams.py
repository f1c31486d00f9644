"""Models solved from sums of products, random search, and shuffled epochs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridcast.operators.columns import fill_missing
from gridcast.operators.epochs import shuffled_epochs
from gridcast.operators.forecast import lag_features
from gridcast.operators.frames import sliding_frames
from gridcast.operators.gram import Penalised, cross_validate_linear
from gridcast.operators.grid import resample_mean
from gridcast.operators.rank import chrono_split, row_ordinal
from gridcast.operators.sampling import hash_fold, hash_split
from gridcast.operators.search import Choice, Steps, draw_trials, linear_search
from gridcast.operators.stats import fold_summary
from gridcast.plans.direct import direct_forecast_all_steps
from gridcast.queries.learning import FEATURES, HOUR, _samples
from gridcast.queries.registry import GRID_15, GRID_HOUR, query, readings, rnd, table, tidy
from gridcast.queries.sampling import _number
from gridcast.session import stored

_SOFT = "sign({0}) * greatest(abs({0}) - l1, 0) / (1 + l2)"


def _summary(model: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{model}' AS model, '{m}' AS metric, {rnd(f'avg({m})', 4)} AS mean, {rnd(f'stddev_pop({m})', 4)} AS std FROM s WHERE model = '{model}'"
        for m in ("rmse", "r2", "mae")
    )


@query(
    "linear_cv",
    f"""WITH RECURSIVE x AS (SELECT value AS y, hour(ts) + minute(ts) / 15.0::DOUBLE * 0.25 AS a, day(ts)::DOUBLE AS b,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS c, {_number('event_id', 21)} % 10 AS fold FROM events WHERE NOT ({_number('event_id', 42)} / 4294967296.0 < 0.33)),
st AS MATERIALIZED (SELECT k, avg(y) AS my, {', '.join(f'avg({v}) AS m{v}, stddev_pop({v}) AS s{v}, covar_pop({v}, y) / stddev_pop({v}) AS y{v}' for v in 'abc')},
  corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM x, range(10) t(k) WHERE fold <> k GROUP BY k),
models(model, l1, l2) AS (VALUES ('linear', 0.0::DOUBLE, 0.0::DOUBLE), ('lasso', 1.0, 0.0), ('elastic_net', 0.5, 0.5)),
w(model, k, i, wa, wb, wc) AS (SELECT model, k, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM models, st UNION ALL
  SELECT model, k, i + 1, wa, wb, {_SOFT.format('(yc - ac * wa - bc * wb)')} FROM (
    SELECT * REPLACE ({_SOFT.format('(yb - ab * wa - bc * wc)')} AS wb) FROM (
      SELECT w.model, w.k, i, l1, l2, ab, ac, bc, ya, yb, yc, {_SOFT.format('(ya - ab * wb - ac * wc)')} AS wa, wb, wc
      FROM w JOIN models ON models.model = w.model JOIN st ON st.k = w.k WHERE i < 60))),
q AS (SELECT model, w.k, y, my + wa * (a - ma) / sa + wb * (b - mb) / sb + wc * (c - mc) / sc AS p FROM x JOIN st ON fold = st.k JOIN w ON w.k = st.k WHERE i = 60),
s AS (SELECT model, k, sqrt(avg((y - p) ** 2)) AS rmse, 1 - avg((y - p) ** 2) / var_pop(y) AS r2, avg(abs(y - p)) AS mae FROM q GROUP BY model, k)
"""
    + " UNION ALL ".join(_summary(m) for m in ("linear", "lasso", "elastic_net")),
)
def linear_cv(spark, sf):
    """Ten folds of three linear models on three features, all from one scan's sums of products."""
    rows = hash_split(_samples(spark, sf), 0.33, ["event_id"]).where("not is_test")
    models = {"linear": Penalised(), "lasso": Penalised(1.0, 1.0), "elastic_net": Penalised(1.0, 0.5)}
    scores = cross_validate_linear(hash_fold(rows, 10, ["event_id"]), models, FEATURES, "label_value")
    return tidy(fold_summary(scores, ["rmse", "r2", "mae"]), 4)


_ASIDE = " UNION ALL ".join(
    f"SELECT {e} AS e, y, a1, a2, a24, ('0x' || substr(md5(concat_ws('|', series_id, CAST(ts AS VARCHAR), '{7 + e}')), 1, 8))::BIGINT / 4294967296.0 < 0.2 AS aside FROM f"
    for e in range(2)
)
_DRAW = "(('0x' || substr(md5('3|' || i || '|{}'), 1, 12))::BIGINT * {}) >> 48"


@query(
    "random_search_ridge",
    f"""WITH {GRID_HOUR}, lagged AS (SELECT series_id, ts, coalesce(v, 0) AS y, lag(coalesce(v, 0), 1) OVER w AS a1, lag(coalesce(v, 0), 2) OVER w AS a2,
  lag(coalesce(v, 0), 24) OVER w AS a24 FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
f AS (SELECT * FROM lagged WHERE a24 IS NOT NULL), s AS ({_ASIDE}),
z AS (SELECT e, aside, y, 'lag_1' AS features, a1 AS x FROM s UNION ALL SELECT e, aside, y, 'lag_2', a2 FROM s UNION ALL SELECT e, aside, y, 'lag_24', a24 FROM s),
m AS (SELECT e, features, covar_pop(x, y) / var_pop(x) AS b, avg(x) AS mx, avg(y) AS my FROM z WHERE NOT aside GROUP BY e, features),
d AS (SELECT i, {_DRAW.format('alpha', 9)} AS a, {_DRAW.format('features', 3)} AS k FROM range(400) t(i)),
u AS (SELECT row_number() OVER (ORDER BY min(i)) - 1 AS trial, 0.25 * a AS alpha, ['lag_1', 'lag_2', 'lag_24'][k + 1] AS features FROM d GROUP BY a, k),
o AS (SELECT trial, alpha, u.features, m.e, avg((y - my - b / (1 + alpha) * (x - mx)) ** 2) AS error FROM u JOIN m ON m.features = u.features
  JOIN z ON z.e = m.e AND z.features = u.features WHERE trial < 5 AND aside GROUP BY trial, alpha, u.features, m.e),
p AS (SELECT trial, alpha, features, avg(error) AS error FROM o GROUP BY trial, alpha, features)
SELECT trial::BIGINT AS trial, alpha::DOUBLE AS alpha, features, {rnd('error', 3)} AS error, error = min(error) OVER () AS is_best FROM p""",
)
def random_search_ridge(spark, sf):
    """Five drawn settings of a ridge model, each on two draws of validation rows."""
    hourly = fill_missing(resample_mean(readings(spark, sf), HOUR, ["value"]), ["value"])
    rows = stored(lag_features(hourly, "value", [1, 2, 24], HOUR), "lagged")
    lags = [f"lag_{k}" for k in (1, 2, 24)]
    trials = draw_trials({"alpha": Steps(0.0, 2.0, 0.25), "features": Choice(tuple(lags))}, 5, seed=3)
    records = linear_search(rows, trials, dict(zip(lags, lags)), "value", ["series_id", "ts"], executions=2)
    made = [(r["trial"], r["alpha"], r["features"], r["error"], r["is_best"]) for r in records]
    return tidy(spark.createDataFrame(made, "trial long, alpha double, features string, error double, is_best boolean"), 3)


@query(
    "direct_forecast_all_steps",
    f"""WITH {GRID_15}, f AS (SELECT series_id, ts, coalesce(v, 0) AS value, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY series_id) AS n FROM r),
a AS (SELECT series_id, ts, i, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS j, count(*) OVER (PARTITION BY series_id) AS m
  FROM f WHERE i >= 4 AND i < n - 96),
p AS (SELECT a.j <= floor(a.m * 0.8) AS is_train, h.value AS x, l.value AS y, l.i - a.i AS step
  FROM a JOIN f h ON h.series_id = a.series_id AND h.i = a.i - 1 JOIN f l ON l.series_id = a.series_id AND l.i >= a.i AND l.i < a.i + 96),
w AS (SELECT step, regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM p WHERE is_train GROUP BY step)
SELECT step::BIGINT AS step, count(*)::BIGINT AS n, {rnd('avg((y - c - b * x) ** 2)', 4)} AS mse, {rnd('any_value(b)', 6)} AS slope,
  {rnd('any_value(c)', 4)} AS intercept FROM p JOIN w USING (step) WHERE NOT is_train GROUP BY step""",
)
def direct_forecast_all_steps_query(spark, sf):
    """The next day's 96 quarters, each from the last one seen, fitted at once."""
    grid = fill_missing(resample_mean(readings(spark, sf), timedelta(minutes=15), ["value"]), ["value"])
    frames = stored(sliding_frames(grid, ["value"], "value", 4, 96, timedelta(minutes=15)), "frames")
    weights, errors = direct_forecast_all_steps(chrono_split(frames, 0.8), "value", [1], 96, "is_train")
    fitted = spark.createDataFrame([(i, float(w[1]), float(w[0])) for i, w in enumerate(weights.T)], "step long, slope double, intercept double")
    found = errors.join(fitted, "step")
    return tidy(tidy(found.select("step", "n", "mse", "intercept"), 4).join(tidy(found.select("step", "slope")), "step"))


_FEISTEL = "event_id, epoch, n, half, k0, k1, k2, k3"


def _feistel_round(inner: str, key: str) -> str:
    mixed = f"(r * 40503 + {key})"
    return f"SELECT {_FEISTEL}, r AS l, xor(l, xor({mixed}, {mixed} >> half) & ((1::BIGINT << half) - 1)) AS r FROM ({inner})"


_WALK = "SELECT {0}, x >> half AS l, x & ((1::BIGINT << half) - 1) AS r FROM {1}"
for _key in ("k0", "k1", "k2", "k3"):
    _WALK = _feistel_round(_WALK, _key)
_KEYS = ", ".join(f"('0x' || substr(md5('100|' || e), {8 * i + 1}, 8))::BIGINT AS k{i}" for i in range(4))


@query(
    "shuffle_epochs",
    f"""WITH RECURSIVE o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS x, count(*) OVER () AS n FROM events),
e AS (SELECT e AS epoch, {_KEYS} FROM range(3) t(e)),
s AS (SELECT event_id, epoch, n, greatest((length(bin(greatest(n - 1, 1))) + 1) // 2, 1)::INTEGER AS half, k0, k1, k2, k3, x FROM o, e),
w({_FEISTEL}, x) AS (SELECT {_FEISTEL}, (l << half) | r FROM ({_WALK.format(_FEISTEL, 's')}) UNION ALL
  SELECT {_FEISTEL}, (l << half) | r FROM ({_WALK.format(_FEISTEL, 'w WHERE x >= n')}))
SELECT event_id, epoch::BIGINT AS epoch, (x // 128)::BIGINT AS batch, (x % 128)::BIGINT AS slot FROM w WHERE x < n""",
)
def shuffle_epochs(spark, sf):
    """Three epochs of all events in batches of 128."""
    rows = table(spark, sf, "events").select("event_id", "ts", F.lit(0).alias("all"))
    n = rows.count()
    numbered = stored(row_ordinal(rows, ["all"], tie="event_id").select("event_id", (F.col("ordinal") - 1).alias("number")), "numbered")
    return tidy(shuffled_epochs(numbered, n, 128, 3).select("event_id", "epoch", "batch", "slot"))
