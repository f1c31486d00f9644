from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridcast.functions.values import row_rmse
from gridcast.operators import stats as S
from gridcast.operators.frames import sequence_arrays
from gridcast.operators.grid import grid_shift, resample_mean
from gridcast.queries.registry import GRID_HOUR, query, readings, readings_two, rnd, table, tidy

HOUR = timedelta(hours=1)

MODEL_COLUMNS = ["price", "quantity", "discount", "tax", "month", "day"]

MODEL_ROWS = """m AS (SELECT l_extendedprice price, l_quantity quantity, l_discount discount, l_tax tax,
  month(l_shipdate)::DOUBLE AS month, day(l_shipdate)::DOUBLE AS day FROM lineitem)"""


def model_rows(spark, sf):
    """`lineitem` as a feature matrix with a label."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.month("l_shipdate").cast("double").alias("month"),
        F.dayofmonth("l_shipdate").cast("double").alias("day"),
    )


def _pairs():
    return [(a, b) for i, a in enumerate(MODEL_COLUMNS) for b in MODEL_COLUMNS[i + 1 :]]


@query(
    "corr_long",
    "WITH "
    + MODEL_ROWS
    + " UNION ALL ".join(f" SELECT '{a}' AS a, '{b}' AS b, {rnd(f'corr({a}, {b})')} AS r FROM m" for a, b in _pairs()),
)
def corr_long(spark, sf):
    return tidy(S.correlation(model_rows(spark, sf), MODEL_COLUMNS))


@query(
    "corr_target",
    "WITH "
    + MODEL_ROWS
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", {rnd(f'corr({c}, price)')} AS r FROM m" for c in MODEL_COLUMNS[1:]
    ),
)
def corr_target(spark, sf):
    return tidy(S.correlation_with(model_rows(spark, sf), "price", MODEL_COLUMNS))


_NICE = """x AS (SELECT value x FROM events WHERE value > 0), s AS (SELECT min(x) lo, max(x) hi FROM x),
c AS (SELECT lo, hi, (hi - lo) / 30 AS cell, power(10, floor(log10((hi - lo) / 30))) AS base FROM s),
w AS (SELECT lo, CASE
  WHEN 2 * base - cell < 1.5 * (cell - base) AND 5 * base - cell < 2.75 * (cell - 2 * base)
       AND 10 * base - cell < 1.5 * (cell - 5 * base) THEN 10 * base
  WHEN 2 * base - cell < 1.5 * (cell - base) AND 5 * base - cell < 2.75 * (cell - 2 * base) THEN 5 * base
  WHEN 2 * base - cell < 1.5 * (cell - base) THEN 2 * base ELSE base END AS width FROM c)"""


@query(
    "histogram_positive",
    f"""WITH {_NICE}, b AS (SELECT greatest(ceil(x / width - 1e-7) - 1, floor(lo / width + 1e-10)) AS cell, width FROM x, w)
SELECT {rnd('cell * width')} AS bin_start, {rnd('(cell + 1) * width')} AS bin_end, count(*)::BIGINT AS n
FROM b GROUP BY cell, width""",
)
def histogram_positive(spark, sf):
    return tidy(S.histogram(table(spark, sf, "events"), "value"))


@query(
    "nonnull_counts",
    "WITH " + GRID_HOUR + """SELECT 'series_id' AS "column", 'string' AS dtype, count(series_id)::BIGINT AS n FROM r
UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts) FROM r UNION ALL SELECT 'value', 'double', count(v) FROM r""",
)
def nonnull_counts(spark, sf):
    return S.column_info(resample_mean(readings(spark, sf), HOUR, ["value"]))


@query("row_shape", "SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def row_shape(spark, sf):
    return tidy(S.shape(table(spark, sf, "lineitem")))


@query(
    "column_stats",
    "WITH "
    + MODEL_ROWS
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS "column", {rnd(f'avg({c})', 4)} AS mean, {rnd(f'stddev_pop({c})', 4)} AS std,
  {rnd(f'min({c})', 4)} AS "min", {rnd(f'max({c})', 4)} AS "max" FROM m"""
        for c in MODEL_COLUMNS
    ),
)
def column_stats(spark, sf):
    return tidy(S.column_stats(model_rows(spark, sf), MODEL_COLUMNS), 4)


@query(
    "series_mean",
    f"SELECT event_type AS series_id, {rnd('avg(value)')} AS mean FROM events GROUP BY 1",
)
def series_mean(spark, sf):
    return tidy(S.series_mean(readings(spark, sf)))


_NAIVE = """p AS (SELECT series_id, ts, v truth, lag(v, 24) OVER (PARTITION BY series_id ORDER BY ts) prediction FROM r),
q AS (SELECT * FROM p WHERE truth IS NOT NULL AND prediction IS NOT NULL)"""


def naive_day(spark, sf):
    """Hourly truth beside the value a day before as its prediction."""
    hourly = resample_mean(readings(spark, sf), HOUR, ["value"])
    return grid_shift(hourly, {"prediction": ("value", -24)}, HOUR).withColumnRenamed("value", "truth")


@query(
    "metrics_all",
    f"""WITH {GRID_HOUR}, {_NAIVE} SELECT series_id, count(*)::BIGINT AS n, {rnd('avg((truth - prediction) ** 2)')} AS mse,
  {rnd('sqrt(avg((truth - prediction) ** 2))')} AS rmse, {rnd('avg(abs(truth - prediction))')} AS mae,
  {rnd('1 - sum((truth - prediction) ** 2) / (var_pop(truth) * count(*))')} AS r2,
  {rnd('avg((truth - prediction) ** 2) / 7028')} AS capacity_error FROM q GROUP BY 1""",
)
def metrics_all(spark, sf):
    return tidy(S.error_metrics(naive_day(spark, sf), by=["series_id"], capacity=7028))


@query(
    "metrics_mape",
    f"""WITH {GRID_HOUR}, {_NAIVE} SELECT series_id,
  {rnd('avg(CASE WHEN truth <> 0 THEN abs((truth - prediction) / truth) END) * 100', 4)} AS mape FROM q GROUP BY 1""",
)
def metrics_mape(spark, sf):
    rows = naive_day(spark, sf).dropna()
    return tidy(rows.groupBy("series_id").agg(S.mape(F.col("truth"), F.col("prediction")).alias("mape")), 4)


@query(
    "warmup_mse",
    f"""WITH {GRID_HOUR}, {_NAIVE}, s AS (SELECT *, (epoch_us(ts) // 3600000000) % 168 AS step FROM q)
SELECT series_id, {rnd('avg((truth - prediction) ** 2)')} AS mse FROM s WHERE step >= 50 GROUP BY 1""",
)
def warmup_mse(spark, sf):
    rows = naive_day(spark, sf).dropna()
    step = F.pmod(F.unix_date(F.to_date("ts")) * 24 + F.hour("ts"), F.lit(168))
    return tidy(S.warmup_mse(rows.withColumn("step", step), "truth", "prediction", by=["series_id"]))


@query(
    "row_rmse",
    f"""WITH {GRID_HOUR}, {_NAIVE} SELECT series_id, CAST(ts AS DATE) AS day, count(*)::BIGINT AS n,
  {rnd('sqrt(avg((truth - prediction) ** 2))')} AS rmse FROM q GROUP BY 1, 2""",
)
def row_rmse_query(spark, sf):
    rows = naive_day(spark, sf).dropna().withColumn("day", F.to_date("ts"))
    pairs = rows.withColumn("pair", F.struct("truth", "prediction"))
    daily = sequence_arrays(pairs, "pair", ["series_id", "day"])
    truth = F.transform("pair", lambda p: p["truth"])
    predicted = F.transform("pair", lambda p: p["prediction"])
    return tidy(daily.select("series_id", "day", F.size("pair").alias("n"), row_rmse(truth, predicted).alias("rmse")))


@query(
    "fold_summary",
    f"""WITH {GRID_HOUR}, {_NAIVE}, f AS (SELECT series_id, (epoch_us(ts) // 3600000000) % 10 AS fold,
  avg((truth - prediction) ** 2) mse, avg(abs(truth - prediction)) mae FROM q GROUP BY 1, 2)
SELECT series_id, 'mse' AS metric, {rnd('avg(mse)')} AS mean, {rnd('stddev_pop(mse)')} AS std FROM f GROUP BY 1
UNION ALL SELECT series_id, 'mae', {rnd('avg(mae)')}, {rnd('stddev_pop(mae)')} FROM f GROUP BY 1""",
)
def fold_summary(spark, sf):
    step = F.pmod(F.unix_date(F.to_date("ts")) * 24 + F.hour("ts"), F.lit(10))
    folds = S.error_metrics(naive_day(spark, sf).withColumn("fold", step), by=["series_id", "fold"])
    return tidy(S.fold_summary(folds, ["mse", "mae"], ["series_id"]))
