from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import scale as M
from gridcast.queries.registry import query, readings, rnd, tidy
from gridcast.queries.summaries import MODEL_COLUMNS, MODEL_ROWS, model_rows

_KEYS = "l_orderkey, l_linenumber::BIGINT AS l_linenumber"
_KEYED = MODEL_ROWS.replace("SELECT l_extendedprice", "SELECT l_orderkey, l_linenumber, l_extendedprice")


@query(
    "minmax_scale",
    f"""WITH {_KEYED} SELECT {_KEYS}, """
    + ", ".join(f"{rnd(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())')} AS {c}" for c in MODEL_COLUMNS)
    + " FROM m",
)
def minmax_scale(spark, sf):
    rows = model_rows(spark, sf)
    return tidy(M.minmax(rows, M.fit_minmax(rows, MODEL_COLUMNS), MODEL_COLUMNS))


@query(
    "minmax_train_rows",
    f"""WITH {_KEYED}, f AS (SELECT min(quantity) lo, max(quantity) hi, min(price) plo, max(price) phi FROM m WHERE month <= 8)
SELECT {_KEYS}, month::BIGINT AS month, {rnd('(quantity - lo) / (hi - lo)')} AS quantity, {rnd('(price - plo) / (phi - plo)')} AS price
FROM m, f""",
)
def minmax_train_rows(spark, sf):
    rows = model_rows(spark, sf).withColumn("month", F.col("month").cast("int"))
    fit = M.fit_minmax(rows, ["quantity", "price"], where=F.col("month") <= 8)
    return tidy(M.minmax(rows, fit, ["quantity", "price"]).select("l_orderkey", "l_linenumber", "month", "quantity", "price"))


@query(
    "minmax_inverse",
    f"""WITH {_KEYED} SELECT {_KEYS}, {rnd('price', 4)} AS prediction, {rnd('quantity', 4)} AS quantity,
  {rnd('(price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ())', 4)} AS scaled FROM m""",
)
def minmax_inverse(spark, sf):
    rows = model_rows(spark, sf)
    fit = M.fit_minmax(rows, ["price", "quantity"])
    scaled = M.minmax(rows, fit, ["price", "quantity"]).withColumnRenamed("price", "prediction")
    scaled = scaled.withColumn("scaled", F.col("prediction"))
    back = M.minmax_inverse(scaled, fit, {"prediction": "price", "quantity": "quantity"})
    return tidy(back.select("l_orderkey", "l_linenumber", "prediction", "quantity", "scaled"), 4)


@query(
    "standardise",
    f"""WITH {_KEYED} SELECT {_KEYS}, """
    + ", ".join(f"{rnd(f'({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER ())', 5)} AS {c}" for c in MODEL_COLUMNS)
    + " FROM m",
)
def standardise(spark, sf):
    rows = model_rows(spark, sf)
    return tidy(M.standardise(rows, M.fit_standard(rows, MODEL_COLUMNS), MODEL_COLUMNS), 5)


@query(
    "standardise_per_series",
    f"""WITH f AS (SELECT event_type series_id, avg(value) a, stddev_pop(value) s FROM events GROUP BY 1)
SELECT series_id, ts::TIMESTAMP AS ts, {rnd('(value - a) / s')} AS value FROM events JOIN f ON f.series_id = event_type""",
)
def standardise_per_series(spark, sf):
    rows = readings(spark, sf)
    return tidy(M.standardise(rows, M.fit_standard(rows, ["value"], by=["series_id"]), ["value"], ["series_id"]))


@query(
    "log_demean",
    f"""WITH f AS (SELECT event_type series_id, avg(ln(1 + value)) a FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1)
SELECT series_id, ts::TIMESTAMP AS ts, {rnd('ln(1 + value) - a')} AS scaled, {rnd('value')} AS value
FROM events JOIN f ON f.series_id = event_type""",
)
def log_demean(spark, sf):
    rows = readings(spark, sf)
    fit = M.fit_log_mean(rows, where=F.col("ts") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    scaled = M.log_demean(rows, fit, name="scaled")
    back = M.log_demean_inverse(scaled, "scaled", name="value")
    return tidy(back.select("series_id", "ts", "scaled", "value"))
