"""Forecast of many series at once: walk-forward segments, one model, recursive steps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators.columns import fill_missing
from gridcast.operators.forecast import lag_features, latest_state, recursive_linear
from gridcast.operators.frames import walk_forward_segments
from gridcast.operators.grid import resample_mean
from gridcast.operators.models import xy_split
from gridcast.operators.scale import fit_log_mean, log_demean, log_demean_inverse
from gridcast.operators.stats import error_metrics
from gridcast.session import stored

DAY = timedelta(days=1)


def every_day(days: DataFrame, value: str = "value", keys: Sequence[str] = ("series_id",), ts: str = "ts") -> DataFrame:
    """Every day of every series, from the first to the last day of the whole table, missing values as 0.

    The days are laid out along the time axis: no plan, schema or task grows a
    column per day.
    """
    rows = days.select(*keys, F.col(ts).cast("timestamp_ntz").alias(ts), value)
    span = rows.agg(F.struct(F.min(ts).alias("a"), F.max(ts).alias("z")).alias("s")).scalar()
    bounds = rows.select(*keys).distinct().select(*keys, span["a"].alias("first_ts"), span["z"].alias("last_ts"))
    grid = resample_mean(rows, DAY, [value], keys, ts, bounds)
    return fill_missing(grid.withColumn(ts, F.col(ts).cast("date")), [value])


def segment_values(
    daily: DataFrame, horizon: int, keys: Sequence[str] = ("series_id",), span=None
) -> DataFrame:
    """Values as log1p less the mean of their history segment: keys, ts, part, segment, value, scaled.

    `part` is train or val; both the history and the target of a part use the
    mean of that part's history.
    """
    rows = walk_forward_segments(daily, horizon, span=span).withColumn(
        "part", F.substring_index("segment", "_", 1)
    )
    means = fit_log_mean(rows, "value", F.col("segment").endswith("_history"), [*keys, "part"])
    return log_demean(rows, means, "value", [*keys, "part"], "scaled")


def fit_autoregression(
    segments: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("series_id",), **params
) -> LinearRegressionModel:
    """One linear model on lags, fitted on the training targets of all series.

    Lags of a target row come from the true values before it.
    """
    train = segments.where(F.col("part") == "train")
    lagged = lag_features(train, "scaled", lags, DAY, keys).where(F.col("segment") == "train_target")
    return LinearRegression(**params).fit(xy_split(lagged, [f"lag_{k}" for k in lags], "scaled"))


def forecast_validation(
    segments: DataFrame,
    lags: Sequence[int],
    weights: Sequence[float],
    intercept: float,
    horizon: int,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Recursive forecast of the validation target, in the data's unit."""
    history = segments.where(F.col("segment") == "val_history").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    state = latest_state(history, "scaled", max(lags), DAY, keys)
    ahead = recursive_linear(state, lags, weights, intercept, horizon, DAY, keys)
    means = history.groupBy(*keys).agg(F.max("log_mean").alias("log_mean"))
    return log_demean_inverse(ahead.join(means, list(keys)), "prediction")


def forecast_many(
    daily: DataFrame, horizon: int, lags: Sequence[int], keys: Sequence[str] = ("series_id",), **params
) -> tuple[LinearRegressionModel, DataFrame, DataFrame]:
    """Model, forecast rows with their truth, and the errors over all series.

    The segments feed the fit, the forecast and the scoring, so they are stored.
    """
    segments = stored(segment_values(daily, horizon, keys), "segments")
    model = fit_autoregression(segments, lags, keys, **params)
    ahead = forecast_validation(segments, lags, model.coefficients, model.intercept, horizon, keys)
    truth = segments.where(F.col("segment") == "val_target").select(
        *keys, F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("truth")
    )
    scored = ahead.join(truth, [*keys, "ts"], "left")
    return model, scored, error_metrics(scored)
