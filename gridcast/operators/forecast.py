"""Recursive forecasts: predict one step, append it, go on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import timedelta

from pyspark.ml import PipelineModel
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.timecols import at_micros, grid_pos, micros, step_micros
from gridcast.operators.align import attach
from gridcast.operators.boosting import BoostedTrees
from gridcast.operators.grid import CHUNK, grid_shift
from gridcast.session import frozen


def lag_features(
    df: DataFrame,
    value: str,
    lags: Sequence[int],
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add lag_k, the value k grid steps earlier; rows without every lag are cut."""
    shifts = {f"lag_{k}": (value, -k) for k in lags}
    return grid_shift(df, shifts, step, keys, ts, chunk).dropna(subset=list(shifts))


def latest_state(
    df: DataFrame,
    value: str,
    length: int,
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """Last `length` values of each series as one array, oldest first: keys, last_ts, state.

    A value belongs to the tail by its time, so only `length` rows of a series
    are gathered. A gap, or a series shorter than that, counts as 0.
    """
    ends = df.groupBy(*keys).agg(F.max(ts).alias("last_ts"))
    place = grid_pos(ts, step) - grid_pos("last_ts", step) + (length - 1)
    # one value bounds the scan: the tail of the series that ends first
    oldest = df.groupBy(*keys).agg(F.max(ts).alias("e")).agg(F.min("e").alias("e"))
    since = oldest.select(at_micros(micros("e") - length * step_micros(step)).alias("since")).scalar()
    recent = (
        attach(df.where(F.col(ts) >= since), ends, keys)
        .withColumn("_place", place)
        .where("_place >= 0")
        .withColumn("_place", F.col("_place").cast("int"))
        .groupBy(*keys, "last_ts")
        .agg(F.map_from_entries(F.collect_list(F.struct("_place", value))).alias("_m"))
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0.0)),
    )
    return recent.select(*keys, "last_ts", filled.alias("state"))


def _as_rows(df: DataFrame, horizon: int, step: timedelta, keys: Sequence[str], ts: str) -> DataFrame:
    """Array of forecasts per series to rows (keys, step, ts, prediction)."""
    steps = df.select(*keys, "last_ts", F.posexplode(F.slice("state", -horizon, horizon)).alias("_i", "prediction"))
    when = at_micros(micros("last_ts") + (F.col("_i") + 1) * F.lit(step_micros(step)).cast("bigint"))
    return steps.select(*keys, (F.col("_i") + 1).alias("step"), when.alias(ts), "prediction")


def recursive_linear(
    state: DataFrame,
    lags: Sequence[int],
    weights: Sequence[float] | DenseVector,
    intercept: float,
    horizon: int,
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """Forecast `horizon` steps of every series with one linear model on lags.

    The recursion runs inside one row per series, without a shuffle.
    """
    pairs = [(int(k), float(w)) for k, w in zip(lags, weights)]

    def linear(past, _):
        value = F.lit(float(intercept))
        for k, w in pairs:
            value = value + F.element_at(past, -k) * w
        return value

    return recursive_value(state, linear, horizon, step, keys, ts)


def recursive_value(
    state: DataFrame,
    value: Callable[[Column, Column], Column],
    horizon: int,
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """Forecast `horizon` steps; `value` gives the next one from all before it (an array) and its time.

    One expression over one row per series: no job, shuffle or plan grows with the steps.
    """
    us = F.lit(step_micros(step)).cast("bigint")

    def advance(past, i):
        return F.concat(past, F.array(value(past, at_micros(micros("last_ts") + i * us)).cast("double")))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("state"), advance)
    return _as_rows(state.withColumn("state", grown), horizon, step, keys, ts)


def recursive_trees(
    state: DataFrame,
    model: BoostedTrees,
    features: Callable[[Column, Column], Mapping[str, Column]],
    horizon: int,
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """Forecast with boosted trees, compiled into the recursion.

    `features` gives the model's features from the values so far and the time to predict.
    """
    return recursive_value(state, lambda past, at: model.value(features(past, at).__getitem__), horizon, step, keys, ts)


def recursive_model(
    state: DataFrame,
    model: PipelineModel,
    features,
    horizon: int,
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    cut_every: int = 10,
) -> DataFrame:
    """Forecast with any fitted model, one `transform` over all series per step.

    `features` maps the frame with `state` (array) and `ts` (time to predict) to
    one with the model's input columns. The plan grows by one step per round
    and is cut every `cut_every` rounds.
    """
    us = F.lit(step_micros(step)).cast("bigint")
    now = state
    for i in range(1, horizon + 1):
        dated = now.withColumn(ts, at_micros(micros("last_ts") + i * us))
        scored = model.transform(features(dated))
        now = scored.select(
            *keys, "last_ts", F.concat("state", F.array(F.col("prediction").cast("double"))).alias("state")
        )
        if i % cut_every == 0 and i < horizon:
            now = frozen(now)
    return _as_rows(now, horizon, step, keys, ts)
