"""Analog day: the past day whose hourly profile is nearest to a forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.values import fill_zero
from gridcast.operators.align import attach
from gridcast.operators.scale import fit_minmax, minmax
from gridcast.session import frozen


def in_season(ts: str, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Rows from one (month, day) to another within a year, both included."""
    day = F.month(ts) * 100 + F.dayofmonth(ts)
    return day.between(first[0] * 100 + first[1], last[0] * 100 + last[1])


def day_distances(
    candidates: DataFrame,
    target: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "ts",
    scale_target: bool = True,
) -> DataFrame:
    """Mean squared distance of every candidate day to the target profile.

    `target` has `hour` and the features, one row per hour. The scaler is
    fitted on the target and applied to both sides; ``scale_target=False``
    compares scaled candidates with the target in its own unit. Only days with
    a row for every target hour are compared.
    """
    profile = frozen(target.select("hour", *[fill_zero(f).alias(f) for f in features]))
    wanted = profile.count()
    fit = fit_minmax(profile, features)
    goal = minmax(profile, fit, features) if scale_target else profile
    goal = goal.select("hour", *[F.col(f).alias(f"_t_{f}") for f in features])
    hours = candidates.select(
        *keys, F.to_date(ts).alias("day"), F.hour(ts).alias("hour"), *[fill_zero(f).alias(f) for f in features]
    )
    near = attach(minmax(hours, fit, features), goal, ["hour"], "inner", known_rows=wanted)
    squares = [(F.col(f) - F.col(f"_t_{f}")) * (F.col(f) - F.col(f"_t_{f}")) for f in features]
    row = sum(squares[1:], squares[0]) / F.lit(float(len(features)))
    return (
        near.groupBy(*keys, "day")
        .agg(F.avg(row).alias("mse"), F.count("*").alias("_n"))
        .where(F.col("_n") == wanted)
        .drop("_n")
    )


def analog_day(distances: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The nearest candidate; among equals the first in (day, keys) order."""
    return distances.orderBy("mse", "day", *keys).limit(1)
