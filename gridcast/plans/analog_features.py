"""Model input for a coming day, taken from the past day most like its forecast."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.timecols import days_since
from gridcast.functions.values import all_of, clip_negative, fill_zero
from gridcast.operators.align import sample_at
from gridcast.operators.analog import analog_day, day_distances
from gridcast.operators.grid import grid_diff, resample_mean
from gridcast.plans.dataset import QUARTER


def analog_day_rows(readings: DataFrame, winner: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """The readings of the winning day.

    The winner is one row; its day and keys become conditions that reach the
    scan, so of all history one day of one series is read.
    """
    found = winner.select(*keys, "day").first()
    if found is None:
        return readings.where(F.lit(False))
    begin, end = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in (found["day"], found["day"] + timedelta(days=1)))
    own = [F.col(k) == F.lit(found[k]) for k in keys]
    return readings.where(all_of([F.col(ts) >= begin, F.col(ts) < end, *own]))


def forecast_features(
    day: DataFrame,
    measures: Sequence[str],
    differenced: Sequence[str],
    date: int,
    month: int,
    step: timedelta = QUARTER,
    keys: Sequence[str] = ("series_id",),
    year_start: str | None = None,
) -> DataFrame:
    """Grid features of one day, dated as the day to predict.

    Missing readings are 0 before the mean; a counter's negative step is 0. The
    day offset is that of the reading at exactly the bucket's start, 0 if none.
    """
    read = [*measures, *differenced]
    filled = day.withColumns({c: fill_zero(c) for c in read})
    grid = grid_diff(resample_mean(filled, step, read, keys), differenced, step, keys)
    anchor = year_start or F.make_timestamp_ntz(F.year("ts"), *[F.lit(v) for v in (1, 1, 0, 0, 0)])
    offsets = filled.select(*keys, "ts", days_since("ts", anchor).alias("difference")).dropDuplicates([*keys, "ts"])
    dated = sample_at(grid, offsets, {"difference": "difference"}, keys).withColumns(
        {
            "result": F.lit(0.0),
            "date": F.lit(date),
            "month": F.lit(month),
            "hour": F.hour("ts"),
            **{c: clip_negative(c) for c in differenced},
        }
    )
    return dated.withColumns({c: fill_zero(c) for c in [*read, "difference"]})


def analog_features(
    hourly: DataFrame,
    readings: DataFrame,
    target: DataFrame,
    profile: Sequence[str],
    measures: Sequence[str],
    differenced: Sequence[str],
    date: int,
    month: int,
    keys: Sequence[str] = ("series_id",),
    scale_target: bool = True,
) -> DataFrame:
    """Find the analog day among the hourly candidates and lay out its features."""
    winner = analog_day(day_distances(hourly, target, profile, keys, scale_target=scale_target), keys)
    day = analog_day_rows(readings, winner, keys)
    return forecast_features(day, measures, differenced, date, month, keys=keys)
