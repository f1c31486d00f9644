"""Training set from sensor readings and output."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.timecols import calendar, days_since, wrap_year
from gridcast.functions.values import fill_zero
from gridcast.operators.align import align_full
from gridcast.operators.grid import grid_diff, resample_mean
from gridcast.sources.schemas import DIFFERENCED, MINUTE_MEASURES

QUARTER = timedelta(minutes=15)


def sensor_grid(
    readings: DataFrame,
    measures: Sequence[str] = MINUTE_MEASURES,
    differenced: Sequence[str] = DIFFERENCED,
    step: timedelta = QUARTER,
    keys: Sequence[str] = ("series_id",),
    per_source: bool = False,
) -> DataFrame:
    """Bucket means on a whole grid; counters as the step to the bucket before.

    With `per_source` each file is a grid of its own, so the first bucket of a
    file has no step; otherwise differences run on over the files.
    """
    by = [*keys, "source_file"] if per_source else list(keys)
    grid = resample_mean(readings, step, measures, by)
    return grid_diff(grid, differenced, step, by).drop("source_file")


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar(ts))


def with_day_offset(df: DataFrame, anchor: str, ts: str = "ts", name: str = "difference") -> DataFrame:
    """Days from the anchor, with one year taken off beyond a year."""
    return df.withColumn(name, wrap_year(days_since(ts, anchor)))


def build_dataset(
    readings: DataFrame,
    output: DataFrame,
    measures: Sequence[str] = MINUTE_MEASURES,
    differenced: Sequence[str] = DIFFERENCED,
    step: timedelta = QUARTER,
    anchor: str = "2019-01-01",
    keys: Sequence[str] = ("series_id",),
    per_source: bool = False,
) -> DataFrame:
    """Aligned output and sensor grid with calendar columns; missing values are 0."""
    grid = sensor_grid(readings, measures, differenced, step, keys, per_source)
    joined = align_full(output.select(*keys, "ts", "result"), grid, [*keys, "ts"])
    filled = joined.withColumns({c: fill_zero(c) for c in ["result", *measures]})
    return with_day_offset(with_calendar(filled), anchor)
