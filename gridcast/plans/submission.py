"""Forecast of a day at fine steps to hourly amounts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame

from gridcast.operators.columns import threshold_to_zero
from gridcast.operators.grid import block_sum, bucket_sum


def hourly_submission(
    forecast: DataFrame, value: str = "prediction", keys: Sequence[str] = ("series_id",), limit: float | None = 0.01
) -> DataFrame:
    """Small values to 0, then the sum of each hour."""
    kept = forecast if limit is None else threshold_to_zero(forecast, [value], limit)
    return bucket_sum(kept, timedelta(hours=1), [value], keys)


def keyless_submission(
    lines: DataFrame,
    value: str = "value",
    size: int = 4,
    keys: Sequence[str] = ("source_file",),
    limit: float | None = 0.01,
    strict: bool = True,
) -> DataFrame:
    """The same for numbered lines without a time: blocks of `size` lines."""
    kept = lines if limit is None else threshold_to_zero(lines, [value], limit)
    return block_sum(kept, value, size, "pos", keys, strict)
