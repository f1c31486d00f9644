"""Scaling with statistics fitted on chosen rows.

A fit is a small DataFrame: one row, or one row per series. It serves the
transform and its inverse. A one-row fit enters a plan as a scalar subquery, a
per-series fit as a join with a table that is counted first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.values import log1p_filled, missing_to_null
from gridcast.operators.align import attach


def _fit(df: DataFrame, columns: Sequence[str], parts: dict, where: Column | None, by: Sequence[str]) -> DataFrame:
    rows = df if where is None else df.where(where)
    aggs = [f(missing_to_null(c)).alias(f"{name}_{c}") for c in columns for name, f in parts.items()]
    return rows.groupBy(*by).agg(*aggs)


def fit_minmax(
    df: DataFrame, columns: Sequence[str], where: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Smallest and largest value of each column over the rows that satisfy `where`."""
    return _fit(df, columns, {"min": F.min, "max": F.max}, where, by)


def fit_standard(
    df: DataFrame, columns: Sequence[str], where: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Mean and population deviation of each column over the rows that satisfy `where`."""
    return _fit(df, columns, {"mean": F.avg, "std": F.stddev_pop}, where, by)


def _with_fit(df: DataFrame, fit: DataFrame, by: Sequence[str], change) -> DataFrame:
    """Apply `change(stat)` where stat(name) gives a fitted value."""
    if not by:
        one = fit.select(F.struct(*fit.columns).alias("fit")).scalar()
        return df.withColumns(change(lambda name: one[name]))
    named = fit.select(*by, F.struct(*[c for c in fit.columns if c not in by]).alias("_fit"))
    return attach(df, named, by).withColumns(change(lambda name: F.col("_fit")[name])).drop("_fit")


def _range(stat, c: str) -> Column:
    """Width of the fitted range; a constant column counts as width 1."""
    low, high = stat(f"min_{c}"), stat(f"max_{c}")
    return F.when(high > low, high - low).otherwise(1.0)


def _deviation(stat, c: str) -> Column:
    return F.when(stat(f"std_{c}") > 0, stat(f"std_{c}")).otherwise(1.0)


def minmax(
    df: DataFrame, fit: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(x - min) / (max - min); values outside the fitted range leave [0, 1]."""
    return _with_fit(
        df, fit, by, lambda s: {c: (F.col(c) - s(f"min_{c}")) / _range(s, c) for c in columns}
    )


def minmax_inverse(
    df: DataFrame, fit: DataFrame, columns: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Back to the unit of the data. `columns` maps a scaled column to the fitted one."""
    return _with_fit(
        df,
        fit,
        by,
        lambda s: {c: F.col(c) * _range(s, of) + s(f"min_{of}") for c, of in columns.items()},
    )


def standardise(
    df: DataFrame, fit: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    return _with_fit(
        df, fit, by, lambda s: {c: (F.col(c) - s(f"mean_{c}")) / _deviation(s, c) for c in columns}
    )


def standardise_inverse(
    df: DataFrame, fit: DataFrame, columns: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    return _with_fit(
        df,
        fit,
        by,
        lambda s: {c: F.col(c) * _deviation(s, of) + s(f"mean_{of}") for c, of in columns.items()},
    )


def fit_log_mean(
    df: DataFrame, value: str = "value", where: Column | None = None, by: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Per-series mean of log1p(value) over the history rows, missing counted as 0."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*by).agg(F.avg(log1p_filled(value)).alias("log_mean"))


def log_demean(
    df: DataFrame, fit: DataFrame, value: str = "value", by: Sequence[str] = ("series_id",), name: str | None = None
) -> DataFrame:
    """log1p(value) less the history mean; keeps `log_mean` for the way back."""
    return attach(df, fit, by).withColumn(
        name or value, log1p_filled(value) - F.col("log_mean")
    )


def log_demean_inverse(df: DataFrame, value: str, mean: str = "log_mean", name: str | None = None) -> DataFrame:
    return df.withColumn(name or value, F.expm1(F.col(value) + F.col(mean)))
