"""Projections, casts, fills, filters and reshaping of whole frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions import values as V
from gridcast.functions.timecols import at_micros, micros, ntz


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; a name that is not there is an error."""
    unknown = sorted(set(columns) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*columns)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; names that are not there are left out."""
    return df.withColumnsRenamed(dict(mapping))


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast; doubles become integers by cutting toward zero."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def add_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in constants.items()})


def clip_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: V.clip_negative(c) for c in columns})


def threshold_to_zero(df: DataFrame, columns: Sequence[str], limit: float = 0.01) -> DataFrame:
    return df.withColumns({c: V.threshold_zero(c, limit) for c in columns})


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN to 0."""
    return df.withColumns({c: V.fill_zero(c) for c in columns})


def keep_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def keep_positive(df: DataFrame, column: str) -> DataFrame:
    return df.where((F.col(column) > 0) & ~F.isnan(F.col(column).cast("double")))


def _range_end(end: str) -> tuple[Column, bool]:
    """End of a range; a date alone stands for the whole of its day."""
    if len(end.strip()) == 10:
        return at_micros(micros(ntz(end)) + 86_400_000_000), False
    return ntz(end), True


def slice_inclusive(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included."""
    limit, closed = _range_end(end)
    upper = F.col(ts) <= limit if closed else F.col(ts) < limit
    return df.where((F.col(ts) >= ntz(start)) & upper)


def drop_holdout(
    df: DataFrame, ranges: Sequence[tuple[str, str]], ts: str = "ts", closed: str = "neither"
) -> DataFrame:
    """Take hold-out ranges out of the training rows.

    By default both ends are open, so the row exactly at the start of a range
    stays; ``closed="left"`` removes it as well.
    """
    if closed not in ("neither", "left"):
        raise ValueError(f"closed must be 'neither' or 'left', got {closed!r}")
    t = F.col(ts)
    inside = [
        ((t >= ntz(a)) if closed == "left" else (t > ntz(a))) & (t < ntz(b)) for a, b in ranges
    ]
    return df.where(V.all_of([~r for r in inside]))


def unpivot(
    df: DataFrame, key: str, columns: Sequence[str] | None = None, time: str = "ts", value: str = "value"
) -> DataFrame:
    """One row per series, one column per time → one row per series and time.

    Column names are the times; cells without a value stay as nulls.
    """
    columns = [c for c in df.columns if c != key] if columns is None else list(columns)
    return df.unpivot(key, columns, time, value).withColumn(time, F.col(time).cast("date"))


def pivot(
    df: DataFrame, key: str, times: Sequence[str], time: str = "ts", value: str = "value"
) -> DataFrame:
    """Long rows to one column per listed time, the inverse of :func:`unpivot`."""
    return df.groupBy(key).pivot(time, list(times)).agg(F.first(value))


def range_bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last time of the whole table."""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name, keeping duplicates."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def repeat_rows(
    df: DataFrame, times: int, step: timedelta, ts: str = "ts"
) -> DataFrame:
    """Each row `times` times, `step` apart: coarse values carried on a finer grid."""
    us = step // timedelta(microseconds=1)
    copies = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn(ts, at_micros(micros(ts) + F.col("_i") * us)).drop("_i")
