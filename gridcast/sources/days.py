"""A store of series by day: ranges of time and single days open their own folders only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.timecols import ntz
from gridcast.operators.columns import slice_inclusive


def write_days(df: DataFrame, path: str, ts: str = "ts", day: str = "day", mode: str = "errorifexists") -> None:
    """One folder per day of `ts`; a day too large for one task is split over several files."""
    df.withColumn(day, F.to_date(ts)).hint("rebalance", day).write.mode(mode).partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, ts: str = "ts", day: str = "day") -> DataFrame:
    """Rows from start to end, both included, as :func:`slice_inclusive` cuts them; other days are not opened."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where(F.col(day) >= F.to_date(ntz(start)))
    if end is not None:
        rows = rows.where(F.col(day) <= F.to_date(ntz(end)))
    if start is not None and end is not None:
        rows = slice_inclusive(rows, start, end, ts)
    elif start is not None:
        rows = rows.where(F.col(ts) >= ntz(start))
    elif end is not None:
        raise ValueError("an end needs a start")
    return rows


def on_days(rows: DataFrame, days: DataFrame, keys: tuple[str, ...] = (), day: str = "day") -> DataFrame:
    """Rows of the days (and keys) of a small table, such as the analog day.

    The days are known only when the query runs; Spark then prunes the store's
    folders by them, before it opens any other. It does so only for a side that
    a comparison has made smaller, so one that always holds is stated.
    """
    wanted = days.select(*keys, day).where(F.col(day) >= F.lit("0001-01-01").cast("date")).distinct()
    return rows.join(wanted, [*keys, day])
