"""Registration, table access and the result form that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """`events` as sensor readings: one series per event type."""
    return table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "value")


def readings_two(spark: SparkSession, sf: str) -> DataFrame:
    """`events` with a second measure, the number in its JSON text."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"),
        "ts",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("load"),
    )


def daily_users(spark: SparkSession, sf: str) -> DataFrame:
    """`events` as many daily series: sum of value per user and day, gaps as 0."""
    rows = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sum("value").alias("value")
    )
    return rows.select(F.col("user_id").cast("string").alias("series_id"), F.col("day").alias("ts"), "value")


def days_of(days: DataFrame) -> list[str]:
    """The names of all days from the first to the last one of a daily table."""
    span = days.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return [str(r.day) for r in span.select(F.explode(F.sequence("lo", "hi")).alias("day")).collect()]


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded half up, integers as bigint: independent of the order of sums."""
    out, scale = [], F.lit(10.0**digits)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.floor(F.col(name) * scale + 0.5) / scale).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def rnd(expr: str, digits: int = 6) -> str:
    """The SQL form of :func:`tidy` for a double: the same two operations."""
    return f"(floor(({expr}) * 1e{digits} + 0.5) / 1e{digits})"


GRID_15 = """
lim AS (SELECT event_type series_id, time_bucket(INTERVAL '15 minutes', min(ts)) lo,
               time_bucket(INTERVAL '15 minutes', max(ts)) hi FROM events GROUP BY 1),
g AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '15 minutes')) ts FROM lim),
b AS (SELECT event_type series_id, time_bucket(INTERVAL '15 minutes', ts) ts, avg(value) v,
             avg(CAST(json_extract(props, '$.k') AS DOUBLE)) k FROM events GROUP BY 1, 2),
r AS (SELECT g.series_id, g.ts, b.v, b.k FROM g LEFT JOIN b USING (series_id, ts))
"""

SPAN = "span AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events)"

GRID_HOUR = GRID_15.replace("15 minutes", "1 hour")
