"""JSON pages that another job has landed, and small frames typed in by hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def read_json_pages(
    spark: SparkSession, path: str | list[str], schema: StructType | str, items: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Landed JSON pages; `items` names the (nested) array whose elements become rows."""
    pages = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return pages if items is None else pages.select(F.inline(items))


def landed_pages(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the pages landed below `path`, one folder `page=N` each, as the store lists them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    return sorted(int(n[5:]) for n in names if n.startswith("page=") and n[5:].isdigit())


def read_numbered_pages(
    spark: SparkSession, path: str, schema: StructType | str, items: str | None = None, after: int | None = None, last: int | None = None
) -> DataFrame:
    """Landed JSON pages in folders `page=N`, with their number as `page`; `items` names the array whose elements become rows.

    Only pages behind `after` are opened, up to `last` (the largest landed one),
    so a job goes on where the one before it ended. Pages are numbered without
    gaps: a missing one is an error that names it.
    """
    landed = landed_pages(spark, path)
    first = (landed[0] if landed else 1) if after is None else after + 1
    last = max(landed, default=first - 1) if last is None else last
    missing = sorted(set(range(first, last + 1)) - set(landed))
    if missing:
        names = ", ".join(map(str, missing[:10])) + (f" and {len(missing) - 10} more" if len(missing) > 10 else "")
        raise FileNotFoundError(f"pages not landed below {path}: {names}")
    given = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    pages = spark.read.schema(StructType([*given.fields, StructField("page", IntegerType())])).json(path)
    pages = pages.where((F.col("page") >= first) & (F.col("page") <= last))  # prunes folders
    return pages if items is None else pages.select("page", F.inline(items))


def parse_json(df: DataFrame, column: str, schema: StructType | str, name: str | None = None) -> DataFrame:
    """JSON text column to a struct; text that is not JSON becomes null."""
    return df.withColumn(name or column, F.from_json(F.col(column), schema))


def hourly_profile(
    spark: SparkSession, measures: dict[str, Sequence[float]], hours: int = 24
) -> DataFrame:
    """A forecast profile of `hours` rows: hour and measures.

    A measure given at coarser steps (8 values for 24 hours) is repeated.
    """
    for name, given in measures.items():
        if len(given) == 0 or hours % len(given):
            raise ValueError(f"{name}: {len(given)} values do not divide {hours} hours")
    rows = [
        (h, *[float(given[h // (hours // len(given))]) for given in measures.values()]) for h in range(hours)
    ]
    schema = StructType(
        [StructField("hour", IntegerType(), False)]
        + [StructField(n, DoubleType(), True) for n in measures]
    )
    return spark.createDataFrame(rows, schema)
