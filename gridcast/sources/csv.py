"""CSV scans and sinks. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridcast.functions.timecols import parse_offset_time
from gridcast.functions.values import base_name
from gridcast.operators.rank import bucketed_rank
from gridcast.sources.schemas import SOLAR_OUTPUT_TEXT

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    header: bool = True,
    time_format: str | None = None,
    with_source: bool = False,
) -> DataFrame:
    """Rows of one file, a folder or a glob, stacked. Empty text and NaN are missing.

    `with_source` adds the base name of the file as `source_file`.
    """
    reader = spark.read.schema(schema).option("header", header).option("nullValue", "NaN")
    if time_format is not None:
        reader = reader.option("timestampNTZFormat", time_format)
    df = reader.csv(path)
    return df.withColumn("source_file", base_name("_metadata.file_path")) if with_source else df


def read_keyed_csv(
    spark: SparkSession, path: str | list[str], schema: StructType, series: str | None = None, **options
) -> DataFrame:
    """A scan whose rows have a time key; a file of one station gets `series` as its key."""
    df = read_csv(spark, path, schema, **options)
    return df if series is None else df.withColumn("series_id", F.lit(series))


def read_solar_output(spark: SparkSession, path: str | list[str], series: str, header: bool = False) -> DataFrame:
    """15-minute output with offset times, kept as local wall clock: series_id, ts, result."""
    text = read_csv(spark, path, SOLAR_OUTPUT_TEXT, header=header)
    return text.select(F.lit(series).alias("series_id"), parse_offset_time("datetime").alias("ts"), "result")


def _as_latin1(name: str) -> str:
    return name.encode("euc-kr").decode("latin-1")


JVM_CHARSETS = "spark.sql.legacy.javaCharsets"


@contextmanager
def _any_charset(spark: SparkSession) -> Iterator[None]:
    """Expressions built inside may code text in any charset of the JVM; they stay so when the setting is put back."""
    before = spark.conf.get(JVM_CHARSETS, "false")
    spark.conf.set(JVM_CHARSETS, "true")
    try:
        yield
    finally:
        spark.conf.set(JVM_CHARSETS, before)


def _recode(column: str, source: str, target: str, in_python: bool) -> Column:
    """The text whose bytes in `target` are the given text's bytes in `source`."""
    if not in_python:
        return F.decode(F.encode(F.col(f"`{column}`"), source), target)

    @F.pandas_udf(StringType())
    def recode(text: pd.Series) -> pd.Series:
        return text.str.encode(source).str.decode(target)

    return recode(F.col(f"`{column}`"))


def read_korean_csv(
    spark: SparkSession,
    path: str | list[str],
    headers: Mapping[str, str],
    schema: StructType,
    check_header: bool = True,
    in_python: bool = False,
) -> DataFrame:
    """A header CSV in EUC-KR, renamed by `headers` (file header → column of `schema`).

    EUC-KR never uses a comma, quote or newline inside a character, so the
    bytes are split as Latin-1 (large files stay splittable) and only text
    columns are decoded: by the JVM, or with `in_python` in Arrow batches, where a
    JVM lacks the charset. The header is compared with the expected one by the scan
    itself.
    """
    fields = {f.name: f for f in schema}
    raw = StructType([StructField(_as_latin1(h), fields[n].dataType, True) for h, n in headers.items()])
    df = (
        spark.read.schema(raw)
        .option("header", True)
        .option("enforceSchema", not check_header)
        .option("encoding", "ISO-8859-1")
        .option("nullValue", "NaN")
        .csv(path)
        .toDF(*headers.values())
    )
    texts = [n for n in headers.values() if isinstance(fields[n].dataType, StringType)]
    with _any_charset(spark):
        return df.withColumns({n: _recode(n, "ISO-8859-1", "EUC-KR", in_python) for n in texts}) if texts else df


def write_korean_csv(df: DataFrame, path: str, mode: str = "errorifexists", in_python: bool = False) -> None:
    """Header CSV in EUC-KR, the form :func:`read_korean_csv` reads."""
    with _any_charset(df.sparkSession):
        encoded = df.select(
            *[
                (_recode(n, "EUC-KR", "ISO-8859-1", in_python) if kind == "string" else F.col(f"`{n}`")).alias(_as_latin1(n))
                for n, kind in df.dtypes
            ]
        )
    encoded.write.mode(mode).option("header", True).option("encoding", "ISO-8859-1").option(
        "nullValue", "NaN"
    ).csv(path)


def read_ordered_numbers(
    spark: SparkSession, path: str | list[str], name: str = "value"
) -> DataFrame:
    """A headerless single-column file: source_file, pos (1-based line number), value.

    Lines are numbered inside the blocks the scan splits a file into, and the
    counts of the blocks before are added.
    """
    schema = StructType([StructField(name, DoubleType(), True)])
    lines = (
        spark.read.schema(schema)
        .option("header", False)
        .option("nullValue", "NaN")
        .csv(path)
        .select(
            base_name("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_line"),
            name,
        )
    )
    numbered = bucketed_rank(lines, [("_block", F.col("_at"))], [F.col("_line")], ["source_file"], "pos")
    return numbered.select("source_file", "pos", name)


def number_across_files(lines: DataFrame, pos: str = "pos") -> DataFrame:
    """Numbered lines of files that continue each other by name, numbered as one run."""
    sizes = lines.groupBy("source_file").agg(F.max(pos).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return lines.join(starts, "source_file").withColumn(pos, F.col("_start") + F.col(pos)).drop("_start")


def write_csv(
    df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists", time_format: str = TIME_FORMAT
) -> None:
    """CSV with missing values as NaN."""
    df.write.mode(mode).option("header", header).option("nullValue", "NaN").option(
        "timestampNTZFormat", time_format
    ).csv(path)


def write_per_source(df: DataFrame, path: str, by: str = "source_file", mode: str = "errorifexists") -> None:
    """One folder per source. A source too large for one task is split over several files."""
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).option("header", True).option(
        "nullValue", "NaN"
    ).option("timestampNTZFormat", TIME_FORMAT).csv(path)


def write_ordered_numbers(
    df: DataFrame, path: str, value: str, order: Sequence[str | Column], mode: str = "errorifexists"
) -> None:
    """One column without header in the given order.

    The rows are sorted by ranges: a short result is one file, a long one is a
    run of files whose names sort in row order.
    """
    df.orderBy(*order).select(F.format_string("%.18e", F.col(value)).alias(value)).write.mode(mode).option(
        "header", False
    ).csv(path)
