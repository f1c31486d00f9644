"""Joins of series with other tables.

Between tables there are no broadcast hints: Spark broadcasts a side whose
measured size is below the session's threshold and shuffles otherwise,
splitting skewed partitions. Only :func:`attach` broadcasts, after measuring.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.session import frozen, scratch_table, shuffle_partitions

#: Measured bytes up to which a small table is broadcast.
BROADCAST_BYTES = 32 << 20
#: A column of fixed width, with its share of the row's overhead and of the hash table.
CELL_BYTES = 32
#: A text or array where only the number of rows is known; keys of series are far shorter.
VARIED_BYTES = 1024


def _width(kind: T.DataType) -> int:
    """Bytes that a value takes in a broadcast table; text and arrays count as `VARIED_BYTES`."""
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind.fields)
    return VARIED_BYTES if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else CELL_BYTES


def measured_bytes(small: DataFrame) -> int:
    """Bytes of a stored table, by reading it."""
    text = F.octet_length(F.to_json(F.struct(*small.columns)))
    n, size = small.agg(F.count("*"), F.sum(text)).first()
    return n * CELL_BYTES * len(small.columns) + (size or 0)


def attach(
    rows: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    known_rows: int | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a small table, such as one row per series or date, without moving the rows.

    Unless the number of its rows is known, the small table is computed once,
    frozen and measured. Up to `limit` bytes it is broadcast, so a series with
    most of the rows stays spread out; a larger table is joined by shuffle,
    where skewed partitions are split.
    """
    if known_rows is None:
        small = frozen(small)
        size = measured_bytes(small)
    else:
        size = known_rows * _width(small.schema)
    if size <= limit:
        small = F.broadcast(small)
    return rows.join(small, list(keys), how)


def co_located(df: DataFrame, keys: Sequence[str] = ("series_id", "ts"), buckets: int | None = None) -> DataFrame:
    """The rows as a table bucketed and sorted by these keys, in the shared folder.

    Tables of the same keys and number of buckets are aligned, sampled and
    matched without moving their rows again: the shuffle is paid once, when they
    are written. `buckets` is by default the session's number of shuffle
    partitions.
    """
    spark = df.sparkSession
    number = buckets or shuffle_partitions(spark)
    name, path = scratch_table(spark, "co_located")
    dealt = df.repartition(number, *keys)  # one file per bucket
    dealt.write.bucketBy(number, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys; N:M keys give every combination."""
    return left.join(right, list(keys), "inner")


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, failing at run time if a key occurs twice.

    The aggregation leaves rows partitioned by the key, as a following join on
    the key needs them.
    """
    rest = [c for c in df.columns if c not in keys]
    merged = df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], F.count("*").alias("_n"))
    message = F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*keys)))
    single = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return merged.where(single).drop("_n")


def align_full(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("series_id", "ts"), check: bool = True
) -> DataFrame:
    """Rows of both tables side by side on their time key, none left out."""
    if check:
        left, right = unique_by(left, keys), unique_by(right, keys)
    return left.join(right, list(keys), "full")


def sample_at(
    bins: DataFrame,
    source: DataFrame,
    columns: Mapping[str, str],
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """Add the source's value at exactly each row's time, null where it has none.

    `columns` maps new names to source columns.
    """
    picked = source.select(*keys, ts, *[F.col(c).alias(n) for n, c in columns.items()])
    return bins.join(picked, [*keys, ts], "left")


def match_truth(
    truth: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("series_id", "ts")
) -> DataFrame:
    """Truth and prediction of the same key side by side."""
    return truth.join(predicted, list(keys), "inner")
