"""Regular time grids: bucket means with empty buckets kept, differences, leads.

A grid row is known by its cell number, which is plain arithmetic on the time.
Neighbour lookups therefore never need a whole series in one task: rows are
grouped into chunks of cells, and each chunk also gets the few rows of its
neighbours (the halo) that its own frames reach into.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.timecols import DAY, grid_pos, micros, pos_start, step_micros
from gridcast.functions.values import missing_to_null
from gridcast.operators.align import attach
from gridcast.session import shuffle_partitions

CHUNK = 4096


def time_bounds(df: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts") -> DataFrame:
    """First and last time of each series; rows count even when values are missing."""
    return df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def spine(
    bounds: DataFrame,
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    chunk: int = CHUNK,
    origin_us: Column | int = 0,
) -> DataFrame:
    """Every grid time between ``first_ts`` and ``last_ts`` of each series.

    One row per series is expanded in two steps with a shuffle in between, so
    that a single very long series is laid out by many tasks.
    """
    spark = bounds.sparkSession
    cells = bounds.select(
        *keys,
        F.lit(origin_us).cast("bigint").alias("_origin") if isinstance(origin_us, int) else origin_us.alias("_origin"),
        grid_pos("first_ts", step, origin_us).alias("_lo"),
        grid_pos("last_ts", step, origin_us).alias("_hi"),
    ).where(F.col("_lo").isNotNull())
    chunks = cells.select(
        *keys,
        "_origin",
        "_lo",
        "_hi",
        F.explode(F.sequence(F.floor(F.col("_lo") / chunk), F.floor(F.col("_hi") / chunk))).alias("_chunk"),
    ).repartition(shuffle_partitions(spark), *keys, "_chunk")
    pos = F.explode(
        F.sequence(
            F.greatest("_lo", F.col("_chunk") * chunk),
            F.least("_hi", F.col("_chunk") * chunk + (chunk - 1)),
        )
    ).alias("_pos")
    return chunks.select(*keys, "_origin", pos).select(
        *keys, pos_start(F.col("_pos"), step, F.col("_origin")).alias(ts)
    )


def resample_mean(
    df: DataFrame,
    step: timedelta,
    values: Sequence[str],
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    bounds: DataFrame | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Mean of each column per bucket; a bucket without rows is kept with nulls.

    The empty grid rows join the data as extra input of one aggregation: there
    is no join, and the means are combined before the shuffle. Pass `bounds`
    (keys, first_ts, last_ts) when they are known to save the narrow pass that
    finds them.

    Buckets start at midnight; a step that does not divide a day counts from
    the midnight before the first row of each series.
    """
    if bounds is None:
        bounds = time_bounds(df, keys, ts)
    measured = [missing_to_null(v).alias(v) for v in values]
    if DAY % step_micros(step) == 0:
        points = df.select(*keys, pos_start(grid_pos(ts, step), step).alias(ts), *measured)
        grid = spine(bounds, step, keys, ts, chunk)
    else:
        anchored = bounds.withColumn("_origin", micros(F.to_date("first_ts").cast("timestamp_ntz")))
        points = attach(df, anchored.select(*keys, "_origin"), keys).select(
            *keys,
            pos_start(grid_pos(ts, step, F.col("_origin")), step, F.col("_origin")).alias(ts),
            *measured,
        )
        grid = spine(anchored, step, keys, ts, chunk, F.col("_origin"))
    return (
        points.unionByName(grid, allowMissingColumns=True)
        .groupBy(*keys, ts)
        .agg(*[F.avg(v).alias(v) for v in values])
    )


def with_halo(df: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """Assign rows to chunks of `size` cells, with copies for neighbouring frames.

    A frame at cell p reaches from p - before to p + after. `_own` marks the
    one copy of a row that belongs to its chunk.
    """
    pos = F.col("_pos")
    targets = F.sequence(F.floor((pos - after) / size), F.floor((pos + before) / size))
    return df.withColumn("_chunk", F.explode(targets)).withColumn(
        "_own", F.col("_chunk") == F.floor(pos / size)
    )


def grid_shift(
    df: DataFrame,
    shifts: Mapping[str, tuple[str, int]],
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add the value found k grid steps later (k < 0: earlier), null if there is none.

    `shifts` maps a new column to (column, k). Times must be on the grid and
    unique per series; a gap in the grid gives null, not the next row's value.
    """
    back = max([0, *(-k for _, k in shifts.values())])
    ahead = max([0, *(k for _, k in shifts.values())])
    size = max(chunk, 4 * (back + ahead))
    order = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    placed = with_halo(df.withColumn("_pos", grid_pos(ts, step)), back, ahead, size)
    shifted = [F.max(c).over(order.rangeBetween(k, k)).alias(new) for new, (c, k) in shifts.items()]
    return placed.select("*", *shifted).where("_own").drop("_pos", "_chunk", "_own")


def grid_diff(
    df: DataFrame,
    columns: Sequence[str],
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    suffix: str = "",
    chunk: int = CHUNK,
) -> DataFrame:
    """Difference to the previous grid step; without `suffix` the column is replaced."""
    moved = grid_shift(df, {f"_prev_{c}": (c, -1) for c in columns}, step, keys, ts, chunk)
    changed = {f"{c}{suffix}": F.col(c) - F.col(f"_prev_{c}") for c in columns}
    return moved.withColumns(changed).drop(*[f"_prev_{c}" for c in columns])


def grid_lead(
    df: DataFrame,
    columns: Sequence[str],
    steps: int,
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    suffix: str = "_ahead",
    drop_tail: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """Value `steps` later as a new column; rows without a later row are cut.

    The cut looks at the row, not the value: a later row whose value is
    missing keeps its place with a null.
    """
    shifts = {f"{c}{suffix}": (c, steps) for c in columns}
    moved = grid_shift(
        df.withColumn("_here", F.lit(True)), {**shifts, "_there": ("_here", steps)}, step, keys, ts, chunk
    )
    return (moved.where("_there") if drop_tail else moved).drop("_here", "_there")


def bucket_sum(
    df: DataFrame,
    step: timedelta,
    values: Sequence[str],
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """Sum per bucket, for buckets that have rows."""
    points = df.select(*keys, pos_start(grid_pos(ts, step), step).alias(ts), *values)
    return points.groupBy(*keys, ts).agg(*[F.sum(v).alias(v) for v in values])


def block_sum(
    df: DataFrame, value: str, size: int, pos: str = "pos", keys: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """Sum of each block of `size` consecutive positions (1-based) of keyless rows.

    With `strict`, a block that is not complete is an error.
    """
    block = F.floor((F.col(pos) - 1) / size).cast("bigint")
    sums = df.groupBy(*keys, block.alias("block")).agg(F.sum(value).alias(value), F.count("*").alias("_n"))
    if strict:
        message = F.format_string(f"block %d has %d rows, not {size}", F.col("block"), F.col("_n"))
        complete = F.when(F.col("_n") == size, True).otherwise(F.raise_error(message).cast("boolean"))
        sums = sums.where(complete)
    return sums.drop("_n")


def calendar_ordinal(
    df: DataFrame, step: timedelta, start: str | Column, ts: str = "ts", name: str = "ordinal"
) -> DataFrame:
    """Position on a complete grid counted from `start` (0-based), by arithmetic."""
    start = F.lit(start).cast("timestamp_ntz") if isinstance(start, str) else start
    return df.withColumn(name, grid_pos(ts, step) - grid_pos(start, step))
