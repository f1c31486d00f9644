"""Training samples cut from sequences: sliding frames, random windows, segments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.timecols import grid_pos
from gridcast.functions.values import hash_number
from gridcast.operators.grid import CHUNK, with_halo


def sliding_frames(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    history: int,
    target: int,
    step: timedelta,
    stride: int = 1,
    single_step: bool = False,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    chunk: int = CHUNK,
) -> DataFrame:
    """One sample per grid row that has a whole history and a whole target.

    `history` holds the features of every `stride`-th of the rows before the
    anchor `ts`, oldest first; `labels` the anchor's own label and those that
    follow, `target` in all. With `single_step` there is one `label`, found
    `target` steps after the anchor. Input is a complete grid. An anchor also
    needs one row beyond its labels; the last one of a series is not used.

    Labels may reach past a split: choose anchors with :func:`anchors_between`.
    """
    pos = F.col("_pos")
    size = max(chunk, 4 * (history + target))
    narrow = df.select(*keys, ts, *dict.fromkeys([*features, label]), grid_pos(ts, step).alias("_pos"))
    placed = with_halo(narrow, history, target, size)
    near = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    beyond = F.count("*").over(near.rangeBetween(0, target))
    # rows a multiple of `stride` steps before the anchor share its residue
    offset = history % stride
    residue = F.pmod(pos, F.lit(stride))
    row = F.struct(*features)
    if offset == 0:
        lane = Window.partitionBy(*keys, "_chunk", residue).orderBy("_pos")
        past = F.collect_list(row).over(lane.rangeBetween(-history, -1))
    else:
        whole = F.collect_list(row).over(near.rangeBetween(-history, -1))
        past = F.filter(whole, lambda _, i: i % stride == 0)
    if single_step:
        labels = F.max(label).over(near.rangeBetween(target, target)).alias("label")
    else:
        # a struct, as collect_list would drop a missing label
        rows = F.collect_list(F.struct(label)).over(near.rangeBetween(0, target - 1))
        labels = F.transform(rows, lambda s: s[label]).alias("labels")
    before = F.count("*").over(near.rangeBetween(-history, -1))
    return (
        placed.select(
            *keys, ts, past.alias("history"), labels, "_own", before.alias("_before"), beyond.alias("_beyond")
        )
        .where(F.col("_own") & (F.col("_before") == history) & (F.col("_beyond") == target + 1))
        .drop("_own", "_before", "_beyond")
    )


def anchors_between(
    frames: DataFrame,
    history: int,
    step: timedelta,
    start: str | None = None,
    end: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Frames whose history starts at or after `start` and whose anchor is before `end`."""
    anchor = F.col(ts)
    out = frames
    if start is not None:
        first = F.lit(start).cast("timestamp_ntz")
        out = out.where(grid_pos(anchor, step) >= grid_pos(first, step) + history)
    if end is not None:
        out = out.where(anchor < F.lit(end).cast("timestamp_ntz"))
    return out


def window_starts(
    limits: DataFrame,
    batches: int,
    batch_size: int,
    length: int,
    seed: int,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Random first ordinals: keys, batch, sample, start in [0, n - length).

    `limits` holds keys and `n`, the number of training rows. The draw depends
    on series, batch, sample and seed only, so it is the same on any cluster.
    """
    drawn = (
        limits.where(F.col("n") > length)
        .withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))))
    )
    pick = F.pmod(hash_number([*keys, "batch", "sample"], seed, 15), F.col("n") - length)
    return drawn.select(*keys, "batch", "sample", pick.alias("start"))


def random_windows(
    df: DataFrame,
    starts: DataFrame,
    length: int,
    columns: Sequence[str],
    ordinal: str = "ordinal",
    keys: Sequence[str] = ("series_id",),
    as_rows: bool = False,
) -> DataFrame:
    """The stretch of `length` rows from each start ordinal.

    Starts are expanded to ordinals and joined on equality. The result is one
    array per (batch, sample), or with `as_rows` one row per step.
    """
    wanted = starts.select(
        *keys,
        "batch",
        "sample",
        F.posexplode(F.sequence(F.col("start"), F.col("start") + (length - 1))).alias("step", ordinal),
    )
    rows = wanted.join(df.select(*keys, ordinal, *columns), [*keys, ordinal])
    if as_rows:
        return rows
    stacked = rows.groupBy(*keys, "batch", "sample").agg(
        F.sort_array(F.collect_list(F.struct("step", *columns))).alias("steps")
    )
    return stacked.withColumn(
        "steps", F.transform("steps", lambda s: F.struct(*[s[c].alias(c) for c in columns]))
    )


def segment_bounds(first_day: Column, last_day: Column, horizon: int) -> dict[str, tuple[Column, Column]]:
    """First and last day of the four walk-forward segments.

    Targets are the last `horizon` days (validation) and those before them
    (training); the validation history is the training history moved on by
    `horizon` days.
    """
    val_start = F.date_sub(last_day, horizon - 1)
    train_start = F.date_sub(val_start, horizon)
    return {
        "train_history": (first_day, F.date_sub(train_start, 1)),
        "train_target": (train_start, F.date_sub(val_start, 1)),
        "val_history": (F.date_add(first_day, horizon), F.date_sub(val_start, 1)),
        "val_target": (val_start, last_day),
    }


def segment_table(days: DataFrame, horizon: int, ts: str = "ts") -> DataFrame:
    """The four segments as rows (segment, first_day, last_day, n_days)."""
    span = days.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi"))
    bounds = segment_bounds(F.col("lo"), F.col("hi"), horizon)
    rows = [
        F.struct(
            F.lit(name).alias("segment"),
            a.alias("first_day"),
            b.alias("last_day"),
            (F.date_diff(b, a) + 1).alias("n_days"),
        )
        for name, (a, b) in bounds.items()
    ]
    return span.select(F.inline(F.array(*rows)))


def walk_forward_segments(
    df: DataFrame,
    horizon: int,
    ts: str = "ts",
    span: tuple[date, date] | None = None,
) -> DataFrame:
    """Rows with the walk-forward `segment` they belong to; a row may be in several.

    The range of days is that of the whole table, or `span` when it is known.
    """
    if span is None:
        seen = df.agg(F.struct(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi")).alias("s")).scalar()
        first_day, last_day = seen["lo"], seen["hi"]
    else:
        first_day, last_day = F.lit(span[0]), F.lit(span[1])
    day = F.to_date(ts)
    names = [
        F.when(day.between(a, b), F.lit(name))
        for name, (a, b) in segment_bounds(first_day, last_day, horizon).items()
    ]
    return df.withColumn("segment", F.explode(F.array_compact(F.array(*names))))


def sequence_arrays(
    df: DataFrame, value: str = "value", keys: Sequence[str] = ("series_id",), ts: str = "ts"
) -> DataFrame:
    """One time-ordered array of values per series (and segment, if among the keys).

    Meant for stretches of bounded length, such as the segments of a daily series.
    """
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ts, value))).alias("_s"))
    return packed.withColumn(value, F.transform("_s", lambda s: s[value])).drop("_s")
