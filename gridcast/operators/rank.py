"""Order without an index: ranks, cut-offs, chronological splits, first and last rows.

None of these sorts a whole series in one task. Ranks are built from counts of
ordered buckets, so a series that holds most of the rows costs no more than the
same rows spread over many series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.timecols import DAY, SECOND, at_micros, micros
from gridcast.operators.align import attach
from gridcast.session import frozen

TIME_WIDTHS = (DAY, SECOND, 1)
ID_WIDTHS = (1 << 42, 1 << 21, 1)
LEAF_ROWS = 2_000_000


def _floor_to(value: Column, width: int) -> Column:
    return value if width == 1 else value - F.pmod(value, F.lit(width).cast("bigint"))


def rank_cutoff(
    df: DataFrame,
    ranks: DataFrame,
    order: Sequence[tuple[str, Column, Sequence[int]]],
    keys: Sequence[str],
    series: int | None = None,
    within: Callable[[int, int], Column] | None = None,
) -> DataFrame:
    """The order values that sit at a 1-based rank of each series.

    `ranks` holds keys and `rank`; `order` lists (name, bigint column, widths),
    most significant first. Each width narrows the search: rows are counted per
    bucket, the bucket that holds the rank is kept, and the next, finer width
    looks inside it only. No row is shuffled, and a running sum never sees more
    counts than one bucket has finer buckets. The result has keys and a column
    `<name>_cut` for each order value. `series`, the number of rows of `ranks`,
    bounds every table that is joined back; it is counted if not given.
    `within(low, high)` is the condition on rows that the first order value is
    at least low and below high: with it the scans after the first one read
    only the stretch that holds the buckets found.
    """
    rows = df.select(*keys, *[c.alias(n) for n, c, _ in order])
    state = ranks.select(*keys, F.col("rank").cast("bigint").alias("_rest")).where("_rest > 0")
    series = state.count() if series is None else series
    done: list[str] = []
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    for name, _, widths in order:
        inside = None
        for width in widths:
            found = attach(rows, state, keys, "inner", known_rows=series)
            for d in done:
                found = found.where(F.col(d) == F.col(f"{d}_cut"))
            if inside is not None:
                found = found.where(_floor_to(F.col(name), inside) == F.col(f"{name}_cut"))
            cuts = [f"{d}_cut" for d in done]
            counted = found.groupBy(*keys, *cuts, "_rest", _floor_to(F.col(name), width).alias("_b")).agg(
                F.count("*").alias("_n")
            )
            summed = counted.withColumn("_upto", F.sum("_n").over(running))
            before = F.col("_upto") - F.col("_n")
            state = summed.where((F.col("_upto") >= F.col("_rest")) & (before < F.col("_rest"))).select(
                *keys, *cuts, F.col("_b").alias(f"{name}_cut"), (F.col("_rest") - before).alias("_rest")
            )
            inside = width
            if within is not None:
                state = frozen(state)
                low, high = state.agg(F.min(f"{name}_cut"), F.max(f"{name}_cut")).first()
                if low is not None:
                    rows = df.where(within(low, high + width)).select(*keys, *[c.alias(n) for n, c, _ in order])
                within = None
        done.append(name)
    return state.drop("_rest")


def _up_to_rank(
    df: DataFrame,
    ranks: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, Column, Sequence[int]]],
    flag: str,
    within: Callable[[int, int], Column],
) -> DataFrame:
    """Mark the rows at or before a rank in the lexicographic order of `order`."""
    ranks = frozen(ranks)
    series = ranks.count()
    marked = attach(df, rank_cutoff(df, ranks, order, keys, series, within), keys, known_rows=series)
    name, value, _ = order[-1]
    inside = value <= F.col(f"{name}_cut")
    for name, value, _ in reversed(order[:-1]):
        cut = F.col(f"{name}_cut")
        inside = (value < cut) | ((value == cut) & inside)
    return marked.withColumn(flag, F.coalesce(inside, F.lit(False))).drop(*[f"{n}_cut" for n, _, _ in order])


def _time_order(ts: str, tie: str | None, backwards: bool) -> list[tuple[str, Column, Sequence[int]]]:
    sign = -1 if backwards else 1
    order = [("_time", micros(ts) * sign, TIME_WIDTHS)]
    if tie is not None:
        order.append(("_tie", F.col(tie).cast("bigint") * sign, ID_WIDTHS))
    return order


def _time_within(ts: str, backwards: bool) -> Callable[[int, int], Column]:
    """A range of order values as a condition on the time itself, which scans can use."""
    t = F.col(ts)
    if backwards:
        return lambda low, high: (t > at_micros(F.lit(-high))) & (t <= at_micros(F.lit(-low)))
    return lambda low, high: (t >= at_micros(F.lit(low))) & (t < at_micros(F.lit(high)))


def chrono_split(
    df: DataFrame,
    fraction: float,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    tie: str | None = None,
    flag: str = "is_train",
) -> DataFrame:
    """Mark the earliest ``int(n * fraction)`` rows of each series as training rows.

    The rows are not shuffled by series: only the time at the split is searched
    for. `tie` is an integer column that orders rows of the same time; without
    it times are taken to be unique per series.
    """
    ranks = df.groupBy(*keys).agg(F.floor(F.count("*") * F.lit(fraction)).alias("rank"))
    return _up_to_rank(df, ranks, keys, _time_order(ts, tie, False), flag, _time_within(ts, False))


def first_rows(
    df: DataFrame, n: int, keys: Sequence[str] = ("series_id",), ts: str = "ts", tie: str | None = None
) -> DataFrame:
    """The n earliest rows of each series."""
    ranks = df.groupBy(*keys).agg(F.least(F.count("*"), F.lit(n)).alias("rank"))
    return _up_to_rank(df, ranks, keys, _time_order(ts, tie, False), "_in", _time_within(ts, False)).where("_in").drop("_in")


def last_rows(
    df: DataFrame, n: int, keys: Sequence[str] = ("series_id",), ts: str = "ts", tie: str | None = None
) -> DataFrame:
    """The n latest rows of each series."""
    ranks = df.groupBy(*keys).agg(F.least(F.count("*"), F.lit(n)).alias("rank"))
    return _up_to_rank(df, ranks, keys, _time_order(ts, tie, True), "_in", _time_within(ts, True)).where("_in").drop("_in")


def bucketed_rank(
    df: DataFrame,
    levels: Sequence[tuple[str, Column]],
    order: Sequence[Column],
    keys: Sequence[str] = (),
    name: str = "ordinal",
    finer: Sequence[tuple[str, Column]] = (),
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """1-based rank of every row in its series.

    `levels` are bucket columns, coarse to fine, that agree with `order`: a row
    of an earlier bucket comes first. Only the rows of one finest bucket are
    sorted together; the ranks before it are sums of counts, which are counted
    once and frozen. Buckets of more than `leaf_rows` rows, and only they, are
    cut by the next of the `finer` levels.
    """
    finer = list(finer)
    names = [n for n, _ in levels]
    rows = df.withColumns(dict(levels))
    while True:
        counts = frozen(rows.groupBy(*keys, *names).agg(F.count("*").alias("_n")))
        crowded = counts.where(F.col("_n") > leaf_rows).select(*keys, *names, F.lit(True).alias("_crowded"))
        number = crowded.count() if finer else 0
        if not number:
            break
        level, value = finer.pop(0)
        kind = df.select(value.alias("v")).schema["v"].dataType.simpleString()
        whole = F.lit("" if kind == "string" else 0).cast(kind)
        rows = attach(rows, crowded, [*keys, *names], known_rows=number)
        rows = rows.withColumn(level, F.when(F.col("_crowded"), value).otherwise(whole)).drop("_crowded")
        names.append(level)
    offsets = counts
    for depth in range(len(names), 0, -1):
        parent, here = [*keys, *names[: depth - 1]], names[depth - 1]
        before = (
            Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        ).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
        level = (
            counts.groupBy(*parent, here)
            .agg(F.sum("_n").alias("_n"))
            .withColumn(f"_before{depth}", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .drop("_n")
        )
        offsets = offsets.join(level, [*parent, here])
    start = sum((F.col(f"_before{d}") for d in range(1, len(names) + 1)), F.lit(0))
    offsets = offsets.select(*keys, *names, start.cast("bigint").alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    return (
        attach(rows, offsets, [*keys, *names], "inner", known_rows=counts.count())
        .withColumn(name, F.col("_start") + local)
        .drop("_start", *names)
    )


def row_ordinal(
    df: DataFrame,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    tie: str | None = None,
    name: str = "ordinal",
    leaf_rows: int = LEAF_ROWS,
    unique: bool = False,
) -> DataFrame:
    """1-based position of every row in its series by time.

    `tie` is an integer column that orders rows of the same time; without one,
    `unique` declares that a series has each time once. Buckets are days;
    crowded days are cut into seconds, those into microseconds, and those by the
    tie column.
    """
    if tie is None and not unique:
        raise ValueError("rows of the same time need a tie column, or declare unique=True")
    time = micros(ts)
    levels = [("_day", _floor_to(time, DAY))]
    finer, order = [("_second", _floor_to(time, SECOND)), ("_micro", time)], [F.col(ts)]
    if tie is not None:
        order.append(F.col(tie))
        number = F.col(tie).cast("bigint")
        finer += [(f"_tie{i}", _floor_to(number, w)) for i, w in enumerate(ID_WIDTHS[:-1])]
    return bucketed_rank(df, levels, order, keys, name, finer, leaf_rows)


def key_ordinal(df: DataFrame, keys: Sequence[str] = ("series_id",), name: str = "ordinal") -> DataFrame:
    """Distinct keys with their 1-based position in key order.

    The keys are sorted by ranges over all tasks and frozen with their place in
    the range; what is left is one running sum over the ranges, of which there
    are as many as shuffle partitions.
    """
    ordered = df.select(*keys).distinct().orderBy(*keys)
    shift = F.lit(1 << 33)
    placed = frozen(ordered.withColumn("_id", F.monotonically_increasing_id())).select(
        *keys,
        F.shiftrightunsigned("_id", 33).alias("_range"),
        F.pmod("_id", shift).alias("_place"),
    )
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_range").select(*keys, (F.col("_start") + F.col("_place") + 1).alias(name))
