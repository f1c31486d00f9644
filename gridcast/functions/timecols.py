"""Time expressions on TIMESTAMP_NTZ columns.

Everything here is wall-clock arithmetic: no result depends on the session
time zone, so a frame gives the same buckets on every cluster.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(text: str) -> Column:
    """A wall-clock literal; folds to a constant, so comparisons push down."""
    return F.lit(text).cast("timestamp_ntz")


def step_micros(step: timedelta) -> int:
    us = step // timedelta(microseconds=1)
    if us <= 0:
        raise ValueError(f"step must be positive, got {step}")
    return us


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 00:00 on the wall clock."""
    if isinstance(ts, str):
        return F.expr(f"unix_date(to_date(`{ts}`)) * 86400L + hour(`{ts}`) * 3600 + minute(`{ts}`) * 60 + second(`{ts}`)")
    day = F.unix_date(F.to_date(ts)).cast("bigint") * 86_400
    return day + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 on the wall clock."""
    if isinstance(ts, str):
        return F.expr(
            f"(unix_date(to_date(`{ts}`)) * 86400L + hour(`{ts}`) * 3600 + minute(`{ts}`) * 60) * 1000000"
            f" + cast(extract(SECOND FROM `{ts}`) * 1000000 AS bigint)"
        )
    whole = F.unix_date(F.to_date(ts)).cast("bigint") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return whole * SECOND + (F.extract(F.lit("SECOND"), ts) * SECOND).cast("bigint")


def at_micros(us: Column) -> Column:
    """Inverse of :func:`micros`."""
    return F.timestamp_add("MICROSECOND", us, ntz("1970-01-01 00:00:00"))


def grid_pos(ts: Column | str, step: timedelta, origin_us: Column | int = 0) -> Column:
    """Number of the grid cell a time falls in, counted from `origin_us`.

    The remainder goes first, so the quotient is whole and the division exact
    for up to 2**52 cells either way.
    """
    us = step_micros(step)
    if us % SECOND == 0 and isinstance(origin_us, int) and origin_us % SECOND == 0:
        elapsed = seconds(ts) - origin_us // SECOND if origin_us else seconds(ts)
        return _whole_cells(elapsed, us // SECOND)
    return _whole_cells(micros(ts) - origin_us, us)


def _whole_cells(elapsed: Column, size: int) -> Column:
    size = F.lit(size).cast("bigint")
    return F.round((elapsed - F.pmod(elapsed, size)) / size).cast("bigint")


def pos_start(pos: Column, step: timedelta, origin_us: Column | int = 0) -> Column:
    """Start time of a grid cell, inverse of :func:`grid_pos`."""
    return at_micros(pos * F.lit(step_micros(step)).cast("bigint") + origin_us)


def bucket(ts: Column | str, step: timedelta) -> Column:
    """Start of the bucket of width `step` that holds `ts`."""
    return pos_start(grid_pos(ts, step), step)


def parse_offset_time(text: Column | str) -> Column:
    """ISO text with a literal offset, kept as the wall clock it shows."""
    return F.to_timestamp_ntz(_col(text))


def parse_time(text: Column | str, fmt: str | None = None) -> Column:
    """Text to wall-clock time; text that is not a time becomes null."""
    if fmt is None:
        return _col(text).try_cast("timestamp_ntz")
    return F.try_to_timestamp(_col(text), F.lit(fmt)).cast("timestamp_ntz")


def calendar(ts: Column | str) -> dict[str, Column]:
    """Day of month, month and hour."""
    ts = _col(ts)
    return {"date": F.dayofmonth(ts), "month": F.month(ts), "hour": F.hour(ts)}


def decimal_hour(ts: Column | str) -> Column:
    """Hour plus quarter-hour fraction (00:15 is 0.25)."""
    ts = _col(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(15) * F.lit(0.25)


def days_since(ts: Column | str, anchor: str | Column) -> Column:
    """Fractional days from an anchor time."""
    start = micros(ntz(anchor) if isinstance(anchor, str) else anchor)
    return (micros(ts) - start) / F.lit(float(DAY))


def wrap_year(days: Column | str, length: int = 365) -> Column:
    """Take one year off offsets beyond it; an offset of exactly a year stays."""
    days = _col(days)
    return F.when(days > length, days - length).otherwise(days)


def day_time(date: Column, hour: Column | int = 0, minute: Column | int = 0) -> Column:
    """Time key built from a date and clock parts."""
    as_col = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.make_timestamp_ntz(
        F.year(date), F.month(date), F.dayofmonth(date), as_col(hour), as_col(minute), F.lit(0)
    )
