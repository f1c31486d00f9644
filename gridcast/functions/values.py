"""Scalar and array expressions on measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c: Column | str) -> Column:
    """NaN counts as missing, like null."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c), c)


def fill_zero(c: Column | str) -> Column:
    return F.coalesce(missing_to_null(c), F.lit(0.0))


def clip_negative(c: Column | str) -> Column:
    """Negatives to 0; missing stays missing (``greatest`` would turn it to 0)."""
    c = _col(c)
    return F.when(c < 0, 0.0).otherwise(c)


def threshold_zero(c: Column | str, limit: float = 0.01) -> Column:
    c = _col(c)
    return F.when(c < limit, 0.0).otherwise(c)


def log1p_filled(c: Column | str) -> Column:
    return F.log1p(fill_zero(c))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def row_rmse(truth: Column | str, predicted: Column | str) -> Column:
    """Root mean squared error over the elements of two arrays of one row."""
    truth, predicted = _col(truth), _col(predicted)
    squares = F.zip_with(truth, predicted, lambda y, p: (y - p) * (y - p))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.try_divide(total, F.size(truth)))


def teacher_forced(history: Column | str, target: Column | str) -> Column:
    """History followed by the target without its last step."""
    history, target = _col(history), _col(target)
    return F.concat(history, F.slice(target, F.lit(1), F.greatest(F.size(target) - 1, F.lit(0))))


def tail(values: Column | str, k: int) -> Column:
    """The last k elements; the whole array when it is shorter."""
    values = _col(values)
    size = F.size(values)
    return F.slice(values, F.greatest(size - k, F.lit(0)) + 1, F.lit(k))


def relative_steps(n: Column | int) -> Column:
    """The time axis -n .. -1 that leads up to a forecast."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(-n, F.lit(-1))).otherwise(F.array().cast("array<int>"))


def reshape(values: Column | str, width: int) -> Column:
    """Flat array to consecutive rows of `width` elements."""
    values = _col(values)
    blocks = F.ceil(F.size(values) / F.lit(width)).cast("int")
    starts = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda b: F.slice(values, b * width + 1, F.lit(width)))


def hash_unit(columns: list[Column | str], seed: int) -> Column:
    """A number in [0, 1) that depends only on the row's key and the seed."""
    return hash_number(columns, seed) / F.lit(4294967296.0)


def hash_number(columns: list[Column | str], seed: int, digits: int = 8) -> Column:
    """The leading hexadecimal digits of the row's digest, 15 at most, as a non-negative bigint."""
    return F.conv(F.substring(hash_text(columns, seed), 1, digits), 16, 10).cast("bigint")


def hash_text(columns: list[Column | str], seed: int) -> Column:
    parts = [_col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
