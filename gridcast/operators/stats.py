"""Summaries: correlation, histogram, counts and error metrics.

Every summary is one aggregation over all columns, combined before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.values import missing_to_null


#: Pairs of columns that one grouped aggregation takes; more make its generated code too long.
PAIRS_AT_ONCE = 4
#: Rows of which the centre is taken that sums are about.
CENTRE_ROWS = 1024
#: A variance below this share of the mean square about the centre is rounding.
ROUNDING = 1e-13


def _long(df: DataFrame, groups: Sequence[str], rows: list[Column]) -> DataFrame:
    return df.select(*groups, F.inline(F.array(*rows)))


def _grouped_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """Pearson r of each pair in each group: (by…, pair, r); rows are read once for each `PAIRS_AT_ONCE` pairs."""
    out = []
    for first in range(0, len(pairs), PAIRS_AT_ONCE):
        sums, cells = [], []
        for i, (a, b) in enumerate(pairs[first : first + PAIRS_AT_ONCE], first):
            x, y = missing_to_null(a), missing_to_null(b)
            both = x.isNotNull() & y.isNotNull()
            u, v = F.when(both, x), F.when(both, y)
            r = F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v))
            sums.append(r.alias(f"_r{i}"))
            cells.append(F.struct(F.lit(i).alias("pair"), F.col(f"_r{i}").alias("r")))
        out.append(_long(df.groupBy(*by).agg(*sums), by, cells))
    return reduce(DataFrame.unionByName, out)


def _pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """Pearson r of each pair over the rows where both are present: (by…, pair, r).

    Without groups the rows are read once, however many pairs there are: the
    sums of all pairs are four matrix products of a batch, those of values and
    squares with the marks of what is present. A task hands on one row per pair.
    A side that is constant, or varies by rounding only, gives null.
    """
    if by or not pairs:
        return _grouped_correlations(df, pairs, by)
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    centre = df.limit(CENTRE_ROWS).agg(*[F.max(missing_to_null(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    about = centre.select(F.struct(*centre.columns).alias("c")).scalar()
    shifted = [missing_to_null(c) - F.coalesce(about[f"c{i}"], F.lit(0.0)) for i, c in enumerate(columns)]
    rows = df.select(F.array(*[F.coalesce(x, F.lit(float("nan"))) for x in shifted]).alias("v"))
    left, right = ([columns.index(p[side]) for p in pairs] for side in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(columns)
        counts, sums, squares, products = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, k)
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            counts += there.T @ there
            sums += x.T @ there
            squares += (x * x).T @ there
            products += x.T @ x
        found = [counts[left, right], sums[left, right], sums[right, left], squares[left, right], squares[right, left], products[left, right]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left))), *map(pa.array, found)], ["pair", "n", "x", "y", "xx", "yy", "xy"])

    parts = rows.mapInArrow(run, "pair long, n double, x double, y double, xx double, yy double, xy double")
    added = parts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).where("n > 0")
    mean_x, mean_y = F.col("x") / F.col("n"), F.col("y") / F.col("n")
    var_x, var_y = F.col("xx") / F.col("n") - mean_x * mean_x, F.col("yy") / F.col("n") - mean_y * mean_y
    varies = (var_x > ROUNDING * F.col("xx") / F.col("n")) & (var_y > ROUNDING * F.col("yy") / F.col("n"))
    r = F.when(varies, F.try_divide(F.col("xy") / F.col("n") - mean_x * mean_y, F.sqrt(var_x) * F.sqrt(var_y)))
    every = df.sparkSession.range(len(pairs)).withColumnRenamed("id", "pair")
    return every.join(added.select("pair", r.alias("r")), "pair", "left").select(F.col("pair").cast("int").alias("pair"), "r")


def _named(pairs: Sequence[tuple[str, str]], side: int) -> Column:
    return F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair") + 1)


def correlation(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Every pair of columns once, as rows (a, b, r): the lower triangle of the matrix."""
    pairs = list(combinations(columns, 2))
    r = _pair_correlations(df, pairs, by)
    return r.select(*by, _named(pairs, 0).alias("a"), _named(pairs, 1).alias("b"), "r")


def correlation_with(
    df: DataFrame, target: str, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Correlation of one column with each of the others, as rows (column, r)."""
    pairs = [(c, target) for c in columns if c != target]
    r = _pair_correlations(df, pairs, by)
    return r.select(*by, _named(pairs, 0).alias("column"), "r")


def pretty_step(low: Column, high: Column, n: int) -> Column:
    """Bin width near (high - low) / n that is 1, 2, 5 or 10 times a power of ten.

    The next multiple is taken while it is nearer than the bias allows: 1.5 for
    the steps to 2 and 10, 2.75 for the step to 5.
    """
    span = high - low
    # a single value has no span; its own size then sets the scale
    size = F.greatest(F.abs(low), F.abs(high))
    alone = F.when(size > 10, 9 + size / 10).when(size > 0, size).otherwise(1.0)
    cell = F.when(span > 0, span / n).otherwise(0.75 * alone)
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    bias, bias5 = 1.5, 0.5 + 1.5 * 1.5
    two = 2 * base - cell < bias * (cell - base)
    five = 5 * base - cell < bias5 * (cell - 2 * base)
    ten = 10 * base - cell < bias * (cell - 5 * base)
    return F.when(two & five & ten, 10 * base).when(two & five, 5 * base).when(two, 2 * base).otherwise(base)


def histogram(df: DataFrame, column: str, bins: int = 30, positive_only: bool = True) -> DataFrame:
    """Counts in about `bins` bins of a round width, as rows (bin_start, bin_end, n).

    Bins are closed on the right, and the first also holds its left end. The
    width comes from the minimum and maximum; empty bins are not listed.
    """
    x = missing_to_null(column)
    values = df.select(x.alias("_x")).where("_x > 0" if positive_only else "_x is not null")
    span = values.agg(F.min("_x").alias("low"), F.max("_x").alias("high"))
    width = pretty_step(F.col("low"), F.col("high"), bins)
    grid = span.select(
        F.struct(width.alias("width"), F.floor(F.col("low") / width + 1e-10).alias("first")).alias("grid")
    ).scalar()
    cell = F.greatest(F.ceil(F.col("_x") / grid["width"] - 1e-7) - 1, grid["first"])
    counted = values.groupBy(cell.cast("bigint").alias("_cell")).agg(F.count("*").alias("n"))
    return counted.select(
        (F.col("_cell") * grid["width"]).alias("bin_start"),
        ((F.col("_cell") + 1) * grid["width"]).alias("bin_end"),
        "n",
    )


def column_info(df: DataFrame) -> DataFrame:
    """Type and number of present values of every column, as rows (column, dtype, n)."""
    types = dict(df.dtypes)

    def present(c: str) -> Column:
        return F.count(missing_to_null(c)) if types[c] in ("double", "float") else F.count(F.col(c))

    counts = df.agg(*[present(c).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"_n{i}").alias("n"))
        for i, c in enumerate(df.columns)
    ]
    return _long(counts, (), rows)


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each column, as rows."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = missing_to_null(c)
        for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
            aggs.append(f(x).alias(f"_{name}{i}"))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                *[F.col(f"_{name}{i}").alias(name) for name in ("mean", "std", "min", "max")],
            )
        )
    return _long(df.groupBy(*by).agg(*aggs), by, rows)


def series_mean(df: DataFrame, value: str = "value", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(missing_to_null(value)).alias("mean"))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """1 - squared error / squared deviation; a constant truth scores 1 or 0."""
    error, spread = mse(y, p), F.var_pop(y)
    flat = F.when(error == 0, 1.0).when(error.isNotNull(), 0.0)
    return F.coalesce(1 - F.try_divide(error, spread), flat)


def mape(y: Column, p: Column) -> Column:
    """Mean absolute percentage error; rows whose truth is 0 are left out."""
    share = F.abs(F.try_divide(y - p, y))
    return F.avg(F.when(~F.isnan(share), share)) * 100


def error_metrics(
    df: DataFrame,
    truth: str = "truth",
    predicted: str = "prediction",
    by: Sequence[str] = (),
    capacity: float | None = None,
) -> DataFrame:
    """MSE, RMSE, MAE and R² in one pass; `capacity` adds MSE / capacity."""
    y, p = missing_to_null(truth), missing_to_null(predicted)
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    aggs = [
        F.count(y).alias("n"),
        mse(y, p).alias("mse"),
        F.sqrt(mse(y, p)).alias("rmse"),
        mae(y, p).alias("mae"),
        r2(y, p).alias("r2"),
    ]
    if capacity is not None:
        aggs.append((mse(y, p) / F.lit(float(capacity))).alias("capacity_error"))
    return df.groupBy(*by).agg(*aggs)


def warmup_mse(
    df: DataFrame,
    truth: str,
    predicted: str,
    step: str = "step",
    skip: int = 50,
    by: Sequence[str] = (),
) -> DataFrame:
    """MSE without the first `skip` steps (0-based) of each sequence."""
    rows = df.where(F.col(step) >= skip)
    return rows.groupBy(*by).agg(mse(missing_to_null(truth), missing_to_null(predicted)).alias("mse"))


def fold_summary(scores: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population deviation of fold scores, as rows (…, metric, mean, std)."""
    aggs = [f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(f"_mean_{m}").alias("mean"), F.col(f"_std_{m}").alias("std"))
        for m in metrics
    ]
    return _long(scores.groupBy(*by).agg(*aggs), by, rows)
