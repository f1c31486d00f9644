"""Repeatable splits, samples and batches.

Every draw is a digest of the row's key and a seed. It does not depend on how
rows are spread over tasks, so a retried task draws the same rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.values import hash_number, hash_text, hash_unit
from gridcast.operators.align import attach
from gridcast.operators.rank import bucketed_rank, key_ordinal, rank_cutoff
from gridcast.session import frozen


def hash_split(
    df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42, flag: str = "is_test"
) -> DataFrame:
    """Mark about `fraction` of the rows as test rows."""
    return df.withColumn(flag, hash_unit(list(key), seed) < fraction)


def hash_fold(
    df: DataFrame, folds: int, key: Sequence[str], seed: int = 21, name: str = "fold"
) -> DataFrame:
    """Number of the shuffled cross-validation fold, 0 … folds - 1."""
    return df.withColumn(name, F.pmod(hash_number(list(key), seed), F.lit(folds)).cast("int"))


def sample_series(
    df: DataFrame, n: int, seed: int = 8, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """All rows of `n` series drawn at random: those with the smallest digests.

    The digest at the cut is found by counting leading digits, so the keys are
    not brought together.
    """
    drawn = frozen(df.select(*keys).distinct().withColumn("_number", hash_number(list(keys), seed, 15)))
    if drawn.count() <= n:
        return df
    ranks = df.sparkSession.createDataFrame([(0, n)], "_all int, rank bigint")
    every = drawn.withColumn("_all", F.lit(0))
    cut = rank_cutoff(every, ranks, [("_n", F.col("_number"), [1 << w for w in (48, 36, 24, 12, 0)])], ["_all"], 1)
    last = cut.first()["_n_cut"] if n > 0 else -1
    before = drawn.where(F.col("_number") < last)
    # digests that agree in 60 bits: the rest of the digest and the keys decide
    place = F.row_number().over(Window.partitionBy("_number").orderBy(hash_text(list(keys), seed), *keys))
    at = drawn.where(F.col("_number") == last).withColumn("_place", place).where(F.col("_place") <= n - before.count())
    return attach(df, before.select(*keys).unionByName(at.select(*keys)), keys, "left_semi")


def first_series(df: DataFrame, n: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """All rows of the first `n` series in key order."""
    kept = key_ordinal(df, keys, "_ordinal").where(F.col("_ordinal") <= n)
    return attach(df, kept.select(*keys), keys, "left_semi")


def series_holdout(
    df: DataFrame, fraction: float = 0.2, keys: Sequence[str] = ("series_id",), flag: str = "is_validation"
) -> DataFrame:
    """Mark the rows of the last `fraction` of the series, in key order.

    The first ``int(n * (1 - fraction))`` series train.
    """
    numbered = key_ordinal(df, keys, "_ordinal")
    total = numbered.agg(F.count("*").alias("n")).scalar()
    marked = numbered.select(*keys, (F.col("_ordinal") > F.floor(total * F.lit(1 - fraction))).alias(flag))
    return attach(df, marked, keys)


def shuffle_batches(df: DataFrame, batch_size: int, key: Sequence[str], seed: int = 100) -> DataFrame:
    """Rows in a random order, cut into batches: adds `batch` and `slot`, both from 0.

    `key` identifies a row. All batches but the last are full. Rows are ranked
    inside buckets of equal leading digest digits, with more digits for more rows.
    """
    digest = hash_text(list(key), seed)
    digits = [(f"_d{i}", F.substring(digest, 2 * i + 1, 2)) for i in range(5)]
    order = [digest, *[F.col(k) for k in key]]
    ranked = bucketed_rank(df, digits[:1], order, name="_rank", finer=digits[1:])
    place = F.col("_rank") - 1
    return (
        ranked.withColumn("batch", F.floor(place / batch_size))
        .withColumn("slot", F.pmod(place, F.lit(batch_size)))
        .drop("_rank")
    )


def consecutive_batches(df: DataFrame, batch_size: int, ordinal: str = "ordinal") -> DataFrame:
    """Row batches in order of a 1-based ordinal."""
    place = F.col(ordinal) - 1
    return df.withColumn("batch", F.floor(place / batch_size))


def take_batches(df: DataFrame, n: int = 1, batch: str = "batch") -> DataFrame:
    """The first `n` batches."""
    return df.where(F.col(batch) < n)
