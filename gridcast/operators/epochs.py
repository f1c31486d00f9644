"""Shuffled epochs by arithmetic: no sort and no rank after the rows are numbered.

The place of a row in an epoch is a keyed permutation of its number: a Feistel
network over the next power of two, walked on until it falls below the number of
rows. Every epoch has a key of its own, so each is another order, and the batch
and slot of any row in any epoch are known from its number alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 4
MULTIPLIER = 40503
MOST_BITS = 40


def epoch_keys(seed: int, epoch: int) -> list[int]:
    """One key of 32 bits per round."""
    digest = hashlib.md5(f"{seed}|{epoch}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(ROUNDS)]


def permuted(numbers: np.ndarray, n: int, keys: Sequence[int]) -> np.ndarray:
    """The places, below `n`, of numbers below `n`."""
    half = max((max(n - 1, 1).bit_length() + 1) // 2, 1)
    if 2 * half > MOST_BITS:
        raise ValueError("too many rows")
    mask = np.int64((1 << half) - 1)
    out = numbers.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for key in keys:
            mixed = right * MULTIPLIER + key
            left, right = right, left ^ ((mixed ^ (mixed >> half)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]  # the walk goes on until it is back among the rows
    return out


def shuffled_epochs(df: DataFrame, n: int, batch_size: int, epochs: int = 1, number: str | Column = "number", seed: int = 100) -> DataFrame:
    """Every row once per epoch, with `epoch`, `batch` and `slot`, all from 0.

    `number` counts the rows from 0 to n - 1. Rows are neither sorted nor moved:
    a trainer picks or groups the batches that it needs.
    """
    keys = [epoch_keys(seed, e) for e in range(epochs)]
    kind = T.ArrayType(T.LongType())

    @F.pandas_udf(kind)
    def places(numbers: pd.Series) -> pd.Series:
        found = [permuted(numbers.to_numpy(), n, k) for k in keys]
        return pd.Series(list(np.stack(found, axis=1)) if found else [[] for _ in numbers])

    at = F.col(number) if isinstance(number, str) else number
    rows = df.withColumn("_places", places(at.cast("long")))
    rows = rows.select(*df.columns, F.posexplode("_places").alias("epoch", "_place"))
    return rows.withColumns({"batch": F.floor(F.col("_place") / batch_size), "slot": F.pmod("_place", F.lit(batch_size))}).drop("_place")
