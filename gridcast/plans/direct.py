"""Direct forecast of several steps: sliding frames feed one model for every step."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators.gram import Penalised, gram_matrices, linear_value, mean_squares, solve
from gridcast.operators.models import xy_split
from gridcast.operators.rank import chrono_split
from gridcast.operators.stats import warmup_mse
from gridcast.session import stored


def direct_rows(frames: DataFrame, value: str, lags: Sequence[int], keep: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per frame and step: the kept columns, step (from 0), lag_k from the history's end, label."""
    seen = {f"lag_{k}": F.element_at("history", -k)[value] for k in lags}
    return frames.select(*keep, ts, *[c.alias(n) for n, c in seen.items()], F.posexplode("labels").alias("step", "label"))


def direct_forecast(
    frames: DataFrame,
    value: str,
    lags: Sequence[int],
    regressor: Estimator,
    with_step: bool = False,
    fraction: float = 0.8,
    skip: int = 50,
    keys: Sequence[str] = ("series_id",),
) -> tuple[Model, DataFrame, DataFrame]:
    """Model, validation rows with their prediction, and their error without the first `skip` steps.

    The first frames of each series train, the rest validate; `with_step` makes
    the step a feature too.
    """
    features = [f"lag_{k}" for k in lags] + (["step"] if with_step else [])
    marked = chrono_split(stored(frames, "frames"), fraction, keys)
    rows = xy_split(direct_rows(marked, value, lags, [*keys, "is_train"]), features, "label", [*keys, "ts", "step", "is_train"])
    model = regressor.fit(rows.where("is_train"))
    scored = model.transform(rows.where("not is_train")).select(*keys, "ts", "step", "label", "prediction")
    return model, scored, warmup_mse(scored, "label", "prediction", skip=skip, by=keys)


def direct_forecast_all_steps(
    frames: DataFrame,
    value: str,
    lags: Sequence[int],
    steps: int,
    is_train: str,
    model: Penalised = Penalised(),
) -> tuple[np.ndarray, DataFrame]:
    """Every step of the target as a response of its own, all fitted at once.

    The frames are read once: their sums of products hold the products of the
    lags, and those of the lags with all steps. Returns intercept and weights
    (rows) of each step (columns), and the errors on the other frames by step:
    step (from 0), n, mse.
    """
    seen = {f"lag_{k}": F.element_at("history", -k)[value] for k in lags}
    ahead = {f"step_{i}": F.element_at("labels", i + 1) for i in range(steps)}
    grams = gram_matrices(frames, seen | ahead, [is_train])
    if (1,) not in grams:
        raise ValueError("no training frames")
    weights = solve(grams[1,], list(seen), list(ahead), model)
    rows = []
    if (0,) in grams:
        errors = mean_squares(grams[0,], list(seen), list(ahead), weights)
        rows = [(i, int(grams[0,].n), float(e)) for i, e in enumerate(errors)]
    return weights, frames.sparkSession.createDataFrame(rows, "step long, n long, mse double")


def with_all_steps(frames: DataFrame, value: str, lags: Sequence[int], weights: np.ndarray, name: str = "predictions") -> DataFrame:
    """The frames with the array of predictions for all steps."""
    seen = [F.element_at("history", -k)[value] for k in lags]
    return frames.withColumn(name, F.array(*[linear_value(w, seen) for w in weights.T]))
