"""Amounts of a coming day from a fitted model and the features of its analog day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame

from gridcast.operators.boosting import BoostedTrees
from gridcast.operators.gram import LinearWeights
from gridcast.operators.models import xy_split
from gridcast.operators.scale import minmax, minmax_inverse
from gridcast.plans.submission import hourly_submission


def forecast_day(
    model: Model | BoostedTrees | LinearWeights,
    fit: DataFrame,
    day: DataFrame,
    features: Sequence[str],
    label: str = "result",
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Hourly amounts: features scaled by the training fit, predicted, and brought back to the label's unit."""
    scaled = minmax(day.select(*keys, "ts", *features), fit, features)
    predicted = model.transform(xy_split(scaled, features, None, [*keys, "ts"]))
    back = minmax_inverse(predicted, fit, {"prediction": label})
    return hourly_submission(back.select(*keys, "ts", "prediction"), keys=keys)
