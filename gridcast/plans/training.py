"""Prepare a training set, fit a forecaster and score it on hold-out days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.timecols import ntz
from gridcast.operators.boosting import Boosting, BoostedTrees
from gridcast.operators.columns import cast_columns, clip_negatives, drop_holdout, fill_missing
from gridcast.operators.gram import LinearWeights, Penalised
from gridcast.operators.models import fit_early_stop, xy_split
from gridcast.operators.rank import chrono_split
from gridcast.operators.scale import fit_minmax, minmax, minmax_inverse
from gridcast.operators.stats import error_metrics
from gridcast.session import frozen


def prepare(
    dataset: DataFrame,
    features: Sequence[str],
    label: str = "result",
    clipped: Sequence[str] = (),
    whole: Sequence[str] = ("difference",),
    keep: Sequence[str] = ("series_id", "ts"),
) -> DataFrame:
    """Model columns only: whole day offsets, no negative counters, nothing missing."""
    narrow = dataset.select(*keep, label, *features)
    cast = cast_columns(narrow, {c: "int" for c in whole})
    return fill_missing(clip_negatives(cast, clipped), [label, *features])


def fit_forecaster(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    regressor: Estimator | Boosting | Penalised,
    fraction: float = 0.8,
    keys: Sequence[str] = ("series_id",),
    patience: int = 30,
) -> Model | BoostedTrees | LinearWeights:
    """Fit on the first part of each series.

    Boosted trees keep the rounds with the least error on the rest of the
    series; other models do not see the rest.
    """
    split = chrono_split(rows, fraction, keys)
    if isinstance(regressor, Boosting):
        return regressor.fit(split.withColumn("is_validation", ~F.col("is_train")), features, label, "is_validation")
    if isinstance(regressor, Penalised):
        return regressor.fit(split.where("is_train"), features, label)
    if isinstance(regressor, GBTRegressor):
        marked = split.withColumn("is_validation", ~F.col("is_train"))
        vectors = xy_split(marked, features, label, ["is_validation"])
        return fit_early_stop(vectors, regressor, "is_validation", patience)
    return regressor.fit(xy_split(split.where("is_train"), features, label))


def fit_scaled(
    prepared: DataFrame,
    features: Sequence[str],
    regressor: Estimator | Boosting | Penalised,
    label: str = "result",
    holdouts: Sequence[tuple[str, str]] = (),
    keys: Sequence[str] = ("series_id",),
) -> tuple[Model | BoostedTrees | LinearWeights, DataFrame]:
    """A forecaster on min-max scaled rows, and the scaler's fit over all rows."""
    columns = [label, *features]
    fit = frozen(fit_minmax(prepared, columns))
    rows = drop_holdout(prepared, holdouts) if holdouts else prepared
    return fit_forecaster(minmax(rows, fit, columns), features, label, regressor, keys=keys), fit


def train_and_score(
    prepared: DataFrame,
    features: Sequence[str],
    holdouts: Sequence[tuple[str, str]],
    regressor: Estimator | Boosting | Penalised,
    label: str = "result",
    keys: Sequence[str] = ("series_id",),
    capacity: float | None = None,
) -> tuple[Model | BoostedTrees | LinearWeights, DataFrame, DataFrame]:
    """Model, hold-out predictions in the data's unit, and their errors per hold-out.

    The scaler is fitted on all rows. Hold-out ranges (start, end) leave
    training with open ends and are scored with both ends closed. The rows are
    read by the scaler, the fit and the scoring: pass a stored table.
    """
    columns = [label, *features]
    model, fit = fit_scaled(prepared, features, regressor, label, holdouts, keys)
    scored_in = [F.when(F.col("ts").between(ntz(a), ntz(b)), F.lit(a)) for a, b in holdouts]
    days = prepared.withColumn("holdout", F.explode(F.array_compact(F.array(*scored_in))))
    kept = ["holdout", *keys, "ts", "truth"]
    scaled_days = xy_split(minmax(days.withColumn("truth", F.col(label)), fit, columns), features, label, kept)
    predicted = minmax_inverse(model.transform(scaled_days), fit, {"prediction": label}).select(*kept, "prediction")
    return model, predicted, error_metrics(predicted, "truth", "prediction", ["holdout"], capacity)
