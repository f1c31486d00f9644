"""Regression on prepared features with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gridcast.operators.columns import union_all
from gridcast.operators.knn import knn_regress
from gridcast.operators.scale import fit_standard, standardise
from gridcast.operators.stats import error_metrics, mse
from gridcast.session import frozen, stored


def xy_split(df: DataFrame, features: Sequence[str], label: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector and label, by name; without a label for rows to predict."""
    columns = [*keep, "features"]
    out = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    if label is None:
        return out.select(*columns)
    return out.select(*columns, F.col(label).cast("double").alias("label"))


def cart(**params) -> Estimator:
    return DecisionTreeRegressor(**{"seed": 42, **params})


def boosted_trees(**params) -> Estimator:
    return GBTRegressor(**{"seed": 42, **params})


def linear(**params) -> Estimator:
    return LinearRegression(**params)


def lasso(alpha: float = 1.0, **params) -> Estimator:
    """Penalty on the slopes of the features as they are given: scale them beforehand."""
    return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, **params)


@dataclass(frozen=True)
class ElasticNet:
    """Least squares / 2 plus alpha * (ratio * |w| + (1 - ratio) / 2 * w²), in the label's unit."""

    alpha: float = 1.0
    ratio: float = 0.5
    params: Mapping = field(default_factory=dict)

    def estimator(self, train: DataFrame, label: str) -> Estimator:
        """The estimator for these rows: Spark takes the square penalty in units of the label's deviation."""
        spread = train.agg(F.stddev_pop(label)).first()[0] or 1.0
        square, plain = self.alpha * (1 - self.ratio) * spread, self.alpha * self.ratio
        total = square + plain
        share = plain / total if total else 0.0
        return LinearRegression(regParam=total, elasticNetParam=share, standardization=False, **self.params)


def elastic_net(alpha: float = 1.0, ratio: float = 0.5, **params) -> ElasticNet:
    return ElasticNet(alpha, ratio, params)


@dataclass(frozen=True)
class Nearest:
    """k nearest neighbours among the models of a comparison; needs the rows' key."""

    k: int = 5
    tile_rows: int = 4096


def cross_validate(
    df: DataFrame,
    models: Mapping[str, Estimator | ElasticNet | Nearest],
    features: Sequence[str],
    label: str,
    fold: str = "fold",
    folds: int = 10,
    parallelism: int = 4,
    key: str | None = None,
    digits: int = 6,
) -> DataFrame:
    """RMSE, R² and MAE of every model on every fold: model, fold, n, mse, rmse, mae, r2.

    Folds come from an integer column, so they do not depend on how the rows
    are partitioned. In each fold features are standardised by the mean and
    population deviation of its training rows, to `digits` decimals, so that
    neighbours at equal distance stay so. Every model is fitted once and
    predicts once; all predictions are scored in one aggregation.
    """
    names = [fold, *([key] if key else []), *features]
    rows = stored(df.select(*names, F.col(label).cast("double").alias("label")), "folds")
    kept = [fold, "label", "prediction"]

    def predictions(i: int) -> list[DataFrame]:
        train = rows.where(F.col(fold) != i)
        fit = fit_standard(train, features)
        fit = fit.select(*[F.round(c, digits).alias(c) for c in fit.columns])
        known = rows.sparkSession.createDataFrame([fit.first()], fit.schema)
        train, test = standardise(train, known, features), standardise(rows.where(F.col(fold) == i), known, features)
        vectors = xy_split(train, features, "label")
        out = []
        for name, model in models.items():
            if isinstance(model, Nearest):
                found = knn_regress(train, test, features, "label", key, model.k, model.tile_rows)
            else:
                model = model.estimator(train, "label") if isinstance(model, ElasticNet) else model.copy()
                found = model.fit(vectors).transform(xy_split(test, features, "label", [fold]))
            out.append(found.select(F.lit(name).alias("model"), *kept))
        return out

    with ThreadPoolExecutor(parallelism) as pool:
        scored = [p for some in pool.map(predictions, range(folds)) for p in some]
    return frozen(error_metrics(union_all(*scored), "label", "prediction", by=["model", fold]))


def best_length(errors: Sequence[float], patience: int) -> int:
    """Rounds up to the best one before the first `patience` rounds without a better one."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_early_stop(rows: DataFrame, regressor: GBTRegressor, is_validation: str, patience: int = 30) -> Model:
    """Boost on the training rows and keep the rounds up to the least validation error.

    The search for it ends after `patience` rounds without a better one. Rounds
    are repeatable, so the kept ones are fitted again if any are cut off. Every
    round reads the rows again, so they are kept while the fit runs.
    """
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = rows.where(~F.col(is_validation))
        model = regressor.fit(train)
        errors = model.evaluateEachIteration(rows.where(is_validation), "squared")
        length = best_length(errors, patience)
        if length < len(errors):
            model = regressor.fit(train, {regressor.maxIter: length})
        return model
    finally:
        rows.unpersist()


def grid_search(
    train: DataFrame,
    validation: DataFrame,
    regressor: Estimator,
    grid: Sequence[Mapping],
    parallelism: int = 4,
) -> tuple[list[dict], Model]:
    """Fit every parameter map on the training rows and score it on the validation rows.

    Trials run side by side. Returns one record per map in order, and the model
    with the least MSE, the first of equals.
    """
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    validation = validation.persist(StorageLevel.MEMORY_AND_DISK)

    def trial(params: Mapping) -> tuple[float, Model]:
        model = regressor.fit(train, dict(params))
        error = model.transform(validation).agg(mse(F.col("label"), F.col("prediction")).alias("mse"))
        return error.first()["mse"], model

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            made = list(pool.map(trial, grid))
    finally:
        train.unpersist()
        validation.unpersist()
    records = [
        {"trial": i, **{p.name: v for p, v in params.items()}, "mse": error}
        for i, (params, (error, _)) in enumerate(zip(grid, made))
    ]
    return records, min(made, key=lambda m: m[0])[1]
