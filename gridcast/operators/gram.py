"""Linear models from sums of products.

One pass over the rows gives, for each group, the matrix of sums of products of
all columns (a Gram matrix). Matrices add up and can be taken from one another:
the training rows of a fold are all rows less the fold's own. Every linear model
of every fold, split or response is then solved on a small matrix: least squares
and ridge by Cholesky, lasso and elastic net by coordinate descent. The driver
holds one matrix per group, whose size does not depend on the rows.

Rows that lack one of the columns are left out. Sums are taken about a rough
centre, so that large offsets cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.values import all_of, missing_to_null
from gridcast.operators.stats import error_metrics
from gridcast.session import stored

#: Rows of which the rough centre is the mean.
CENTRE_ROWS = 1024
TOLERANCE, SWEEPS = 1e-12, 100_000


@dataclass(frozen=True)
class Gram:
    """Sums of products of (1, columns - centre)."""

    columns: tuple[str, ...]
    centre: np.ndarray
    sums: np.ndarray

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.columns, self.centre, self.sums - other.sums)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.columns, self.centre, self.sums + other.sums)

    @property
    def n(self) -> float:
        return self.sums[0, 0]

    @property
    def means(self) -> np.ndarray:
        return self.centre + self.sums[0, 1:] / max(self.n, 1)

    @property
    def covariance(self) -> np.ndarray:
        """Population covariances."""
        first = self.sums[0, 1:] / max(self.n, 1)
        return self.sums[1:, 1:] / max(self.n, 1) - np.outer(first, first)

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.columns.index(c) for c in names]


def gram_matrices(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], by: Sequence[Column | str]) -> dict[tuple, Gram]:
    """The Gram matrix of the columns for every value of the groups, which are few and of integers or booleans.

    Each task sums its batches by matrix products and hands on one matrix per
    group; matrices are added up by place.
    """
    exprs = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    groups = [(F.col(g) if isinstance(g, str) else g).cast("long").alias(f"_g{i}") for i, g in enumerate(by)]
    p, n_groups = len(exprs) + 1, len(groups)
    values = F.array(*[F.coalesce(missing_to_null(c), F.lit(float("nan"))) for c in exprs.values()])
    rows = df.select(*groups, values.alias("_v")).where(all_of([F.col(f"_g{i}").isNotNull() for i in range(n_groups)]))
    few = rows.limit(CENTRE_ROWS).select(F.posexplode("_v").alias("at", "x")).groupBy("at").agg(F.avg(missing_to_null("x")).alias("x"))
    centre = np.zeros(p - 1)
    for r in few.collect():
        centre[r["at"]] = r["x"] or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(n_groups)], axis=1) if n_groups else np.zeros((batch.num_rows, 0), np.int64)
            x = np.ones((batch.num_rows, p))
            x[:, 1:] = batch.column(n_groups).flatten().to_numpy().reshape(-1, p - 1) - centre
            whole = ~np.isnan(x).any(axis=1)
            keys, x = keys[whole], x[whole]
            distinct, which = np.unique(keys, axis=0, return_inverse=True) if n_groups else (keys[:1], np.zeros(len(keys), int))
            for k, key in enumerate(distinct.tolist()):
                part = x[which.ravel() == k]
                held[tuple(key)] = held.get(tuple(key), 0.0) + part.T @ part
        lists = [pa.array([k[i] for k in held], pa.int64()) for i in range(n_groups)]
        sums = pa.array([m.ravel().tolist() for m in held.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*lists, sums], [*[f"_g{i}" for i in range(n_groups)], "sums"])

    names = [f"_g{i}" for i in range(n_groups)]
    schema = ", ".join([*[f"{g} long" for g in names], "sums array<double>"])
    cells = rows.mapInArrow(run, schema).select(*names, F.posexplode("sums").alias("at", "x"))
    added = cells.groupBy(*names, "at").agg(F.sum("x").alias("x"))
    out: dict[tuple, np.ndarray] = {}
    for r in added.collect():  # groups × columns² numbers
        out.setdefault(tuple(r[g] for g in names), np.zeros(p * p))[r["at"]] = r["x"]
    return {k: Gram(tuple(exprs), centre, m.reshape(p, p)) for k, m in out.items()}


@dataclass(frozen=True)
class Penalised:
    """Half the mean squared error plus alpha * (ratio * |w| + (1 - ratio) / 2 * w²) on standardised features.

    Without alpha it is least squares; with ratio 0 ridge, with ratio 1 lasso.
    """

    alpha: float = 0.0
    ratio: float = 0.0

    def fit(self, rows: DataFrame, features: Sequence[str], label: str) -> LinearWeights:
        """The model of these rows, from one scan."""
        grams = gram_matrices(rows, [*features, label], [])
        if not grams:
            raise ValueError("no rows to fit on")
        weights = solve(grams[()], features, [label], self)[:, 0]
        return LinearWeights(tuple(features), tuple(weights.tolist()))


@dataclass(frozen=True)
class LinearWeights:
    """A fitted linear model: the intercept, then a weight for each feature."""

    features: tuple[str, ...]
    weights: tuple[float, ...]

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Adds the prediction, from the vector `features` if there is one, else from the columns themselves."""
        if "features" in df.columns:
            held = df.withColumn("_x", vector_to_array("features"))
            return held.withColumn(name, linear_value(self.weights, [F.col("_x")[i] for i in range(len(self.features))])).drop("_x")
        return df.withColumn(name, linear_value(self.weights, [missing_to_null(f) for f in self.features]))


def slopes(covariance: np.ndarray, with_label: np.ndarray, model: Penalised) -> np.ndarray:
    """The weights for these covariances of the features, and of them with one label or several (columns)."""
    square, plain = model.alpha * (1 - model.ratio), model.alpha * model.ratio
    q = covariance + square * np.eye(len(covariance))
    if not plain:
        try:
            lower = np.linalg.cholesky(q)
            if lower.diagonal().min() > 1e-9 * max(lower.diagonal().max(), 1e-300):
                return np.linalg.solve(lower.T, np.linalg.solve(lower, with_label))
        except np.linalg.LinAlgError:
            pass
        return np.linalg.pinv(q, rcond=1e-12, hermitian=True) @ with_label  # features that depend on one another
    if with_label.ndim > 1:
        return np.stack([slopes(covariance, c, model) for c in with_label.T], axis=1)
    w = np.zeros(len(q))
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(q)):
            if q[j, j] <= 0:
                continue
            rest = with_label[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - plain, 0.0) / q[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= TOLERANCE * max(1.0, np.abs(w).max()):
            break
    return w


def solve(gram: Gram, features: Sequence[str], labels: Sequence[str], model: Penalised, scaled: bool = True) -> np.ndarray:
    """Intercept and weights (rows) of each label (columns), for the features in their own unit.

    `scaled` puts the penalty on features divided by their population deviation.
    """
    x, y = gram.at(features), gram.at(labels)
    cov, means = gram.covariance, gram.means
    spread = np.sqrt(np.maximum(cov[x, x], 0.0)) if scaled else np.ones(len(x))
    spread[spread <= 0] = 1.0
    w = slopes(cov[np.ix_(x, x)] / np.outer(spread, spread), cov[np.ix_(x, y)] / spread[:, None], model) / spread[:, None]
    return np.vstack([means[y] - means[x] @ w, w])


def mean_squares(gram: Gram, features: Sequence[str], labels: Sequence[str], weights: np.ndarray) -> np.ndarray:
    """The mean squared error of each label over the gram's rows."""
    x, y = gram.at(features), gram.at(labels)
    rest = gram.means[y] - weights[0] - gram.means[x] @ weights[1:]
    cov, w = gram.covariance, weights[1:]
    return rest**2 + cov[y, y] - 2 * np.sum(w * cov[np.ix_(x, y)], axis=0) + np.sum(w * (cov[np.ix_(x, x)] @ w), axis=0)


def linear_value(weights: Sequence[float], columns: Sequence[Column]) -> Column:
    """Intercept plus weighted columns."""
    out = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], columns):
        out = out + c * float(w)
    return out


def cross_validate_linear(
    df: DataFrame, models: Mapping[str, Penalised], features: Sequence[str], label: str, fold: str = "fold", folds: int = 10
) -> DataFrame:
    """Errors of every model on every fold, as :func:`gridcast.operators.models.cross_validate` gives them.

    One scan sums the folds, the models of all folds are solved from these sums,
    and one scan scores all of them.
    """
    values = [missing_to_null(c).alias(f"_x{i}") for i, c in enumerate(features)]
    rows = stored(df.select(F.col(fold).cast("int").alias(fold), *values, missing_to_null(label).alias("_y")), "folds")
    names = [f"_x{i}" for i in range(len(features))]
    grams = gram_matrices(rows, [*names, "_y"], [fold])
    if not grams:
        return rows.limit(0).select(F.lit("").alias("model"), fold).join(error_metrics(rows.limit(0), "_y", "_y", [fold]), fold)
    whole = sum(list(grams.values())[1:], next(iter(grams.values())))
    tables = {name: [[0.0] * (len(names) + 1)] * folds for name in models}
    for (i,), own in grams.items():
        for name, model in models.items():
            tables[name][int(i)] = solve(whole - own, names, ["_y"], model)[:, 0].tolist()
    cells = []
    for name, table in tables.items():
        w = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in table]), F.col(fold) + 1)
        value = w[0]
        for j, c in enumerate(names):
            value = value + w[j + 1] * F.col(c)
        cells.append(F.struct(F.lit(name).alias("model"), value.alias("prediction")))
    scored = rows.select(fold, "_y", F.inline(F.array(*cells)))
    return error_metrics(scored, "_y", "prediction", by=["model", fold])
