"""Boosted regression trees that stop by themselves.

Features are cut into bins once. Each round then grows one tree on the residuals
of a stored margin: a level of the tree is one aggregation of counts and sums by
node, feature and bin, and the driver sees those histograms only. The margin of
every row is written with each round, so a round reads a narrow table, lost
executors cost one round at most, and no tree is evaluated twice.

After each round the validation rows are scored. On a plateau the step is
halved; after `patience` rounds without a better score boosting ends, the
rounds up to the best one are kept, and nothing is fitted after that.

A missing value takes the right branch of every split. Without validation rows
all rounds are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from operator import add

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.values import missing_to_null
from gridcast.session import discard, scratch_path

#: A split must be better than the best one so far by this share: equal ones do not depend on the order of sums.
CLEARLY = 1e-9


@dataclass(frozen=True)
class Split:
    feature: str
    cut: float
    left: Split | float
    right: Split | float


def tree_value(tree: Split | float, of: Callable[[str], Column]) -> Column:
    """A tree as one expression; `of` gives the column of a feature."""
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    left, right = tree_value(tree.left, of), tree_value(tree.right, of)
    return F.when(of(tree.feature) <= tree.cut, left).otherwise(right)


@dataclass(frozen=True)
class Round:
    step: float
    error: float | None


@dataclass(frozen=True)
class BoostedTrees:
    """The kept trees, and what every fitted round scored."""

    features: tuple[str, ...]
    base: float
    trees: tuple[Split | float, ...]
    rounds: tuple[Round, ...]

    def value(self, of: Callable[[str], Column]) -> Column:
        return reduce(add, [tree_value(t, of) for t in self.trees], F.lit(self.base))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Adds the prediction, from the vector `features` if there is one, else from the columns themselves."""
        if "features" in df.columns:
            place = {f: i for i, f in enumerate(self.features)}
            held = df.withColumn("_x", vector_to_array("features"))
            return held.withColumn(name, self.value(lambda f: F.col("_x")[place[f]])).drop("_x")
        return df.withColumn(name, self.value(lambda f: missing_to_null(f)))


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit; `plateau` rounds without a better score shorten the step by `factor`."""

    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    patience: int = 30
    plateau: int = 10
    factor: float = 0.5
    least_step: float = 1e-9
    bins: int = 32
    least_rows: int = 1

    def fit(self, rows: DataFrame, features: Sequence[str], label: str, is_validation: str) -> BoostedTrees:
        spark = rows.sparkSession
        rows = rows.where(missing_to_null(label).isNotNull())
        train = rows.where(~F.col(is_validation))
        base = train.agg(F.avg(label)).first()[0]
        if base is None:
            raise ValueError("no training rows")
        cuts = feature_cuts(train, features, self.bins)
        names = [f"_b{i}" for i in range(len(features))]
        binned = [bin_of(f, cuts[f]).cast("smallint").alias(b) for f, b in zip(features, names)]
        y, valid = F.col(label).cast("double").alias("_y"), F.col(is_validation).alias("_valid")
        path = scratch_path(spark, "margin")
        rows.select(y, valid, *binned, F.lit(float(base)).alias("_margin")).write.parquet(path)

        trees, rounds, best, best_at, waited, step = [], [], None, -1, 0, self.step
        for i in range(self.rounds):
            held = spark.read.parquet(path)
            tree = grow(held.where("NOT _valid"), [len(cuts[f]) for f in features], self.depth, step, self.least_rows)
            if not isinstance(tree, Split):
                break  # no split helps any more
            path, old = scratch_path(spark, "margin"), path
            held.withColumn("_margin", F.col("_margin") + tree_value(tree, F.col)).write.parquet(path)
            discard(spark, old)
            square = (F.col("_y") - F.col("_margin")) * (F.col("_y") - F.col("_margin"))
            error = spark.read.parquet(path).where("_valid").agg(F.avg(square)).first()[0]
            trees.append(_named(tree, features, cuts))
            rounds.append(Round(step, error))
            if error is None or best is None or error < best:
                best, best_at, waited = error, i, 0
                continue
            waited += 1
            if i - best_at >= self.patience:
                break
            if waited >= self.plateau:
                step, waited = max(step * self.factor, self.least_step), 0
        discard(spark, path)
        return BoostedTrees(tuple(features), float(base), tuple(trees[: best_at + 1]), tuple(rounds))


def feature_cuts(rows: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Where each feature is cut: between all its values if there are at most `bins`, else at quantiles."""
    shares = [k / bins for k in range(1, bins)]
    values = {f: missing_to_null(f) for f in features}
    first = rows.agg(
        *[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(values.values())],
        *[F.percentile_approx(v, shares, 10_000).alias(f"q{i}") for i, v in enumerate(values.values())],
    ).first()
    few = [i for i in range(len(features)) if first[f"n{i}"] <= 2 * bins]
    sets = rows.agg(*[F.collect_set(values[features[i]]).alias(f"s{i}") for i in few]).first() if few else {}  # a few values each
    out = {}
    for i, f in enumerate(features):
        seen = sorted(sets[f"s{i}"]) if i in few else None
        if seen is not None and len(seen) <= bins:
            out[f] = [(a + b) / 2 for a, b in pairwise(seen)]
        else:
            out[f] = sorted(set(first[f"q{i}"]))
    return out


def bin_of(feature: str, cuts: Sequence[float]) -> Column:
    """How many cuts lie below the value; a missing value lies above all."""
    x = missing_to_null(feature)
    above = reduce(add, [(x > c).cast("int") for c in cuts], F.lit(0))
    return F.coalesce(above, F.lit(len(cuts)))


def grow(rows: DataFrame, cuts: Sequence[int], depth: int, step: float, least_rows: int = 1) -> Split | float:
    """One tree on `_y - _margin` over the bins `_b0`, `_b1`, …, its leaves scaled by `step`; splits are at bin numbers."""
    splits: dict[int, tuple[int, int]] = {}  # node → feature and bin; the children of node i are 2i and 2i + 1
    means: dict[int, float] = {}

    def node_of(i: int, level: int) -> Column:
        if i not in splits or level == 0:
            return F.lit(i)
        f, cut = splits[i]
        return F.when(F.col(f"_b{f}") <= cut, node_of(2 * i, level - 1)).otherwise(node_of(2 * i + 1, level - 1))

    for level in range(depth):
        open_nodes = [i for i in range(1 << level, 2 << level) if level == 0 or i // 2 in splits]
        if not open_nodes:
            break
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_b{f}").alias("b")) for f in range(len(cuts))]))
        placed = rows.select(node_of(1, level).alias("node"), (F.col("_y") - F.col("_margin")).alias("r"), cells.alias("cell"))
        placed = placed.where(F.col("node").isin(open_nodes)).groupBy("node", "cell.f", "cell.b")
        histogram: dict[int, dict[int, dict[int, tuple[int, float]]]] = {}
        for r in placed.agg(F.count("*").alias("n"), F.sum("r").alias("s")).collect():  # nodes × features × bins at most
            histogram.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.n, r.s)
        for node, by_feature in histogram.items():
            found = best_split(by_feature, cuts, least_rows)
            if level == 0:
                means[node] = _total(by_feature)
            if found is not None:
                splits[node], (means[2 * node], means[2 * node + 1]) = found

    def made(i: int) -> Split | float:
        if i not in splits:
            return means.get(i, 0.0) * step
        f, cut = splits[i]
        return Split(f"_b{f}", cut, made(2 * i), made(2 * i + 1))

    return made(1)


def _total(by_feature: dict[int, dict[int, tuple[int, float]]]) -> float:
    cells = list(next(iter(by_feature.values())).values())
    return sum(s for _, s in cells) / sum(n for n, _ in cells)


def best_split(by_feature: dict, cuts: Sequence[int], least_rows: int) -> tuple[tuple[int, int], tuple[float, float]] | None:
    """Feature and bin with the least squared error on both sides, the first of equals, and the means there."""
    best, found = 0.0, None
    for f in sorted(by_feature):
        cells = by_feature[f]
        n, s = (sum(c[k] for c in cells.values()) for k in (0, 1))
        nl, sl = 0, 0.0
        for b in range(cuts[f]):
            more = cells.get(b)
            if more is None:
                continue
            nl, sl = nl + more[0], sl + more[1]
            nr, sr = n - nl, s - sl
            if min(nl, nr) < max(least_rows, 1):
                continue
            gain = sl * sl / nl + sr * sr / nr - s * s / n
            if gain > best * (1 + CLEARLY) and gain > 1e-12:
                best, found = gain, ((f, b), (sl / nl, sr / nr))
    return found


def _named(tree: Split | float, features: Sequence[str], cuts: dict[str, list[float]]) -> Split | float:
    """The tree over the features' own values."""
    if not isinstance(tree, Split):
        return tree
    f = features[int(tree.feature[2:])]
    return Split(f, cuts[f][int(tree.cut)], _named(tree.left, features, cuts), _named(tree.right, features, cuts))
