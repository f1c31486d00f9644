"""Toxicity scores by non-negative positive-unlabelled learning.

The learner sees confirmed toxic documents and documents of any kind, never a
document called clean. With the class prior p, the risk of a classifier is
p * (risk of the positives as toxic) + max(0, risk of the unlabelled as clean -
p * risk of the positives as clean); where the second part falls below zero in
a batch, the step goes back up instead, so that the unlabelled toxic texts are
not learnt as clean.

A text is the set of its words, and a word counts with its beginnings, so that
inflected forms help one another. The score is the logistic of a sum over the
distinct words of the whole text, of any length.

What is bounded: at most about `MAX_POSITIVE` toxic and `MAX_UNLABELLED` other
documents are what weights are learnt from, drawn by a hash of their id. The
features are those of the toxic sample. How many documents have each of them,
and with that which ones tell and the class prior, is counted over all
documents, where the texts lie, combined in each task. The classifiers (`BAGS`
of them, each without another part of the unlabelled sample) are trained in
tasks, from feature numbers only. Every document is scored in full.

Defined cases. Null text counts as empty; a text without words gets the score
of the intercept. Rows repeated in the documents are scored alike. Labels other
than 0 and 1 are ignored; repeated label rows count once, and as toxic if one of
them says so. A row without a doc_id is not held out and has no label, but counts among
all documents. Without any toxic example every score is 0. Other columns are not
read. Empty tables give empty results. Without any telling feature every score is the
prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.session import stored

MAX_POSITIVE = 6000
MAX_UNLABELLED = 12_000
BAGS = 3
BEGINNINGS = (4, 5, 6, 7)
#: A feature is kept if at least so many toxic samples have it, and so many deviations more than expected.
LEAST_DOCS = 5
SURPRISE = 4.0
#: The class prior is taken from so many features, the most surprising ones, and a little lower: too high
#: a prior makes the risk of the clean negative, too low a one only dulls the scores.
PURE = 30
PRIOR_MARGIN = 0.95
THRESHOLD = 0.7
#: Features whose counts a task combines before it hands them on.
COUNTED = 300_000
#: Word weights that a scoring worker remembers.
CACHE_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def document_features(text: str | None) -> Counter:
    """How many distinct words of the text have each feature."""
    return Counter(f for w in words_of(text) for f in features_of(w))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


@dataclass
class Model:
    prior: float
    bias: float = -math.inf
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return math.fsum(self.weights.get(f, 0.0) for f in features_of(word))

    def score(self, text: str | None, known: dict[str, float]) -> float:
        if self.bias == -math.inf:
            return 0.0
        z = math.fsum([self.bias, *(known[w] for w in words_of(text))])
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class _Known(dict):
    """Word weights looked up before, up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.model.word(word)
        return value


def train(
    rows: list[np.ndarray], positive: np.ndarray, prior: float, size: int, seed: int = 0, epochs: int = 800, batches: int = 1,
    rate: float = 0.1, decay: float = 5e-5,
) -> np.ndarray:
    """Weights of `size` features and the intercept, by Adam on the non-negative risk.

    rows: feature numbers of each document, a number repeated as often as it counts.
    In small batches chance alone makes the risk of the clean negative, so one
    batch is the default; the samples are bounded.
    """
    rng = np.random.default_rng(seed)
    weights = np.zeros(size + 1)
    weights[-1] = math.log(prior / (1 - prior))
    mean, square, step = np.zeros(size + 1), np.zeros(size + 1), 0
    groups = [np.flatnonzero(positive), np.flatnonzero(~positive)]
    if not len(groups[0]) or not len(groups[1]):
        return weights

    def laid_out() -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """Per batch: features, their documents, positives (which come first), unlabelled."""
        out = []
        for p, u in zip(*[np.array_split(rng.permutation(g), batches) for g in groups]):
            if len(p) and len(u):
                take = [rows[i] for i in np.r_[p, u]]
                owner = np.repeat(np.arange(len(take)), [len(x) for x in take])
                out.append((np.concatenate(take).astype(np.int64), owner, len(p), len(u)))
        return out

    dealt = laid_out()
    for _ in range(epochs):
        for features, owner, n, others in dealt if batches == 1 else laid_out():
            z = np.bincount(owner, weights[features], n + others) + weights[-1]
            toxic = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            # slopes of the three risks in z: the loss is the logistic one
            as_toxic = np.r_[(toxic[:n] - 1) / n, np.zeros(others)]
            p_clean = np.r_[toxic[:n] / n, np.zeros(others)]
            u_clean = np.r_[np.zeros(n), toxic[n:] / others]
            loss = np.logaddexp(0, z)
            rest = loss[n:].mean() - prior * loss[:n].mean()
            slope = prior * as_toxic + (u_clean - prior * p_clean) if rest >= 0 else prior * p_clean - u_clean
            gradient = np.bincount(features, slope[owner], size + 1).astype(float)
            gradient[-1] = slope.sum()
            gradient[:-1] += decay * weights[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def _share(doc_id: Column, seed: str) -> Column:
    """A uniform number in [0, 1) of an id."""
    digest = F.md5(F.concat_ws("/", F.lit(seed), doc_id.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["f", "n"])


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to counts of documents by feature, combined up to `COUNTED` features at a time."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(set(document_features(text.as_py())))
            if len(counts) > COUNTED:
                yield _counted(counts)
                counts.clear()
    yield _counted(counts)


class _Numbers(dict):
    """The numbers of a word's features, looked up before, up to a bound."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = [self.number[f] for f in features_of(word) if f in self.number]
        return value


def document_counts(docs: DataFrame, names: list[str], text: str = "text") -> np.ndarray:
    """How many of all documents have each of these features."""
    sent = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Numbers(sent.value), np.zeros(len(names), np.int64)
        for batch in batches:
            for value in batch.column(0):
                found: set[int] = set()
                for word in words_of(value.as_py()):
                    found.update(known[word])
                counts[list(found)] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["f", "n"])

    made = docs.select(F.col(text)).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    out = np.zeros(len(names), np.int64)
    for r in made.collect():  # a row for each feature of the sample
        out[r.f] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from the labels of rows that are not held out, and unlabelled text."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic:
        return Model(0.0)
    prior = min(max(n_toxic / n_known, 0.001), 0.9)
    chosen = known.where((F.col("toxic") == 1) & (_share(F.col("doc_id"), "toxic") < MAX_POSITIVE / n_toxic))
    toxic = chosen.select(F.col("doc_id").alias("id"), F.lit(True).alias("toxic"))
    n_docs = docs.count()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(toxic), "id", "left")  # about MAX_POSITIVE ids at most
    drawn = _share(F.col("id"), "any") < MAX_UNLABELLED / max(n_docs, 1)
    roles = F.array_compact(F.array(F.when(F.col("toxic"), 1), F.when(F.coalesce(drawn, F.lit(False)), 0)))
    sample = rows.where(F.size(roles) > 0).select("id", F.explode(roles).alias("role"), "text")
    sample = stored(sample, "sample")
    n_positive = sample.where("role = 1").count()
    n_other = sample.where("role = 0").count()
    if not n_positive or not n_other:
        return Model(0.0)

    toxic_texts = sample.where("role = 1").select("text")
    seen = toxic_texts.mapInArrow(_count_features, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    seen = sorted(map(tuple, seen.collect()))  # features of the toxic sample
    every = document_counts(docs, [f for f, _ in seen], text)
    found = []
    for (f, p), u in zip(seen, every.tolist()):
        usual = (u + 1) / (n_docs + 1)
        lift = p / n_positive / usual
        surprise = (p / n_positive - usual) / math.sqrt(max(usual * (1 - usual), 0.0) / n_positive + 1e-12)
        # a feature of toxic texts alone has the lift 1 / prior, as the unlabelled hold that share of them;
        # those features give the prior of the unlabelled, which need not be that of the labelled
        if lift >= 1 + (1 / prior - 1) / 6 and surprise >= SURPRISE:
            found.append((-surprise, f, p, u))
    found.sort()
    names = [f for _, f, _, _ in found]
    pure = found[:PURE]
    if pure:
        prior = PRIOR_MARGIN * sum(u for *_, u in pure) * n_positive / (sum(p for _, _, p, _ in pure) * n_docs)
        prior = min(max(prior, 0.001), 0.9)
    if not names:
        return Model(prior, math.log(prior / (1 - prior)))
    number = {f: i for i, f in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[number[f] for f in document_features(t.as_py()).elements() if f in number] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "role", "f"])

    lists = stored(sample.mapInArrow(numbered, "id long, role int, f array<int>"), "features")
    bag = F.when(F.col("role") == 1, F.array(*[F.lit(b) for b in range(BAGS)])).otherwise(
        F.array_remove(F.array(*[F.lit(b) for b in range(BAGS)]), F.pmod(F.xxhash64("id", F.lit("bag")), F.lit(BAGS)).cast("int"))
    )
    size = len(names)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["role", "id"])  # the same order in every run
        found = [np.asarray(x) for x in rows["f"]]
        weights = train(found, rows["role"].to_numpy() == 1, prior, size, seed=int(rows["bag"].iloc[0]))
        return pd.DataFrame({"w": [weights]})

    made = lists.withColumn("bag", F.explode(bag)).groupBy("bag").applyInPandas(fitted, "w array<double>").collect()
    weights = np.mean(np.sort([r.w for r in made], axis=0), axis=0)
    return Model(prior, float(weights[-1]), {f: float(w) for f, w in zip(names, weights) if w})


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model)
        for batch in batches:
            scores = [model.score(t.as_py(), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on)."""
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns; nothing is shuffled."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Known(model)
        for some in texts:
            yield pd.Series([model.score(t, known) for t in some], dtype=float)

    return docs.where(scored(F.col(text)) < threshold)
