"""Positive-unlabelled learning: held-out accuracy, risk slopes, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import toxicity

BAD = ["gruk", "vilop", "zarnt"]


def made(n=3000, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghilmnoprst", k=rng.randint(2, 8))) for _ in range(800)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(1, 120))
        toxic = rng.random() < 0.12
        for _ in range(rng.randint(1, 4) if toxic else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(BAD) + rng.choice(["", "en", "ado", "!"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double").repartition(4)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 5 < 2], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(fitted):
    rows, docs, _, model = fitted
    truth = {i: t for i, _, t in rows}
    got = toxicity.judged(docs, model).collect()
    assert len(got) == len(rows)
    out = [(truth[r.doc_id], r.predicted) for r in got if r.held_out]
    assert sum(a and b for a, b in out) >= 0.9 * sum(a for a, _ in out)
    assert sum(b and not a for a, b in out) <= 0.01 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_labels_of_held_out_rows_are_not_read(spark, fitted):
    _, docs, labels, model = fitted
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs.withColumn("lang", F.lit("other")).repartition(7), flipped)
    assert again == model


def test_plain_score(fitted):
    _, _, _, model = fitted
    text = "Gruken and gruken, a vilop"
    z = model.bias + sum(model.weights.get(f, 0) for w in {"gruken", "and", "a", "vilop"} for f in toxicity.features_of(w))
    assert model.score(text, toxicity._Known(model)) == pytest.approx(1 / (1 + np.exp(-z)))


def test_odd_rows(spark, fitted):
    _, _, labels, model = fitted
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "gruk vilop zarnt", 3), (3, "gruk vilop zarnt", 3), (None, "x", 4), (4, "word " * 200_000 + "gruk vilop zarnten", 5)], "doc_id long, text string, toxic int")
    got = {(r.doc_id, r.predicted) for r in toxicity.judged(docs, model).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (None, 0), (4, 1)}
    assert toxicity.accepted(docs, model).columns == docs.columns
    assert sorted(str(r.doc_id) for r in toxicity.accepted(docs, model).collect()) == ["1", "2", "None"]
    none = docs.where(F.lit(False))
    assert toxicity.judged(none, toxicity.fit(none, labels)).count() == 0
    unknown = toxicity.fit(docs, labels.where(F.lit(False)))
    assert {r.score for r in toxicity.judged(docs, unknown).collect()} == {0.0}


def test_weights_lower_the_risk():
    rng = np.random.default_rng(0)
    positive = rng.random(800) < 0.3
    toxic = positive | (rng.random(800) < 0.1)
    rows = [np.r_[np.flatnonzero(rng.random(6) < 0.3) + 2, [0] if t else []].astype(int) for t in toxic]
    weights = toxicity.train(rows, positive, 0.1, 8)
    assert weights[0] > 3 and abs(weights[2:8]).max() < 1.5 and weights[-1] < -1


def test_counts_cover_all_documents(spark, monkeypatch):
    """Frequencies and prior come from every document, however few are sampled."""
    rows = made(900, seed=4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    names = ["gruk", "gruk*", "vilo*", "nosuchword"]
    want = [sum(f in toxicity.document_features(t) for _, t, _ in rows) for f in names]
    assert toxicity.document_counts(docs, names).tolist() == want
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 5 < 2], "doc_id long, toxic int")
    seen, count = [], toxicity.document_counts
    monkeypatch.setattr(toxicity, "document_counts", lambda d, n, t: seen.append(d.count()) or count(d, n, t))
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 100)
    few = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 900)
    many = toxicity.fit(docs, labels)
    assert seen == [900, 900] and few.prior == many.prior and few.weights.keys() == many.weights.keys()


def plain_learner(rows, positive, prior, size, epochs, rate, decay):
    """The non-negative risk by dense sums, its slope by hand, and Adam."""
    x = np.zeros((len(rows), size + 1))
    for i, r in enumerate(rows):
        x[i, -1] = 1
        for f in r:
            x[i, f] += 1
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    p, u = x[positive], x[~positive]
    for t in range(1, epochs + 1):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        clean = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()
        g_clean = su @ u / len(u) - prior * sp @ p / len(p)
        g = prior * (sp - 1) @ p / len(p) + g_clean if clean >= 0 else -g_clean
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@pytest.mark.parametrize("prior", [0.05, 0.6])
def test_training_equals_a_plain_learner(prior):
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 8, rng.integers(0, 7)) for _ in range(60)]
    positive = np.arange(60) < 25
    rows = [np.r_[r, [0] * 3] if p and i % 2 else r for i, (r, p) in enumerate(zip(rows, positive))]
    got = toxicity.train(rows, positive, prior, 8, epochs=150)
    want = plain_learner(rows, positive, prior, 8, 150, 0.1, 5e-5)
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-8)
