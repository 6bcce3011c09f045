import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.llm import toxicity as tox


def corpus(n=600, seed=3):
    """Documents of sentences; toxic ones have one sentence with a form of one of two stems."""
    rng = random.Random(seed)
    neutral = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        body = [" ".join(rng.choices(neutral, k=8)) for _ in range(rng.randint(1, 6))]
        toxic = k % 4 == 0
        if toxic:
            at = rng.randrange(len(body))
            body[at] += " " + rng.choice(["zork", "quuxl"]) + "".join(rng.choice("abcdefgh") for _ in range(3))
        docs.append((k, ". ".join(body) + ("." if k % 2 else "\n"), "x", "y"))
        labels.append((k, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, score string, at string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(tables):
    return tox.train(tables[0], tables[1].where(~tox.held_out()))


def test_held_out_accuracy_and_location(tables, model):
    docs, labels = tables
    rows = tox.score_documents(docs, model).join(labels, "doc_id").where(tox.held_out()).select("doc_id", "text", "score", "predicted", "toxic", "worst_start", "worst_end", "n_offending").collect()
    assert len(rows) > 80
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    for r in rows:
        if r.predicted and r.toxic:
            worst = r.text[r.worst_start : r.worst_end]
            assert "zork" in worst or "quuxl" in worst
            assert r.n_offending >= 1
    spans = tox.locate_offending(docs, model).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert spans and all(text[r.doc_id][r.start : r.end] == r.sentence and r.probability >= 0.5 for r in spans)


def test_score_is_noisy_or(tables, model):
    """The score, from each sentence's own probability, word by word."""
    for r in tox.score_documents(tables[0], model).limit(50).collect():
        none = 1.0
        for a, b in tox.sentences(r.text):
            z = model.bias + sum(model.weights.get(f, 0.0) for w in tox.words(r.text[a:b]) for f in tox.features(w))
            none *= 1 - 1 / (1 + np.exp(-z))
        assert r.score == pytest.approx(1 - none, abs=1e-9)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    theta, at, feature = rng.normal(size=6), np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1, 3, 4])

    def loss(t, toxic):
        z = np.full(4, t[-1])
        np.add.at(z, at, t[feature])
        none = -np.logaddexp(0, z).sum()
        return -np.log(-np.expm1(none)) if toxic else -none

    for toxic in (False, True):
        total = np.zeros(6)
        tox._add_gradient(total, theta, 1.0, toxic, 4, at, feature)
        slope = [(loss(theta + e, toxic) - loss(theta - e, toxic)) / 2e-5 for e in np.eye(6) * 1e-5]
        assert total == pytest.approx(slope, rel=1e-4, abs=1e-8)


def test_edges(spark, tables, model):
    rows = [(1, None), (None, ""), (2, " .\n!"), (3, "12 34"), (4, "zorkabc"), (4, "zorkabc"), (5, "plain words " * 100_000), (6, "x" * 1_000_000)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, predicted string, n_sentences int")
    out = tox.score_documents(docs, model).select("doc_id", "score", "predicted", "n_sentences", "worst_end").collect()
    assert len(out) == len(rows)
    assert [(r.score, r.predicted, r.n_sentences, r.worst_end) for r in out[:4]] == [(0.0, 0, 0, None)] * 4
    assert out[4] == out[5] and out[4].predicted == 1
    assert all(0 <= r.score <= 1 for r in out)
    assert tox.score_documents(docs.limit(0), model).count() == 0 and tox.locate_offending(docs.limit(0), model).count() == 0


def test_train_without_labels_and_with_odd_ones(spark, tables):
    docs, labels = tables
    bare = tox.train(docs, labels.limit(0))
    assert bare.weights == {} and tox.score_documents(docs, bare).agg(F.max("score")).first()[0] < 0.5
    assert tox.train(docs, labels.where("toxic = 0")).weights == {}
    # nulls, repeated ids and labels that differ: an id counts once, as toxic
    odd = labels.unionByName(labels.limit(40)).unionByName(spark.createDataFrame([(None, 1, 1), (4, 1, None), (8, 1, 0)], labels.schema))
    twice = docs.unionByName(docs.where("doc_id < 50"))
    sample = tox._sample(twice, odd, 10_000)
    assert sample.count() == docs.count() and sample.where("toxic").count() == 150
    assert tox._sample(docs, labels, 50).count() < 150
