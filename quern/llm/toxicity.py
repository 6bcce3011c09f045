"""Toxicity of documents by multiple-instance learning.

Only documents are labelled. Each sentence has a probability, the logistic function of a
bias and the weights of its distinct words; a document is toxic if any sentence is, so its score
is the noisy-or, one minus the product of the sentences' complements. Weights are fitted by the
likelihood of the document labels: its gradient deals the blame for a toxic document among its
sentences by how likely each is by itself. Sentences that carry it can then be located.

The weight of a word is the sum over its features: the word, its beginnings and its ends,
so that unseen forms of a word are known by their stem. Weights are evidence for toxicity and never below zero, so
harmless words can't hide a harmful one. Spark counts the features of the labelled sample by
label, those that toxic documents have more often form the vocabulary, and each step of the
fit is one pass over the sample, in which a task returns one gradient.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold_memo, materialize, read_table

#: Bound on the training sample: documents of each label, those with a small md5 of their id.
TRAIN_ROWS = 6000
#: Most features of a model; a feature stands in so many documents and its share of the toxic ones is higher by so many standard errors.
FEATURES, LEAST_DOCS, LEAST_Z = 20_000, 2, 3.0
#: Steps of the fit, their length, the weight decay, and the tasks of a step.
STEPS, RATE, DECAY, TASKS = 40, 0.3, 2e-5, 6
START_BIAS = -4.0
#: Letters of the beginnings and ends that are features; longer words are not features as a whole.
STEMS, ENDS, LONGEST = range(3, 9), range(3, 6), 40
#: Words that a worker remembers.
MEMO_WORDS = 300_000
SENTENCE = re.compile(r"[^.!?…。！？\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Features of a lower-case word: `^` begins a stem, `$` an ending, `=` a whole word."""
    out = [f"={word}"] if len(word) <= LONGEST else []
    return out + [f"^{word[:k]}" for k in STEMS if k <= len(word)] + [f"${word[-k:]}" for k in ENDS if k <= len(word)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans, in code points, between ends of sentences or lines; those without a letter don't count."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(text, *m.span())]


def words(sentence: str) -> list[str]:
    return list(dict.fromkeys(WORD.findall(sentence.lower())))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


class Model:
    """A bias and the weights of features."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(w))


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def logits(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        if len(self.known) > MEMO_WORDS:
            self.known = {}
        out = np.full(len(spans), self.model.bias)
        for k, (a, b) in enumerate(spans):
            for w in words(text[a:b]):
                value = self.known.get(w)
                if value is None:
                    value = self.known[w] = self.model.word(w)
                out[k] += value
        return out


_scorers: dict[str, _Scorer] = {}


def _scorer(key: str, model: Model) -> _Scorer:
    hold_memo("toxicity", _scorers.clear)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(model)
    return _scorers[key]


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most about `rows` documents of each label, as (text, toxic).

    An id counts once: as toxic if any of its labels says so, with the text of least hash.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    # an even draw by the hash of the id, nine tenths of the bound on average
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("double") / float(16**15)
    part = lambda k: 1.0 if sizes.get(k, 0) <= rows else 0.9 * rows / sizes[k]
    drawn = known.where(place < F.when(F.col("toxic"), part(True)).otherwise(part(False)))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(drawn), "doc_id")  # bounded by rows
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, steps: int = STEPS) -> Model:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic).

    The sample is bounded by `rows` documents of each label and the model by FEATURES; what
    comes to the driver is the counts of the features that are kept, and TASKS gradients a
    step. Null texts, ids and labels are left out. Without documents of both labels the
    model has no weights and its scores are low.
    """
    sample = materialize(_sample(docs, labels, rows), "toxic-sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(n) < 2:
        return Model(START_BIAS, {})

    def count(frames: Iterator[pd.DataFrame]):
        for f in frames:
            found = (Counter(), Counter())
            for text, toxic in zip(f.text, f.toxic):
                found[toxic].update({x for w in set(WORD.findall(text.lower())) for x in features(w)})
            names = list(found[0].keys() | found[1].keys())
            yield pd.DataFrame({"feature": names, "plain": [found[0][x] for x in names], "toxic": [found[1][x] for x in names]})

    counts = sample.mapInPandas(count, "feature string, plain long, toxic long").groupBy("feature").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
    pooled = (F.col("plain") + F.col("toxic")) / float(n[False] + n[True])
    error = F.sqrt(pooled * (1 - pooled) * (1 / n[False] + 1 / n[True]))
    z = (F.col("toxic") / float(n[True]) - F.col("plain") / float(n[False])) / error
    kept = counts.where(F.col("plain") + F.col("toxic") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    vocabulary = {r.feature: k for k, r in enumerate(kept.orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect())}  # at most FEATURES rows
    context = sample.sparkSession.sparkContext
    sent = context.broadcast(vocabulary)

    def index(frames: Iterator[pd.DataFrame]):
        known = sent.value
        for f in frames:
            out = []
            for text, toxic in zip(f.text, f.toxic):
                spans, at, feature = sentences(text), [], []
                for k, (a, b) in enumerate(spans):
                    for w in words(text[a:b]):
                        found = [known[x] for x in features(w) if x in known]
                        feature += found
                        at += [k] * len(found)
                out.append((toxic, len(spans), at, feature))
            yield pd.DataFrame(out, columns=["toxic", "n", "at", "feature"])

    indexed = materialize(sample.mapInPandas(index, "toxic boolean, n int, at array<int>, feature array<int>").coalesce(TASKS), "toxic-indexed")
    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = START_BIAS
    # a rare label weighs more, but not as much as to make it as common
    share = {toxic: found**-0.5 for toxic, found in n.items()}
    share = {toxic: x / sum(share[k] * n[k] for k in n) for toxic, x in share.items()}
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        now = context.broadcast(theta)

        def gradient(frames: Iterator[pd.DataFrame], now=now):
            weights = now.value
            total = np.zeros_like(weights)
            for f in frames:
                for toxic, size, at, feature in zip(f.toxic, f.n, f["at"], f.feature):
                    if size:
                        _add_gradient(total, weights, share[toxic], toxic, size, np.asarray(at, np.int64), np.asarray(feature, np.int64))
            yield pd.DataFrame({"g": [total]})

        parts = indexed.coalesce(TASKS).mapInPandas(gradient, "g array<double>").collect()  # TASKS rows of FEATURES numbers
        slope = sum((np.asarray(r.g) for r in parts), np.zeros_like(theta))
        slope[:-1] += DECAY * theta[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0.0)
        now.unpersist()
    return Model(float(theta[-1]), {x: float(theta[k]) for x, k in vocabulary.items()})


def _add_gradient(total: np.ndarray, theta: np.ndarray, share: float, toxic: bool, size: int, at: np.ndarray, feature: np.ndarray) -> None:
    """Add the gradient of one document's negative log likelihood, times share."""
    z = np.full(size, theta[-1])
    np.add.at(z, at, theta[feature])
    p = share / (1.0 + np.exp(-np.clip(z, -30, 30)))
    if toxic:
        none = -_softplus(z).sum()  # log of the probability that no sentence is toxic
        p *= -1.0 / np.expm1(np.clip(-none, 1e-9, 500.0))
    np.add.at(total, feature, p[at])
    total[-1] += p.sum()


def _send(docs: DataFrame, model: Model):
    key = f"{model.bias!r}:{hash(frozenset(model.weights.items()))}"
    return key, docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= 0.5), n_sentences, n_offending, worst_start and worst_end.

    Only the text is read. The worst sentence is given by its span in code points; of ties the
    first. A text that is null, empty or without letters has score 0 and no worst sentence.
    A text of any length is scored whole, sentence by sentence. Columns of these names are
    replaced, others kept.
    """
    names = ["score", "predicted", "n_sentences", "n_offending", "worst_start", "worst_end"]
    kept, (key, sent) = docs.drop(*names), _send(docs, model)

    @F.pandas_udf("score double, n_sentences int, n_offending int, worst_start int, worst_end int")
    def judge(texts: pd.Series) -> pd.DataFrame:
        scorer, out = _scorer(key, sent.value), []
        for text in texts:
            spans = sentences(text or "")
            if not spans:
                out.append((0.0, 0, 0, None, None))
                continue
            z = scorer.logits(text, spans)
            out.append((-np.expm1(-_softplus(z).sum()), len(z), int((z >= 0).sum()), *spans[int(z.argmax())]))
        frame = pd.DataFrame(out, columns=["score", "n_sentences", "n_offending", "worst_start", "worst_end"])
        return frame.astype({"worst_start": "Int32", "worst_end": "Int32"})

    judged = kept.withColumn("_judged", judge(F.col("text").cast("string")))
    return judged.select(*kept.columns, "_judged.score", (F.col("_judged.score") >= 0.5).cast("int").alias("predicted"), *[f"_judged.{c}" for c in names[2:]])


def locate_offending(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """A row for each sentence of at least the threshold: doc_id, start, end (code points), probability, sentence."""
    key, sent = _send(docs, model)

    @F.pandas_udf("array<struct<start:int,end:int,probability:double>>")
    def find(texts: pd.Series) -> pd.Series:
        scorer, out = _scorer(key, sent.value), []
        for text in texts:
            spans = sentences(text or "")
            p = np.exp(-_softplus(-scorer.logits(text, spans))) if spans else []
            out.append([{"start": a, "end": b, "probability": float(x)} for (a, b), x in zip(spans, p) if x >= threshold])
        return pd.Series(out)

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.explode(find(text)).alias("at"))
    return rows.select("doc_id", "at.start", "at.end", "at.probability", F.expr("substring(text, at.start + 1, at.end - at.start)").alias("sentence"))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Fit on labels of rows that are not held out, score every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic"))
    return score_documents(docs.withColumn("held_out", held_out()), model).drop("text")
