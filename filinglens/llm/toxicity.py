"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one word between them of a text, A-Z
lower-cased.  FTRL-proximal keeps a learning rate per coordinate and an L1 term that leaves most weights at
exactly zero, so the model is a short list of (feature, weight), at most ``2**bits`` long, that goes to every
task.

The model is fitted on at most ``labelled_rows`` labelled documents (whole texts, chosen by hash) in one task
of that bounded size; everything else is one pass over the documents without a shuffle.  Features in fewer than
``fewest`` of the fitted documents get no weight.

Null and empty texts have no features and get the score of the bias alone.  Repeated rows are scored each on
its own.  Without labelled rows every score is 0.5 and nothing is predicted toxic; an empty table gives an empty
result.  Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, fold, labels, whole_text
from filinglens.llm.kernel import LETTERS, LOWER, U, Hashes, grams, mix, words
from filinglens.llm.quality import sample_of

BITS = 20
LABELLED_ROWS = 8_000
FEWEST = 4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs and skip pairs with the text each stands in; repeats included."""
    low = LOWER[buf]
    s, e, first = words(low, offsets, LETTERS)
    h = Hashes(low).span(s, e)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair, at = grams(h, first, (1,))
    skip, over = grams(h, first, (2,))
    every = np.concatenate([mix(h + U(1)), mix(pair + U(2)), mix(skip + U(3))])
    return (every >> U(64 - bits)).astype(np.int64), np.concatenate([owner, owner[at], owner[over]])


class Ftrl:
    """FTRL-proximal over binary features; coordinate 2**bits is the bias."""

    def __init__(self, size: int, l1: float, alpha: float = 1.0, beta: float = 1.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, importance: float) -> None:
        w = self.weights(at)
        gradient = importance * (sigmoid(w.sum()) - label)
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient * gradient


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, sample: DataFrame, bits: int = BITS, fewest: int = FEWEST, epochs: int = 10, l1: float = 0.8) -> list[tuple[int, float]]:
    """The non-zero weights (feature, weight), learnt in one task from the sampled documents.

    Chance correlations grow as the root of the number of documents and so does the L1 term: ``l1`` times that root.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        rows: list[tuple[np.ndarray, int]] = []
        seen = np.zeros(1 << bits, np.int32)
        for batch in batches:
            label = batch.column("label").to_pylist()
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                f, owner = features(buf, offsets, bits)
                each = np.unique(owner << bits | f)
                cut = np.searchsorted(each, np.arange(hi - lo + 1) << bits)
                for i in range(hi - lo):
                    own = (each[cut[i] : cut[i + 1]] & ((1 << bits) - 1)).astype(np.int32)
                    seen[own] += 1
                    rows.append((own, label[lo + i]))
        if rows:
            bias = np.array([1 << bits])
            rows = [(np.append(own[seen[own] >= fewest], bias), label) for own, label in rows]
            toxic = sum(label for _, label in rows)
            rare = min(10.0, max(1.0, (len(rows) - toxic) / max(1, toxic)) ** 0.5)
            model = Ftrl((1 << bits) + 1, l1 * len(rows) ** 0.5)
            for _ in range(epochs):
                for own, label in rows:
                    model.learn(own, label, rare if label else 1.0)
            at = np.flatnonzero(model.n)
            w = model.weights(at)
            at, w = at[w != 0], w[w != 0]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["feature", "weight"])

    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(sample), "doc_id")
    one = drawn.select(F.xxhash64("doc_id", "text").alias("at"), "text", "label").repartition(1).sortWithinPartitions("at", "text", "label")
    return [(r["feature"], r["weight"]) for r in one.select("text", "label").mapInArrow(run, "feature long, weight double").collect()]


def scorer(weights: list[tuple[int, float]], bits: int = BITS):
    """A column function: the score of a text under the fitted weights."""
    at, value = np.array([a for a, _ in weights], np.int64), np.array([w for _, w in weights])

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[at] = value
        out = [np.zeros(0)]
        for lo, hi, buf, offsets in blocks(text):
            f, owner = features(buf, offsets, bits)
            hit = np.flatnonzero(dense[f])
            each = np.unique(owner[hit] << bits | f[hit])
            total = np.bincount(each >> bits, dense[each & ((1 << bits) - 1)].astype(np.float64), hi - lo)
            out.append(sigmoid(total + float(dense[-1])))
        return pa.array(np.concatenate(out), pa.float64())

    return score


def fitted_scorer(docs: DataFrame, labels_: DataFrame, labelled_rows: int = LABELLED_ROWS, bits: int = BITS, **options):
    """Fit on the labelled rows outside the held-out fold and return the scoring function."""
    bounded_batches(docs.sparkSession)
    return scorer(fit(docs, sample_of(labels_.filter(fold(FOLDS) != HELD_OUT), "toxic", labelled_rows), bits, **options), bits)


def judged(docs: DataFrame, labels_: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = fitted_scorer(docs, labels_, **options)
    return (docs.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), score(whole_text()).alias("score"))
            .select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")))


def without_toxic(docs: DataFrame, labels_: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the threshold."""
    return docs.filter(fitted_scorer(docs, labels_, **options)(whole_text()) < threshold)


def op6_ftrl_toxicity(spark, sf_dir):
    return judged(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {"op6_ftrl_toxicity": op6_ftrl_toxicity}
SQL = {}
