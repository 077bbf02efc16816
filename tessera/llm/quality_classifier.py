"""Operator 1: Bradley-Terry quality classifier.

A document's score is linear in features of its whole text. The weights are learned from preference pairs (a
document of label 1 over one of label 0) by logistic loss on feature differences; the threshold is the quantile
of the training scores that parts the labels best, and `score` is the logistic function of the distance to it,
so 0.5 is the threshold. Features come from a byte histogram and word counts; labels, lang, source and doc_id
are never among them.

Fitting reads at most MAX_TRAIN labelled rows, those with the smallest hashes of doc_id; only their features
(not texts) reach the driver. Null and empty texts have all features 0 and get a score like any other. Without
labelled rows of both kinds all weights are 0 and each score is 0.5. Repeated rows are scored each; of repeated
labels each counts. Only doc_id and text are read, so further columns can't clash. Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

#: Labelled rows that fitting reads at most, and preference pairs that it draws from them.
MAX_TRAIN, PAIRS = 20_000, 60_000

_groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b" \t", b"()[]{}\"'/\\@=+_-"]
_group_of = np.full(256, len(_groups), np.int64)
for _i, _g in enumerate(_groups):
    _group_of[np.frombuffer(_g, np.uint8)] = _i
_group_of[128:] = len(_groups) + 1
N_FEATURES = len(_groups) + 2 + 9


def features(text: bytes) -> np.ndarray:
    """Features of one text in UTF-8; all 0 without a word."""
    out = np.zeros(N_FEATURES)
    words = text.split()
    if not words:
        return out
    n, k = len(words), len(_groups) + 2
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:k] = np.sqrt(np.bincount(_group_of, histogram, minlength=k) / len(text))
    counts = Counter(words)
    lines = text.split(b"\n")
    out[k:] = (
        np.log1p(n) / 5,
        len(text) / n / 10,
        len(counts) / n ** 0.9,
        np.sqrt(max(counts.values()) / n),
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.sqrt(1 - len(set(zip(words, words[1:]))) / max(n - 1, 1)),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.log1p(n / len(lines)) / 5,
        1.0 if n < 10 else 0.0,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -30, 30)))


def fit_arrays(x: np.ndarray, label: np.ndarray, seed: int = 7, rounds: int = 300) -> Model:
    """Model of features and 0/1 labels."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    model = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0)
    if not len(good) or not len(bad):
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    rng = np.random.default_rng(seed)
    apart = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w, m, v = model.weights, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(np.clip(apart @ w, -30, 30)))
        g = -(p @ apart) / PAIRS + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    s = z @ w
    order = np.sort(s)
    cuts = np.quantile(order, np.linspace(0, 1, 401))
    right = [((s[good] >= c).mean() + (s[bad] < c).mean()) for c in cuts]
    best = np.flatnonzero(np.isclose(right, max(right)))
    model.threshold = float(cuts[best].mean())
    model.spread = float(max(np.std(s), 1e-3) / 3)
    return model


@arrow_udf(ArrayType(DoubleType()))
def _features_of(text: pa.Array) -> pa.Array:
    return pa.array([features(t or b"") for t in text.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the texts of docs (doc_id, text) that labels (doc_id, label) has."""
    known = labels.select("doc_id", "label").where("doc_id IS NOT NULL AND label IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "label", _features_of("text").alias("x")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))
    return fit_arrays(np.array([r.x for r in rows]).reshape(-1, N_FEATURES), np.array([r.label for r in rows], int))


def scorer(docs: DataFrame, model: Model):
    """Function of a text column that gives its score."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        x = [features(t or b"") for t in text.cast(pa.binary()).to_pylist()]
        return pa.array(known.value.score(np.array(x).reshape(-1, N_FEATURES)), pa.float64())

    return lambda text: score(text.cast("string"))


def scored(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """doc_id, any further columns asked for, score and predicted."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, scorer(docs, model)(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject."""
    return docs.where(scorer(docs, model)(F.col("text")) >= 0.5)
