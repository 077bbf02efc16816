"""Operator 8: convolutional toxicity classifier.

Words (runs of letters, lower case) are hashed to embeddings; filters one, two and three words wide slide over
the whole text, their maxima over all positions feed one logistic unit. All is trained in numpy. A last part of
the training rows sets a threshold for each language, which is guessed from function words of the text itself,
never read from `lang`; the score is shifted so that 0.5 is that threshold.

Fitting reads at most MAX_TRAIN labelled rows, those with the smallest hashes of doc_id, as arrays of bucket
numbers. Null and empty texts and texts without letters get the score of no words. Without labelled rows of
both kinds every score is 0. Repeated rows are scored each. Only doc_id and text are read, so further columns
can't clash. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

#: Labelled rows that fitting reads at most.
MAX_TRAIN = 16_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
PAD = BUCKETS
#: Function words by language, for the thresholds only.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with as be by on at this from or an are not",
    "de": "der die und das ist nicht ein eine zu von mit den im für auf dem sich des auch es",
    "fr": "le la les de des et un une du que qui dans pour par sur pas au est elle ce",
    "es": "el la los las de del que en y un una por con para su al se lo como es",
}
LANGS = [*FUNCTION_WORDS, "other"]
_word = re.compile(r"[^\W\d_]+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


class Buckets(dict):
    """Cache of words; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = found = bucket(word)
        return found


_cache = Buckets()


def buckets(text: str | None) -> np.ndarray:
    return np.fromiter(map(_cache.__getitem__, _word.findall((text or "").lower())), np.int32)


def _language_table() -> np.ndarray:
    table = np.zeros((BUCKETS + 1, len(LANGS)), np.float32)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            table[bucket(w), i] = 1
    return table


def language(table: np.ndarray, ids: np.ndarray) -> int:
    """Index into LANGS of the language with the most function words; ties go to the earlier."""
    counts = table[ids].sum(0)
    return int(counts.argmax()) if counts.any() else len(LANGS) - 1


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGS)))
    slope: float = 1.0
    trained: bool = True

    def pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima (texts, widths x filters) and their positions in the padded row of all texts."""
        gap = np.full(max(WIDTHS) - 1, PAD, np.int32)
        ids = np.concatenate([x for t in texts for x in (gap, t)] + [gap, gap])
        starts = np.cumsum([0] + [len(t) + len(gap) for t in texts])
        x = self.embedding[ids]
        best, at = [], []
        for w in WIDTHS:
            y = sum(x[k : len(ids) - max(WIDTHS) + 1 + k] @ self.filters[w][k] for k in range(w)) + self.bias[w]
            here = [y[a:b].argmax(0) + a for a, b in zip(starts[:-1], starts[1:])]
            at.append(np.array(here).reshape(len(texts), FILTERS))
            best.append(np.maximum(np.take_along_axis(y, at[-1], 0) if len(texts) else y[:0], 0))
        self._ids, self._x = ids, x
        return np.concatenate(best, 1), np.concatenate(at, 1)

    def logits(self, texts: list[np.ndarray], most_words: int = 400_000) -> np.ndarray:
        out, part, n = [], [], 0
        for t in texts:
            part.append(t)
            n += len(t)
            if n > most_words:
                out.append(self.pooled(part)[0] @ self.out + self.out_bias)
                part, n = [], 0
        if part:
            out.append(self.pooled(part)[0] @ self.out + self.out_bias)
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[np.ndarray], languages: list[int]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        z = self.slope * (self.logits(texts) - self.thresholds[np.array(languages, int)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(texts: list[np.ndarray], label: np.ndarray, rng) -> Model:
    """Small random weights; the first dimension of an embedding starts from how much its bucket tells apart."""
    seen = [np.zeros(BUCKETS + 1, np.float32) for _ in range(2)]
    for t, y in zip(texts, label):
        seen[int(y)][np.unique(t)] += 1
    n = [max(1, (label == y).sum()) for y in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen[0] + seen[1] < 2] = 0
    e = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
    e[seen[0] + seen[1] < 2] = 0  # what is hardly known stays silent
    e[:, 0] += np.clip(odds, -3, 3) / 3
    e[PAD] = 0
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][0, 0] = np.abs(filters[w][0, 0]) + 0.3
    return Model(e, filters, {w: np.full(FILTERS, -0.1, np.float32) for w in WIDTHS}, np.abs(rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS)).astype(np.float32), -1.0)


def fit_arrays(texts: list[np.ndarray], label: np.ndarray, seed: int = 11, epochs: int | None = None, batch: int = 64) -> Model:
    """Train on bucket arrays and 0/1 labels; the last fifth sets the thresholds."""
    rng = np.random.default_rng(seed)
    model = _start(texts, label, rng)
    if len(set(label.tolist())) < 2:
        model.trained = False
        return model
    held = max(1, len(texts) // 5)
    train, last = np.arange(len(texts) - held), np.arange(len(texts) - held, len(texts))
    state: dict = {}

    def step(key, value, grad, rows=None, rate=0.01):
        m, v = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6)

    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
    for _ in range(epochs or max(3, min(8, 40_000 // len(train)))):
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            rows = train[i : i + batch]
            top, at = model.pooled([texts[r] for r in rows])
            p = 1 / (1 + np.exp(-np.clip(top @ model.out + model.out_bias, -30, 30)))
            g = ((p - label[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g_top = g[:, None] * model.out * (top > 0)
            touched, d_x = [], []
            for j, w in enumerate(WIDTHS):
                gw, aw = g_top[:, j * FILTERS : (j + 1) * FILTERS], at[:, j * FILTERS : (j + 1) * FILTERS]
                d_f = np.zeros_like(model.filters[w])
                for k in range(w):
                    near = model._x[aw + k]
                    d_f[k] = np.einsum("nf,nfd->df", gw, near)
                    touched.append(model._ids[aw + k].ravel())
                    d_x.append((gw[:, :, None] * model.filters[w][k].T[None]).reshape(-1, DIM))
                step(("f", w), model.filters[w], d_f)
                step(("b", w), model.bias[w], gw.sum(0))
            ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            d_e = np.zeros((len(ids), DIM), np.float32)
            np.add.at(d_e, inverse, np.concatenate(d_x))
            d_e[ids == PAD] = 0
            step("e", model.embedding, d_e, ids)
            step("o", model.out, g @ top + 1e-4 * model.out)
            model.out_bias -= 0.05 * float(g.sum())
    calibrate(model, [texts[i] for i in last], label[last])
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The midpoint between logits that errs least often."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    least = np.flatnonzero(wrong == wrong.min())
    i = least[len(least) // 2]
    return float(z[0] - 1 if i == 0 else z[-1] + 1 if i == len(z) else (z[i - 1] + z[i]) / 2)


def calibrate(model: Model, texts: list[np.ndarray], label: np.ndarray, least: int = 40) -> None:
    """A threshold for each language with enough rows and both labels; the others share one."""
    z, table = model.logits(texts), _language_table()
    langs = np.array([language(table, t) for t in texts])
    model.thresholds[:] = best_cut(z, label) if len(set(label.tolist())) == 2 else 0.0
    for i in range(len(LANGS)):
        own = langs == i
        if own.sum() >= least and label[own].sum() >= 5:
            model.thresholds[i] = best_cut(z[own], label[own])
    model.slope = 4 / max(float(np.std(z)), 1e-3)


@arrow_udf(BinaryType())
def _ids_of(text: pa.Array) -> pa.Array:
    return pa.array([buckets(t).tobytes() for t in text.to_pylist()], pa.binary())


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the whole texts of docs (doc_id, text) that labels (doc_id, label) has."""
    known = labels.select("doc_id", "label").where("doc_id IS NOT NULL AND label IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "label", _ids_of("text").alias("ids")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.label))
    return fit_arrays([np.frombuffer(r.ids, np.int32) for r in rows], np.array([r.label for r in rows], float))


def scored(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """doc_id, any further columns asked for, score and predicted, from whole texts."""
    known, spark = model, docs.sparkSession
    shared = spark.sparkContext.broadcast(known)

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        m = shared.value
        if not hasattr(m, "_languages"):
            m._languages = _language_table()
        ids = [buckets(t) for t in text.to_pylist()]
        return pa.array(m.score(ids, [language(m._languages, x) for x in ids]), pa.float64())

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, score(F.col("text").cast("string")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
