"""Operator 10: language identification of mixed text.

Each word's script (from its letters' code ranges) leaves the languages that use it; those are scored by the
word's byte trigrams. Viterbi over the words of a document, with a penalty for a switch, labels spans; the
document's language is that of most letters' bytes, and `score` the share of them that its words have.

Words are compared in lower case. A text with any letter gets a learned language, whatever its script: a word without a
letter of a known script doesn't sway the path and weighs nothing, unless the text has no others.

`train` counts hashed trigrams and scripts of all training rows with Spark; the model has TABLE cells for each
learned language at most. Null texts and texts without a letter are `und` with score 0 and no spans. With no
training rows every document is `und`. Ties go to the language first in alphabetical order. Repeated rows are
labelled each. Only doc_id, text and lang are read, so further columns can't clash. Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = 1 << 16
#: Cost, in nats, of a change of language between two words.
SWITCH = 12.0
#: A script counts as a language's own from this share of its words.
SCRIPT_SHARE = 0.01
#: Scripts by first byte of a character in UTF-8 (0: no letter).
SCRIPTS = {1: [range(65, 91), range(97, 123), range(0xC3, 0xCA)], 2: [range(0xCD, 0xD0)], 3: [range(0xD0, 0xD4)], 4: [range(0xD6, 0xD8)], 5: [range(0xD8, 0xE0)], 6: [range(0xE0, 0xE1)], 7: [range(0xE3, 0xE4)], 8: [range(0xE4, 0xEA)], 9: [range(0xEA, 0xEE)], 10: [range(0xE1, 0xE3), range(0xEE, 0xF5), range(0xCA, 0xCD), range(0xD4, 0xD6)]}
_script = np.zeros(256, np.int8)
for _s, _ranges in SCRIPTS.items():
    for _r in _ranges:
        _script[_r.start : _r.stop] = _s
BLOCK = 64


def _rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells of all words (each with a space before and after), where each word's begin, and its script."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    a = raw.astype(np.uint32)
    cells = ((a[:-2] * 0x9E3779B1 + a[1:-1] * 0x85EBCA6B + a[2:] * 0xC2B2AE35) >> np.uint32(7)) % np.uint32(TABLE)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    script = np.maximum.reduceat(_script[raw[1:]], starts) if len(words) else np.zeros(0, np.int8)
    return cells, starts, script


def split(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().split()


def train(docs: DataFrame) -> Model:
    """Model of all rows with a text and a lang."""

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(split(text))
                if len(seen[lang]) > 200_000:
                    yield from flush(seen)
        yield from flush(seen)

    def flush(seen):
        for lang, counts in seen.items():
            if counts:
                words, n = [*counts], np.fromiter(counts.values(), np.int64, len(counts))
                cells, starts, script = _rows(words)
                each = np.diff(np.append(starts, len(cells) + 1))
                weight = np.repeat(n, each)[: len(cells)]
                table = np.bincount(cells, weight, TABLE).astype(np.int64)
                scripts = np.bincount(script, n, 11).astype(np.int64)
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 11)), pa.array(np.concatenate([at, TABLE + np.arange(11)])), pa.array(np.concatenate([table[at], scripts]))], names=["lang", "cell", "n"])
            counts.clear()

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    found = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((TABLE + 11, len(langs)))
    if langs:
        counts[found["cell"].to_numpy(), np.searchsorted(langs, found["lang"].to_numpy(zero_copy_only=False).astype(str))] = found["n"].to_numpy()
    grams, scripts = counts[:TABLE], counts[TABLE:]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * TABLE))
    shares = scripts / np.maximum(scripts[1:].sum(0), 1)
    allowed = shares >= SCRIPT_SHARE
    allowed[~allowed.any(1)] = True
    return Model(langs, logs.astype(np.float32), allowed)


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) scores, and whether a word has a letter."""
        cells, starts, script = _rows(words)
        each = self.logs[cells]
        each[starts[1:] - 1] = 0  # the trigram across two words
        scores = np.add.reduceat(each, starts, axis=0)
        scores -= scores.max(1, keepdims=True)
        scores = np.maximum(scores, -25)
        scores[~self.allowed[script]] -= 1000
        scores[script == 0] = 0
        return scores, script > 0


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best state of each row; rows are documents of the given lengths, one after the other. Blocks of all
    documents are handled at once: first each block's best score for any entry and exit state, then the
    states at the blocks' ends, then the path inside each block."""
    n_states = scores.shape[1]
    per_doc = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    row = np.concatenate([[0], np.cumsum(lengths)])
    n = first[-1]
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    at = row[doc] + (np.arange(n) - first[doc]) * BLOCK
    size = np.minimum(BLOCK, row[doc + 1] - at)
    index = np.minimum(at[:, None] + np.arange(BLOCK), max(len(scores) - 1, 0))
    s = np.where((np.arange(BLOCK) < size[:, None])[:, :, None], scores[index], 0)
    through = np.where(np.eye(n_states, dtype=bool), 0.0, -switch)[None].repeat(n, 0)
    for t in range(BLOCK):
        through = s[:, t, None, :] + (through if not t else np.maximum(through, through.max(2, keepdims=True) - switch))
    begin, entry, leave = np.zeros((n, n_states)), np.zeros((n, n_states), np.int64), np.zeros(n, np.int64)
    most = per_doc.max(initial=0)
    for k in range(most):
        d = np.flatnonzero(per_doc > k)
        b, more = first[d] + k, per_doc[d] > k + 1
        ways = begin[b][:, :, None] + through[b]
        entry[b], end = ways.argmax(1), ways.max(1)
        begin[b[more] + 1] = end[more]
        leave[b[~more]] = end[~more].argmax(1)
    for k in range(most - 1, 0, -1):
        b = first[np.flatnonzero(per_doc > k)] + k
        leave[b - 1] = entry[b, leave[b]]
    enter = np.where(np.arange(n) == first[:-1][doc], -1, np.roll(leave, 1))
    v = np.where(np.arange(n_states) == enter[:, None], 0.0, -switch)
    v[enter < 0] = 0
    came = np.zeros((n, BLOCK, n_states), bool)
    source = np.zeros((n, BLOCK), np.int64)
    for t in range(BLOCK):
        if t:
            source[:, t] = v.argmax(1)
            moved = v.max(1, keepdims=True) - switch
            came[:, t] = moved > v
            v = np.maximum(v, moved)
        v = v + s[:, t]
    path = np.zeros((n, BLOCK), np.int64)
    now = leave.copy()
    for t in range(BLOCK - 1, -1, -1):
        path[:, t] = now
        if t:
            now = np.where(came[np.arange(n), t, now], source[:, t], now)
    return path[np.arange(BLOCK) < size[:, None]]


def label(model: Model, texts: list[bytes | None]) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans (in words) of each text."""
    split_texts = [split(t or b"") for t in texts]
    words = [w for s in split_texts for w in s]
    lengths = np.array([len(s) for s in split_texts], int)
    if not model.langs or not words:
        return [("und", 0.0, [])] * len(texts)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    scores, letters = model.word_scores([*distinct])
    weight = np.where(letters, np.fromiter(map(len, distinct), np.int64), 0)[ids]
    path = viterbi(scores[ids], lengths)
    out, at = [], 0
    for text, n in zip(texts, lengths.tolist(), strict=True):
        own, share = path[at : at + n], np.zeros(0)
        if n:
            share = np.bincount(own, weight[at : at + n], len(model.langs))
        at += n
        if not n or not any(c.isalpha() for c in text.decode()):
            out.append(("und", 0.0, []))
            continue
        if not share.any():  # letters whose first bytes SCRIPTS doesn't know
            share = np.bincount(own, minlength=len(model.langs))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]]).tolist()
        spans = [{"lang": model.langs[own[a]], "start": a, "stop": b} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out.append((model.langs[int(share.argmax())], float(share.max() / share.sum()), spans))
    return out


def identified(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """doc_id, any further columns asked for, lang_pred, score and spans of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found, a, size = [], 0, 0
            for b, t in enumerate(texts, 1):  # about 2 MB of text at a time
                size += len(t or b"")
                if size > 2_000_000 or b == len(texts):
                    found += label(shared.value, texts[a:b])
                    a, size = b, 0
            kept = batch.drop_columns(["text"])
            langs, scores, spans = zip(*found, strict=True) if found else ((), (), ())
            yield kept.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64())).append_column("spans", pa.array(spans, span))

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "text")
    return given.mapInArrow(run, f"{fields}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,stop:bigint>>")
