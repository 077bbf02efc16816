"""Language-model scoring against brute force, finite differences and edge cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import max_entropy as me
from tessera.llm.common import crc_mod

from .test_operators import CLASHES, empty, messy, table


def brute_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    return [*words, *([word] if word else []), None]


def trains(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def run(docs):
    train = crc_mod(F.col("doc_id"), 7) != 2
    counts = me.vocabulary_of(docs.where(train))
    rows = me.encode(docs, counts.vocabulary)
    return me.scored(rows, me.fit(rows.where(train), counts.vocabulary), counts), counts


def brute_base(rows):
    """(n_tokens, n_known, base_score) of each of the rows (doc_id, text), and the training tokens."""
    counts = Counter(t for i, text in rows if trains(i) for t in brute_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        tokens = brute_tokens(text)
        out.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return out, n


def same(found, rows):
    got, (expected, n) = found.collect(), brute_base(rows)
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:3], round(r[3], 6))
    left, right = (np.array(sorted(map(key, x)), float) for x in (((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), expected))
    assert left.shape == right.shape and np.allclose(left, right, rtol=1e-9, atol=1e-5)
    assert {r.train_tokens for r in got} <= {n} and all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    return got


def prose(seed, n):
    rng = random.Random(seed)
    first, after = [f"a{i}" for i in range(60)], {}
    for w in first:
        after[w] = rng.sample(first, 3)
    out = []
    for _ in range(n):
        w, words = rng.choice(first), []
        for _ in range(rng.randrange(5, 80)):
            words.append(w if rng.random() < 0.9 else f"rare{rng.randrange(400)}")
            w = rng.choice(after[w])
        out.append(" ".join(words).upper() if rng.random() < 0.1 else "\n".join(words))
    return out


@pytest.mark.parametrize("dictionary", [200_000, 40, 0])
def test_base_scores_are_exact_and_the_model_is_better(spark, monkeypatch, dictionary):
    monkeypatch.setattr(me, "DICTIONARY", dictionary)  # 40: most words' counts come by the join; 0: all
    monkeypatch.setattr(me, "HELD", 50)
    texts = prose(4, 700)
    docs = table(spark, texts).repartition(4)
    found, counts = run(docs)
    got = same(found, list(enumerate(texts)))
    assert counts.vocabulary.size <= dictionary
    held = [r for r in got if not trains(r.doc_id)]
    better = sum(r.score for r in held) - sum(r.base_score for r in held)
    assert better > (0.1 * sum(r.n_tokens for r in held) if dictionary == 200_000 else -1e-4 * len(held))


def test_lm_edges(spark):
    docs = messy(spark)
    found, _ = run(docs)
    same(found, [(r.doc_id, r.text) for r in docs.collect()])
    assert run(empty(spark))[0].collect() == []
    long = table(spark, ["word " * 200_000, "x" * 300_000, "x" * 300_000 + " word", "y" * 100])
    found, counts = run(long)
    got = same(found, [(r.doc_id, r.text) for r in long.collect()])
    assert counts.vocabulary.size <= 3 and len(got) == 4  # long words are counted by the join
    unseen = table(spark, ["only held out"]).withColumn("doc_id", F.lit(next(i for i in range(99) if not trains(i))).cast("long"))
    r = run(unseen)[0].collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0.0) and r.score == pytest.approx(0)
    assert set(CLASHES) <= set(docs.columns)


def small_model(seed=1, words=70):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 60, words))[::-1]
    v = me.Vocabulary([f"w{i}".encode() for i in range(words)], counts, int(counts.sum()) + 90, words + 30)
    m = me.Model(v)
    for t in m.tables:
        t[:] = rng.normal(0, 0.3, t.shape)
    return m, v, rng


def test_probabilities_add_up_to_one(monkeypatch):
    monkeypatch.setattr(me, "HEAD", 48)
    m, v, rng = small_model()
    before = rng.integers(0, v.size + 1, 5)
    every = []
    for w in range(v.size + 1):
        ids = np.append(before, w)
        every.append(10 ** m.log10(ids, np.zeros(1, int))[-1])
    # the last class is shared by words outside the dictionary: 30 distinct ones, 90 in all, and one unseen
    rest = sum(10 ** v.rest_log10(np.array([c])).item() for c in [3] * 30) + 10 ** v.rest_log10(0).item()
    assert rest == pytest.approx(1) and sum(every) == pytest.approx(1, abs=1e-5)


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(me, "HEAD", 48)
    monkeypatch.setattr(me, "ROWS", 64)
    m, v, rng = small_model(2)
    m.tables = [t[:64].astype(np.float64) for t in m.tables]
    ids, starts = rng.integers(0, v.size + 1, 200), np.array([0, 90, 91])
    trainer, steps = me.Trainer(m), []
    monkeypatch.setattr(me.Trainer, "step", lambda self, which, rows, g, n: steps.append((which, np.arange(64)[rows], g.copy())))
    trainer.learn(ids, starts)
    loss = lambda: -np.log(10) * m.log10(ids, starts).sum()
    for which, table_ in enumerate(m.tables):
        grad = np.zeros_like(table_)
        for w, rows, g in steps:
            if w == which:
                np.add.at(grad, rows, g)
        for _ in range(25):
            r, c = rng.integers(0, 64), rng.integers(0, table_.shape[1])
            old = table_[r, c]
            table_[r, c] = old + 1e-4
            up = loss()
            table_[r, c] = old - 1e-4
            assert (up - loss()) / 2e-4 == pytest.approx(grad[r, c], abs=2e-3)
            table_[r, c] = old


def test_contexts_stop_at_texts():
    ids, starts = np.array([5, 6, 7, 8, 5, 6]), np.array([0, 3, 4])
    h = me.contexts(ids, starts, 100)
    none = 101
    one = lambda a: (np.uint64(a) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        assert h[0].tolist() == [one(x) for x in (none, 5, 6, none, none, 5)]
        assert h[2].tolist() == [(np.uint64(x) + np.uint64(5)) * np.uint64(0xC2B2AE3D27D4EB4F) for x in (none, none, 5, none, none, none)]


def test_merged_changes_are_means_by_times_seen(spark):
    m, v, rng = small_model(3)
    parts = []
    for seed in (1, 2):
        t = me.Trainer(m)
        t.learn(np.random.default_rng(seed).integers(0, v.size, 300), np.array([0]))
        parts.append(t)
    rows = [(w, b, r, s, x) for t in parts for w, b, r, s, x in t.changes()]
    import pyarrow as pa

    schema = pa.schema([("which", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("rows", "seen", "moved"))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sorted(rows, key=lambda x: x[:2])), schema)], schema=schema)
    for out in me._merger([t.shape[1] for t in m.tables], schema)(iter([batch])):
        w, b, moved = out.column(0)[0].as_py(), out.column(1)[0].as_py(), np.frombuffer(out.column(4)[0].as_py(), np.float32).reshape(me.BLOCK, -1)
        at = slice(b * me.BLOCK, (b + 1) * me.BLOCK)
        seen = sum(t.seen[w][at] for t in parts)
        mean = sum((t.m.tables[w][at] - m.tables[w][at]) * t.seen[w][at][:, None] for t in parts) / np.maximum(seen, 1)[:, None]
        assert np.abs(moved - mean).max() < 5e-3
