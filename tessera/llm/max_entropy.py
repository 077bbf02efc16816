"""Operator 13: scores of texts by a hashed maximum-entropy language model, beside an add-one unigram base.

Tokens are the words of a text, A-Z in lower case, and one end. Tasks count the words of all training texts, and the
counts are added by word. The DICTIONARY most frequent words are broadcast with their counts (words of at most LONGEST
bytes, so the size is bounded); how often a rarer word occurs is found by a join, so the base score has every count.

The model predicts a token's class, then the token within its class. Words by falling frequency make classes of WITHIN
words; those of the HEAD most frequent have weights, rarer dictionary words lie in a few open classes of about equal mass
and follow their share of it, and the last class holds all rarer words, known or not, which share it by add-one counts.
Features are the constant and the previous word, for classes also the previous two and the word before the previous by
itself (a skip). A feature, for words a pair of feature and class, is hashed to a row of weights, one weight an outcome.

Training: weights start at the unigram shares. In each round tasks go over their share of the training texts in sparse
batches and take adaptive gradient steps on a copy of the weights; the changes of each row are averaged over tasks by how often
they saw it, merged by row on Spark, and the bounded table goes out again. Every training text is used in one round.

Null texts count as empty and have the end alone; null doc_ids hash as 'null'. A text, and a word, may have any length.
Of repeated rows each is counted and scored. Words of equal counts are ordered by their bytes. With no training text
every count is 0 and all mass is the last class's. An empty table gives no rows. Only doc_id and text are read, so
further columns can't clash.
"""

from __future__ import annotations

from collections import Counter
from copy import copy
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Words that are broadcast with their counts, and bytes of such a word at most.
DICTIONARY, LONGEST = 200_000, 64
#: Words with weights of their own, words of a class, open classes beside the last, rows of either table of weights.
HEAD, WITHIN, OPEN, ROWS = 512, 32, 7, 1 << 16
END = b""  # no word is empty
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Tokens of a gradient step, and of a batch that is scored.
STEP, BATCH = 4096, 4096
RATE = 0.25
#: Share of the training texts that each round learns from, in hundredths; rows of weights that merge as one.
ROUNDS, BLOCK = (20, 80), 64
#: Words that a task counts before it sends them on.
HELD = 300_000


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words and the end; bytes split at the six ASCII blanks only."""
    words = (text or "").encode().translate(LOWER).split()
    words.append(END)
    return words


class Places(dict):
    """Place of a dictionary word; others get the place after the last."""

    def __missing__(self, word: bytes) -> int:
        return self.none


@dataclass
class Vocabulary:
    """The dictionary, most frequent words first, and counts of all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    n: int  # training tokens
    distinct: int

    def __post_init__(self):
        self.places = Places(zip(self.words, range(len(self.words))))
        self.places.none = len(self.words)
        self.size = size = len(self.words)
        self.head = min(HEAD, size)
        self.head_classes = -(-self.head // WITHIN)
        counts = self.counts.astype(float)
        below = np.cumsum(counts[self.head :])
        mass = below[-1] if len(below) else 0
        opened = np.minimum((below - counts[self.head :] / 2) * OPEN // max(mass, 1), OPEN - 1).astype(int)
        last = self.head_classes + OPEN
        self.classes = last + 1
        #: class of each place; of the place after the last too
        self.of = np.concatenate([np.arange(self.head) // WITHIN, self.head_classes + opened, [last]]).astype(np.int32)
        self.rest, self.rest_distinct = int(self.n - counts.sum()), self.distinct - size
        share = np.bincount(self.of, np.append(counts, self.rest + 1), self.classes)
        self.class_share = np.log(np.maximum(share, 1e-30) / share.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            #: log of the share of its class; of the place after the last, what an unseen word has
            self.within = np.log(np.append(counts, 1) / np.append(share[self.of[:-1]], self.rest + self.rest_distinct + 1))
        self.base = np.log10((np.append(counts, 0) + 1) / (self.n + self.distinct + 1))
        self.word_share = np.full((max(1, self.head_classes), WITHIN), -80, np.float32)  # no word: no odds
        self.word_share.ravel()[: self.head] = self.within[: self.head]

    def without_words(self) -> Vocabulary:
        """What a model needs of it."""
        own = copy(self)
        own.words = own.places = None
        return own

    def rest_log10(self, count):
        """log10 of the share of a word outside the dictionary in the last class."""
        return np.log10((count + 1) / (self.rest + self.rest_distinct + 1))


def contexts(ids: np.ndarray, starts: np.ndarray, none: int) -> np.ndarray:
    """(features, tokens) hashes: previous word, previous two, skip; what lies before a text's start is none + 1."""
    a, b = (np.full(len(ids), none + 1, np.uint64) for _ in range(2))
    a[1:], b[2:] = ids[:-1], ids[:-2] if len(ids) > 2 else ids[:0]
    a[starts] = b[starts] = none + 1
    second = starts[starts + 1 < len(ids)] + 1
    b[second] = none + 1
    one = (a + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
    skip = (b + np.uint64(5)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.stack([one, one ^ (skip >> np.uint64(7)), skip])


def rows_of(hashes: np.ndarray) -> np.ndarray:
    """Row of each hash; row 0 is the constant's."""
    mixed = hashes ^ (hashes >> np.uint64(29))
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % (ROWS - 1) + 1


class Model:
    """Weights of classes and of words in a class, rows by hashed feature."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary.without_words()
        self.tables = [np.zeros((ROWS, vocabulary.classes), np.float32), np.zeros((ROWS, WITHIN), np.float32)]

    def layer(self, which: int, rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Odds of all outcomes from start (log shares) and the weights of rows (features, tokens), and their sums."""
        z = self.tables[which][rows[0]]
        z += start + self.tables[which][0]
        for r in rows[1:]:
            z += self.tables[which][r]
        np.clip(z, -80, 80, out=z)
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], np.float32)

    def both(self, ids: np.ndarray, hashes: np.ndarray):
        """For classes, and for words in head classes: the tokens concerned, rows, outcomes, odds and their sums."""
        v = self.v
        of = v.of[ids]
        rows = rows_of(hashes)
        yield slice(None), rows, of, *self.layer(0, rows, v.class_share)
        at = np.flatnonzero(ids < v.head)
        if len(at):
            inner = rows_of(hashes[:1, at] + (of[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            yield at, inner, ids[at] % WITHIN, *self.layer(1, inner, v.word_share[of[at]])

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each token; of tokens outside the dictionary only that of the last class."""
        out = np.empty(len(ids))
        hashes = contexts(ids, starts, self.v.size)
        for i in range(0, len(ids), BATCH):
            own = ids[i : i + BATCH]
            p = np.where((own >= self.v.head) & (own < self.v.size), self.v.within[own], 0)
            for at, _, y, odds, total in self.both(own, hashes[:, i : i + BATCH]):
                p[at] += np.log(odds[np.arange(len(y)), y] / total)
            out[i : i + BATCH] = p
        return out / np.log(10)


class Trainer:
    """Gradient steps on a copy of a model's weights; knows how often each row was seen."""

    def __init__(self, model: Model):
        self.m = copy(model)
        self.start = model.tables
        self.m.tables = [t.copy() for t in model.tables]
        self.seen = [np.zeros(ROWS, np.int64) for _ in self.start]
        self.squares = [np.full(ROWS, 1e-2, np.float32) for _ in self.start]

    def learn(self, ids: np.ndarray, starts: np.ndarray) -> None:
        hashes = contexts(ids, starts, self.m.v.size)
        for i in range(0, len(ids), STEP):
            for which, (_, rows, y, g, total) in enumerate(self.m.both(ids[i : i + STEP], hashes[:, i : i + STEP])):
                g /= total[:, None]
                g[np.arange(len(y)), y] -= 1
                self.step(which, slice(0, 1), g.sum(0, keepdims=True), len(y))
                for r in rows:
                    order = np.argsort(r)
                    own = r[order]
                    at = np.flatnonzero(own[1:] != own[:-1]) + 1
                    at = np.concatenate([[0], at])
                    self.step(which, own[at], np.add.reduceat(g[order], at, axis=0), np.diff(at, append=len(own)))

    def step(self, which: int, rows, g: np.ndarray, n) -> None:
        """Move rows against their summed gradients, the less the larger the gradients that they have seen."""
        self.seen[which][rows] += n
        self.squares[which][rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        g *= (-RATE / np.sqrt(self.squares[which][rows]))[:, None]
        self.m.tables[which][rows] += g

    def changes(self):
        """(table, block, rows in it, how often seen, half-precision changes) of the rows seen."""
        for which, seen in enumerate(self.seen):
            at = np.flatnonzero(seen)
            moved = (self.m.tables[which][at] - self.start[which][at]).astype(np.float16)
            ends = np.flatnonzero(np.diff(at // BLOCK, append=-1)) + 1
            for a, b in zip(np.append(0, ends[:-1]), ends):
                if b > a:
                    yield which, int(at[a] // BLOCK), (at[a:b] % BLOCK).astype(np.uint8).tobytes(), seen[at[a:b]].astype("<i8").tobytes(), moved[a:b].tobytes()


def grid(n):
    """Counts on a grid of at most 1,024 values for each power of two, as an expression of a column n."""
    exponent = F.greatest(F.length(F.bin(n)) - 11, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, exponent), exponent)


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes) and n of the tokens of all texts; tasks add their own up first."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
                if len(found) >= HELD:
                    yield from sent(found)
                    found = Counter()
        yield from sent(found)

    def sent(found):
        words, counts = list(found), list(found.values())
        for i in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000], pa.binary()), pa.array(counts[i : i + 20_000], pa.int64())], schema=schema)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Counts of all words (staged), those outside the dictionary, and the dictionary."""

    table: DataFrame
    others: DataFrame
    vocabulary: Vocabulary


def vocabulary_of(docs: DataFrame) -> Counts:
    """Counts the words of docs (text); every word as frequent as the least frequent one of the dictionary is in it."""
    table = stage(count_words(docs), "counts").withColumn("grid", grid(F.col("n")))
    short = F.length("word") <= LONGEST
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("distinct")).first()
    least, held = 1 << 62, 0
    for r in sorted(table.where(short).groupBy("grid").count().collect(), reverse=True):
        if held + r["count"] > DICTIONARY:
            break
        least, held = r.grid, held + r["count"]
    known = table.where(short & (F.col("grid") >= least)).select("word", "n").toArrow()
    words = sorted(zip(known.column("n").to_pylist(), known.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    v = Vocabulary([w for _, w in words], np.array([n for n, _ in words], np.int64), total.n, total.distinct)
    return Counts(table, table.where(~short | (F.col("grid") < least)).select("word", "n"), v)


ENCODED = "row long, doc_id long, ids binary, n_tokens long, n_known long, base double, rare array<binary>, times array<long>"
_ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Each row of docs (doc_id, text) once, staged (ENCODED): its tokens' places, dictionary tokens, their base score, and
    the other words with how often they occur. What follows reads no text."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        v = shared.value
        none, find = v.size, v.places.__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                words = tokens(text)
                ids = np.fromiter(map(find, words), np.int32, len(words))
                rare = ids == none
                others = Counter(compress(words, rare.tolist())) if rare.any() else {}
                known = ids[~rare]
                rows.append((ids.tobytes(), len(ids), len(known), float(v.base[known].sum()), list(others), list(others.values())))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(_ENCODED)[2:]))], schema=_ENCODED)

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(given.mapInArrow(run, ENCODED), "encoded")


def places(column) -> tuple[np.ndarray, np.ndarray]:
    """Places of all texts of a column of ENCODED, and where each text starts."""
    each = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    return np.concatenate(each).astype(np.int64), np.cumsum([0, *map(len, each)])[:-1]


def fit(rows: DataFrame, v: Vocabulary) -> Model:
    """Learns from all texts of rows (ENCODED), each in one of the rounds; equal texts in the same."""
    spark, model = rows.sparkSession, Model(v)
    part, low = F.pmod(F.xxhash64("ids"), F.lit(100)), 0
    ddl = "which int, block int, rows binary, seen binary, moved binary"
    schema = pa.schema([("which", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("rows", "seen", "moved"))])
    for share in ROUNDS:
        shared = spark.sparkContext.broadcast(model)
        changes = rows.where(part.between(low, low + share - 1)).select("ids").mapInArrow(_learner(shared, schema), ddl)
        merged = changes.repartition("which", "block").sortWithinPartitions("which", "block").mapInArrow(_merger([t.shape[1] for t in model.tables], schema), ddl).toArrow()
        for which, block, moved in zip(*(merged.column(c).to_pylist() for c in ("which", "block", "moved"))):
            model.tables[which][block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(moved, np.float32).reshape(BLOCK, -1)
        shared.unpersist()
        low += share
    return model


def _learner(shared, schema):
    def learn(batches):
        trainer = None
        for batch in batches:
            trainer = trainer or Trainer(shared.value)
            if batch.num_rows:
                trainer.learn(*places(batch.column(0)))
        rows = []
        for row in trainer.changes() if trainer else ():
            rows.append(row)
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return learn


def _merger(widths: list[int], schema):
    """Averages the changes of each row by how often tasks saw it; one block at a time."""

    def merge(batches):
        now, seen, moved = None, None, None

        def done():
            mean = (moved / np.maximum(seen, 1)[:, None]).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, b"", b"", mean.tobytes()), schema)], schema=schema)

        for batch in batches:
            for which, block, r, s, m in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (which, block):
                    if now:
                        yield done()
                    now, seen, moved = (which, block), np.zeros(BLOCK), np.zeros((BLOCK, widths[which]))
                at, n = np.frombuffer(r, np.uint8), np.frombuffer(s, "<i8")
                seen[at] += n
                moved[at] += np.frombuffer(m, np.float16).reshape(len(at), -1).astype(float) * n[:, None]
        if now:
            yield done()

    return merge


def scored(rows: DataFrame, model: Model, counts: Counts) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each of rows (ENCODED)."""
    v = model.v
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids, starts = places(batch.column(5))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.add.reduceat(shared.value.log10(ids, starts), starts))], schema=schema)

    own = rows.select("row", "doc_id", "n_tokens", "n_known", "base", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("rare"), F.col("t.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    share = lambda c, total: F.col("times") * F.log10((c + 1) / F.lit(float(total)))
    found = rare.join(counts.others, F.col("rare") == F.col("word"), "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(share(n, v.n + v.distinct + 1)).alias("more_base"), F.sum(share(n, v.rest + v.rest_distinct + 1)).alias("more_score"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias
    return own.join(found, "row", "left").select("doc_id", "n_tokens", plus("n_known", "more_known")("n_known"), F.lit(v.n).cast("long").alias("train_tokens"), plus("base", "more_base")("base_score"), plus("score", "more_score")("score"))
