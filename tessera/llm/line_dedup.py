"""Operator 7: delete later copies of repeated line runs.

Each text is a sequence of line ids. A line that occurs once can't be part of a repeated run, so it only parts the
sequences, and what is left is a small part of most tables. Over all suffixes of these sequences, distributed prefix
doubling makes the ranks of a suffix array: at level k a suffix has the rank of its first 2^k lines among those of all
suffixes. Level 0 ranks the distinct repeated lines; each further level ranks the distinct pairs (rank here, rank 2^k
lines on; -1 beyond the sequence) by a sort over range partitions. A rank is a position in that order, so ranks keep
the order of the suffixes and are equal just for equal runs.

A run counts if it has `min_words` words or more. The suffixes that share their first n lines, 2^k <= n < 2^(k+1), are
a longest-common-prefix interval of the suffix array: those with equal ranks of level k at their first line and n - 2^k
lines on. Every repeated run that counts is a union of runs that are just long enough, taken from each of its lines
forwards or backwards; the intervals of those are looked up, two a line at most, and none is longer than `min_words`
lines, which bounds the levels. Where an interval also has an earlier member (by doc_id with nulls first, then
position), the lines are deleted: so maximal repeated runs go and their first copy stays whole. Lines without a word
belong to no run, stay, and don't part one.

Lines are told apart by digests of 128 bits; all else is exact. Rows of a frequent line, pair or run are joined to one
row, which Spark splits where it is hot. Null and empty texts stay as they are. Rows with equal doc_id and text count as
one and get the same result each; of rows with equal doc_id and other texts, the one with the smaller hash comes
first. Empty tables give empty results. All columns of the input are kept, inside one struct on the way, so their names
can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, scratch, stage

MIN_WORDS = 50
KEY = ["_td_id", "_td_tie"]
LINES = "_td_id long, _td_tie long, line int, p int, words int, name binary"
SEQUENCES = "_td_id long, _td_tie long, line array<int>, stop array<int>, r array<long>, a array<int>, n array<int>"


def keyed(docs: DataFrame) -> list[Column]:
    """_td_id and _td_tie, by which rows are told apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_td_id"), F.xxhash64(F.col("text").cast("string")).alias("_td_tie")]


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with a word of texts that have enough words: its number, its number among such lines, words and digest."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            at, line, p, words, names = [], [], [], [], []
            for row, text in enumerate(batch.column(2).cast(pa.binary())):
                found = [(i, n, x) for i, x in enumerate((text.as_py() or b"").split(b"\n")) if (n := len(x.split()))]
                if sum(n for _, n, _ in found) >= min_words:
                    at += [row] * len(found)
                    line += [i for i, _, _ in found]
                    p += range(len(found))
                    words += [n for _, n, _ in found]
                    names += [xxhash.xxh3_128_digest(x) for _, _, x in found]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at], pa.int64()) for k in keys), *(pa.array(c, pa.int32()) for c in (line, p, words)), pa.array(names, pa.binary())], names=[*KEY, "line", "p", "words", "name"])

    return docs.select(*keyed(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, LINES)


def ranked(distinct: DataFrame, *order: str) -> DataFrame:
    """The rows with r, their place in a total order, which is written down: increasing, with gaps."""
    placed = distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("r", F.monotonically_increasing_id())
    return stage(placed, "ranks")


def windows(p: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines at p: where the sequence of each stops, and start and length of the runs of just min_words words."""
    n = len(p)
    cuts = np.flatnonzero(np.diff(p) != 1) + 1
    begins, ends = np.append(0, cuts), np.append(cuts, n)
    own = np.searchsorted(begins, np.arange(n), side="right") - 1
    sums = np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(sums, sums[:-1] + min_words)
    start = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
    a, b = np.concatenate([np.arange(n), start]), np.concatenate([stop, np.arange(1, n + 1)])
    begin, end = np.tile(begins[own], 2), np.tile(ends[own], 2)
    runs = np.unique(np.stack([a, b - a])[:, (a >= begin) & (b <= end)], axis=1)
    return ends[own], runs[0], runs[1]


def sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each text that has a run of repeated lines with enough words: its repeated lines, where the sequence of
    each stops, their ranks of level 0, and starts a and lengths n of the runs to look up. All are bounded by the text."""

    def run(batches):
        for batch in batches:
            rows = []
            for own in batch.to_pylist():
                found = sorted(own["own"], key=lambda x: x["p"])
                stop, a, n = windows(np.array([x["p"] for x in found]), np.array([x["words"] for x in found]), min_words)
                if len(a):
                    rows.append({"_td_id": own["_td_id"], "_td_tie": own["_td_tie"], "line": [x["line"] for x in found], "stop": stop.tolist(), "r": [x["r"] for x in found], "a": a.tolist(), "n": n.tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("_td_id", pa.int64()), ("_td_tie", pa.int64()), ("line", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32())), ("r", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    every = stage(lines(docs, min_words), "lines")
    names = ranked(every.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("name"), "name")
    own = every.join(names, "name").groupBy(*KEY).agg(F.collect_set(F.struct("p", "line", "words", "r")).alias("own"), F.sum("words").alias("words"))
    return own.where(F.col("words") >= min_words).drop("words").mapInArrow(run, SEQUENCES)


def doubled(found: DataFrame, half: int) -> DataFrame:
    """The sequences that have longer runs to look up, with ranks of twice as many lines."""
    longer = found.where(F.exists("n", lambda x: x >= 2 * half))
    pairs = longer.selectExpr(*KEY, f"inline(transform(r, (v, i) -> struct(i, v AS x, if(i + {half} < stop[i], r[i + {half}], -1L) AS y)))").toDF(*KEY, "i", "x", "y")
    names = ranked(pairs.select("x", "y").distinct(), "x", "y")
    new = pairs.join(names, ["x", "y"]).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("own"))
    return longer.drop("r").join(new.select(*KEY, F.col("own.r").alias("r")), KEY)


def intervals(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each run to look up: its text, first and last line, and the interval it belongs to (n, x, y)."""
    found, half, every = stage(sequences(docs, min_words), "sequences"), 1, None
    while every is None or not found.isEmpty():
        runs = f"filter(arrays_zip(a, n), w -> w.n >= {half} AND w.n < {2 * half})"
        of_level = found.selectExpr(*KEY, f"inline(transform({runs}, w -> struct(line[w.a] AS first, line[w.a + w.n - 1] AS last, w.n AS n, r[w.a] AS x, r[w.a + w.n - {half}] AS y)))")
        of_level = of_level.toDF(*KEY, "first", "last", "n", "x", "y")
        every = of_level if every is None else every.unionByName(of_level)
        found, half = stage(doubled(found, half), "sequences"), 2 * half
    return every


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: _td_id, _td_tie and _td_spans, an array of (first, last) line."""
    with scratch() as made:
        runs = stage(intervals(docs, min_words), "intervals")
        made.pop()  # all else was only on the way to it
    place = F.struct(*KEY, "first")
    earliest = runs.groupBy("n", "x", "y").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("n", "x", "y", "least")
    later = runs.join(earliest, ["n", "x", "y"]).where(place > F.col("least"))
    return later.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("_td_spans"))


def without(text: Column, spans: Column) -> Column:
    """The text without the lines (with a word) of the spans."""
    has_word = lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0
    gone = lambda x, i: has_word(x) & F.exists(spans, lambda s: (i >= s["first"]) & (i <= s["last"]))
    return F.when(spans.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~gone(x, i)), "\n"))


def deduped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs gone from `text`; all columns stay."""
    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(*keyed(docs), F.col("text").cast("string").alias("_td_text"), F.struct(*rest).alias("_td_row"))
    both = row.join(repeated(docs, min_words), KEY, "left").select("_td_row", without(F.col("_td_text"), F.col("_td_spans")).alias("_td_text"))
    return both.select(*(F.col("_td_text" if c == "text" else f"_td_row.{c}").alias(c) for c in docs.columns))
