"""Operator 11: audit of how filters interact: what each order of five filters keeps, removes and leaves to others.

The conditions A-D are row-local. E (an identical text under a smaller doc_id) first goes through a counting Bloom
sketch: each task counts the hashes of its texts, saturating at 2, in the blocks of one counter array; blocks merge by
adding. A text with a counter below 2 is unique for certain and stays out of the shuffle; the others are grouped by
their full text for its smallest doc_id. Flags and labels join to counts by mask of failed filters, and all orders are
read off these additive counts.

The sketch has 8 to 16 counters a row and is looked up as one bit a counter, so 1 to 2 bytes a row. It is broadcast in
sections of MAX_BYTES, each of which looks only at the rows whose counters it holds: one section up to 134 million rows,
and beyond that one more read of the table for each section. More rows never cost results.

Null texts count as empty and null langs as ''; empty texts are copies of each other. Rows with a null doc_id have no
smaller doc_id, so they never fail E, and have no labels. Of repeated rows (equal doc_id) neither is smaller than the
other, each counts. A label counts where any of its rows says 1. A text is one value of any length. An empty table gives
no rows. Only doc_id, text and lang are read, so further columns can't clash.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import discard, let, stage, words

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Counters of a block, counters that a text touches, and bytes of looked-up bits that are broadcast at once.
BLOCK, TOUCHED, MAX_BYTES = 4096, 3, 1 << 28
#: Hashes that a task holds before it sends its counters on.
HELD = 1 << 20


def flags(text: Column) -> Column:
    """Bits 0-3 of the mask: the conditions A-D of a text without null."""

    def bits(w: Column) -> Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        capitals, chars = F.length(text) - F.length(F.translate(text, CAPITALS, "")), F.length(text)
        failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * chars, F.length(F.translate(text, SYMBOLS, "")) < chars]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))

    return let(words(text), bits)


def blocks_for(rows: int) -> int:
    """Blocks of the sketch, a power of two: 8 to 16 counters a row."""
    return 1 << max(0, (max(1, 8 * rows) - 1).bit_length() - (BLOCK - 1).bit_length())


def slots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit hash, and its TOUCHED counters in the block."""
    h = h.view(np.uint64)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h % np.uint64(blocks)).astype(np.int64), np.stack([(mixed >> np.uint64(64 - 12 * (i + 1))) & np.uint64(BLOCK - 1) for i in range(TOUCHED)]).astype(np.int64)


def counted(hashes: DataFrame, blocks: int) -> DataFrame:
    """The merged sketch of a column h: block, slots and counts (16-bit slots and 8-bit counts saturating at 2)."""
    schema = pa.schema([("block", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())])

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        block, slot = keys // BLOCK, (keys % BLOCK).astype("<u2")
        at = np.flatnonzero(np.diff(block, prepend=-1))
        to = np.append(at[1:], len(block))
        return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array([slot[a:b].tobytes() for a, b in zip(at, to)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(at, to)], pa.binary())], schema=schema)

    def own(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= HELD:
                yield summed(held)
                held, n = [], 0
        if n:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        block, slot = slots(np.concatenate(held), blocks)
        # a text touches a counter once, even where two of its hashes meet
        slot.sort(0)
        first = np.vstack([np.ones((1, slot.shape[1]), bool), slot[1:] != slot[:-1]])
        keys, n = np.unique((block[None] * BLOCK + slot)[first], return_counts=True)
        return rows(keys, np.minimum(n, 2).astype(np.uint8))

    def merged(batches):
        now, total = None, np.zeros(BLOCK, np.uint8)

        def done():
            at = np.flatnonzero(total)
            return rows(now * BLOCK + at, total[at])

        for batch in batches:
            for b, s, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != b:
                    if now is not None:
                        yield done()
                    now = b
                    total[:] = 0
                at = np.frombuffer(s, "<u2")
                total[at] = np.minimum(total[at] + np.frombuffer(c, np.uint8), 2)
        if now is not None:
            yield done()

    ddl = "block long, slots binary, counts binary"
    return hashes.select("h").mapInArrow(own, ddl).repartition("block").sortWithinPartitions("block").mapInArrow(merged, ddl)


def repeated_bits(sketch: DataFrame, low: int, high: int) -> np.ndarray:
    """Blocks low to high of the sketch, one bit a counter: whether it counted 2."""
    bits = np.zeros((high - low, BLOCK // 8), np.uint8)
    own = np.zeros(BLOCK, np.uint8)
    for r in sketch.where(F.col("block").between(low, high - 1)).toLocalIterator():
        own[:] = 0
        own[np.frombuffer(r.slots, "<u2")] = np.frombuffer(r.counts, np.uint8) >= 2
        bits[r.block - low] = np.packbits(own)
    return bits


def with_possible(docs: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """docs (with a column h), with possible: whether every counter of h is 2. Each section of the sketch looks up its
    own rows, so the result holds each row once."""
    parts, at_once = [], max(1, MAX_BYTES // (BLOCK // 8))
    for low in range(0, blocks, at_once):
        high = min(blocks, low + at_once)
        shared = docs.sparkSession.sparkContext.broadcast(repeated_bits(sketch, low, high))
        here = docs if high - low == blocks else docs.where(_block(F.col("h"), blocks).between(low, high - 1))
        parts.append(here.withColumn("possible", _lookup(shared, low, blocks)("h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lookup(shared, low: int, blocks: int):
    @arrow_udf("boolean")
    def possible(h: pa.Array) -> pa.Array:
        block, slot = slots(h.to_numpy(zero_copy_only=False), blocks)
        bits = shared.value
        return pa.array(np.all([bits[block - low, s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1 for s in slot], axis=0).astype(bool))

    return possible


def _block(h: Column, blocks: int) -> Column:
    """Block of a hash; blocks is a power of two, so signed and unsigned remainders agree."""
    return h.bitwiseAND(F.lit(blocks - 1))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bits 0-4: A-E failed) of each row of docs (doc_id, text, lang)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    given = given.withColumn("h", F.xxhash64("text"))
    blocks = blocks_for(docs.count())
    sketch = stage(counted(given.select("h"), blocks), "sketch")
    looked = with_possible(given, sketch, blocks)
    # the text of a row goes on only where it may be a repeat
    found = stage(looked.select("doc_id", "part", flags(F.col("text")).alias("mask"), "h", F.when(F.col("possible"), F.col("text")).alias("text")), "flags")
    discard(sketch)
    repeats = found.where("text IS NOT NULL")
    least = repeats.where("doc_id IS NOT NULL").groupBy("h", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = stage(least, "first")  # a plain table, so Spark can split the rows of one text that meet it
    later = repeats.join(first.withColumnsRenamed({"h": "h2", "text": "text2"}), (F.col("h") == F.col("h2")) & (F.col("text") == F.col("text2")), "left")
    failed = later.select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    return found.where("text IS NULL").select("doc_id", "part", "mask").unionByName(failed)


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: additive counts of rows by the filters that they fail."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    joined = masked.join(known, F.col("doc_id") == F.col("id"), "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """Order, step, bit of its filter and bits of those before, for every order of the filters."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for i, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append((order, i + 1, bit, before))
            before |= bit
    return out


def audited(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the counts by mask: at most 32 rows a part, so 600 steps of each."""
    step = F.explode(F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before")) for o, s, b, e in steps())))
    each = counts.select("*", step.alias("s")).select("*", "s.*").drop("s")
    mask, bit, before = (F.col(c).cast("int") for c in ("mask", "bit", "before"))
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0)).alias
    removed = fails & ~gone
    # of all 120 orders, a filter comes first among the k that a row fails in 120 / k
    share = (F.col("n") * 120 / F.bit_count(mask)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone)("kept"), total(removed)("removed"), total(fails & gone)("redundant"), total(mask == bit)("unique_fails"),
        total(removed, "good")("good_lost"), total(removed, "toxic")("toxic_lost"), F.sum(F.when(fails, share).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audited(mask_counts(masks(docs), labels))
