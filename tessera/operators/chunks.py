"""Splitting long texts and packing the parts."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import pack_batches

#: Characters of texts that are cut at a time; one text may have more.
MOST_CHARS = 1_000_000

RANGES = "range_no long, start long, stop long, continued boolean, continues boolean, context string"


def cut(text: str, start: int, most: int) -> tuple[int, bool]:
    """Where the range from start ends, and whether that is inside a line."""
    if len(text) - start <= most:
        return len(text), False
    limit, half = start + most, start + most // 2
    options = [p for p in (text.rfind("\n#", half, limit) + 1, text.rfind("\n\n", half, limit - 1) + 2) if p > half]
    line = text.rfind("\n", start + 1, limit) + 1
    return (max(options) if options else line if line > start else limit), not options and line <= start


def ranges(text: str, most: int) -> list[tuple[int, int, bool, bool, str]]:
    """Half-open ranges of at most `most` characters that make up a text: cut before a heading or after a blank line in
    the second half, else at a line end, else anywhere (then flagged as continued). Each carries the headings above it,
    up to a quarter of `most`. An empty text has one empty range."""
    out, start, cut_inside, heads = [], 0, False, []
    n = len(text)
    while True:
        stop, inside = cut(text, start, most)
        context = "\n".join(heads)
        out.append((start, stop, cut_inside, inside, context if len(context) <= most // 4 else ""))
        for line in text[start:stop].split("\n"):
            if line.startswith("#") and (depth := len(line) - len(line.lstrip("#"))) <= 6:
                heads = [h for h in heads if len(h) - len(h.lstrip("#")) < depth] + [line]
        if stop >= n:
            return out
        start, cut_inside = stop, inside


def _pieces(batches):
    """Columns of (key, text) as lists, for texts of about MOST_CHARS characters at a time; null texts are empty."""
    for b in batches:
        texts = pc.fill_null(b.column(1), "")
        part = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // MOST_CHARS
        for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]):
            if hi > lo:
                yield b.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist()


def chunk_ranges(docs: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The ranges of each text (null counts as empty): key, range_no, start, stop, continued, continues, context."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for keys, texts in _pieces(batches):
            rows = [(j, i, *r) for j, t in enumerate(texts) for i, r in enumerate(ranges(t, most))]
            own, number, start, stop, continued, continues, context = zip(*rows)
            columns = [keys.take(pa.array(own)), pa.array(number, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(continued), pa.array(continues), pa.array(context, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "range_no", "start", "stop", "continued", "continues", "context"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, {RANGES}")


def sections(text: str, most: int) -> list[str]:
    """Chunks of at most `most` characters at headings and paragraphs; table rows aren't divided, and a table's header is
    repeated in each chunk of it where it fits."""
    out, at = [], 0
    while at < len(text) or not out:
        head = table_head(text[max(0, at - 20 * most) : at]) if text[at : at + 1] == "|" else ""
        head = head if len(head) <= most // 2 else ""
        stop, _ = cut(text, at, most - len(head))
        out.append(head + text[at:stop])
        at = stop
    return out


def table_head(before: str) -> str:
    """Header and ruler of the table that a text ends in, or ''."""
    rows = []
    for line in reversed(before.rstrip("\n").split("\n")):
        if not line.lstrip().startswith("|"):
            break
        rows.append(line)
    rows.reverse()
    return "\n".join(rows[:2]) + "\n" if len(rows) >= 2 and set(rows[1].strip()) <= set("|-: ") else ""


def section_chunks(docs: DataFrame, most: int = 2000, key: str = "doc_id") -> DataFrame:
    """(key, chunk_no, chunk) of each text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, i, c) for k, t in zip(pdf[key], pdf.text) for i, c in enumerate(sections(t or "", most))], columns=[key, "chunk_no", "chunk"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, chunk_no long, chunk string")


def pack_ranges(found: DataFrame, budget: int = 40_000, key: str = "doc_id") -> DataFrame:
    """Neighbouring ranges of a document share a batch while their text and context fit the budget."""
    units = found.select(F.col(key).alias("session"), F.col("range_no").alias("pos"), (F.col("stop") - F.col("start") + F.length("context")).alias("tokens"), F.lit(1).cast("long").alias("messages"))
    return pack_batches(units, budget, 1 << 31).select(F.col("session").alias(key), F.col("pos").alias("range_no"), "batch", "oversized")
