"""Operator 5: pack token sequences by bounded-space online best fit.

`pieces` turns each document into token ids plus an end id and cuts only documents longer than a sequence;
`pack` places the pieces. Each task keeps a fixed number of open bins in a bitset keyed by free space: the
lowest set bit at or above a piece's length is the best fit, and when no bin fits and all are in use, the
fullest closes. A piece's place is known at once, so a task holds the bins only, never the rows.

Null text counts as empty (one end id), empty tables give empty results, repeated rows are packed once each, a
null doc_id stays null. Other columns of the input are ignored, so names can't clash. Rows are dealt out in groups of
about GROUP by a hash of (doc_id, piece); a task takes its groups one after the other and each from the longest piece to
the shortest, which wastes a twentieth of what a random order does. The order is fixed, so a task that runs again makes
the same sequences.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs: few enough for a task, enough that bins left open at its end are a small part.
PIECES_A_TASK, GROUP = 32768, 2048


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def encoder(path: str):
    """Function from text to the ids that the tokenizers library gives without special tokens around the text; added
    tokens within it, such as `<|endoftext|>`, get their own ids. For a tokenizers file whose ranks lie beside it,
    tiktoken on the same vocabulary gives these in a quarter of the time."""
    import base64
    import json
    import os

    import public_tokenizers

    ranks = path.removesuffix(".json") + ".tiktoken"
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    if os.path.exists(ranks) and plain:
        import tiktoken

        with open(ranks, "rb") as f:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t["content"]: t["id"] for t in added}
        t = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens=special)
        return lambda text: t.encode(text, allowed_special="all") if any(x in text for x in special) else t.encode_ordinary(text)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def cut(length: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length); all but the first piece are full."""
    first = (length - 1) % most + 1
    yield 0, 0, first
    for i, start in enumerate(range(first, length, most), 1):
        yield i, start, most


def pieces(docs: DataFrame, max_length: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """The pieces of every whole text, with the crc32 of their ids (little-endian, 32 bits)."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                rows += [(doc_id, k, a, n, zlib.crc32(ids[a : a + n])) for k, a, n in cut(len(ids), max_length)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class Bins:
    """Open bins of one task. `spaces` has a bit for each free space that an open bin has."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.spaces, self.by_space, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def take(self, space: int) -> int:
        found = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        if fits := self.spaces >> length:
            space = length + (fits & -fits).bit_length() - 1
            found = self.take(space)
        else:
            if self.open == self.most_open:
                self.take((self.spaces & -self.spaces).bit_length() - 1)
            space, found = self.capacity, self.made
            self.made += 1
        if left := space - length:
            self.by_space[left].append(found)
            self.spaces |= 1 << left
            self.open += 1
        return found, self.capacity - space


def pack(found: DataFrame, capacity: int = 2048, most_open: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and a length of at most `capacity`."""
    found = stage(found, "pieces")
    n = found.count()

    def run(batches):
        bins, base = Bins(capacity, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield batch.append_column("sequence_id", pa.array([base + b for b, _ in places], pa.int64())).append_column("offset", pa.array([at for _, at in places], pa.int64()))

    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 + n // GROUP))
    dealt = found.repartition(1 + n // PIECES_A_TASK, group).sortWithinPartitions(group, F.desc("length"), *found.columns)
    return dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
