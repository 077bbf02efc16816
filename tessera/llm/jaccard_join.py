"""Operator 2: Jaccard join on word n-grams by a grouped prefix join.

A document's set holds hashes (64 bits) of its n-word shingles, A-Z in lower case. Sets are ordered by how rare a
shingle is, then by how rare its rarest word is, so that two sets can only be similar if they share one of their first
n - ceil(tn) + 1 members, their prefixes. Counts come from sketches over all documents: SKETCH cells of words, and of
OFTEN cells of shingles those that stand out in a task. So what is sent to the tasks has a fixed size; any order gives the
same result. Shingles of a passage that a share of all documents quotes come last, so that such documents, whose number
grows with the table, meet in lists only where little else is in them.

1. Equal sets become one node. Nodes with the same prefix and size collapse into one group, for which one of its nodes
   stands. Only groups are listed by prefix members; a member that a single group has makes no list.
2. In each list a centre is paired with the other groups, in each group one node with the others. Pairs of groups that
   the bounds on size and position leave are verified on the nodes that stand for them: bitmaps, then whole sets.
3. Links found so far give components. Lists whose nodes are in several components need more: pairs of their groups are
   filtered by size and position, then expanded to pairs of nodes of different components, and those that the bitmaps
   leave are verified on their whole sets. Short lists are joined to themselves; long ones are cut into blocks, and a
   pair of blocks is one unit of work, so no list is gathered whole. To that only numbers are sent. Pairs of a family are
   many, so each is looked at in one unit of those that found it, and bitmaps and sets are sent to each unit once. So a
   family of copies costs a few links a copy, not one a pair, and no link between components is lost.

Bounds: 100 |A and B| >= t |A or B| asks for overlap >= t / (100 + t) of the sizes' sum. After a match at positions i and j
with none before, overlap <= min(|A| - i, |B| - j). A bitmap sets a bit for each member's hash, so the number of
bits that two bitmaps differ in is at most the size of the sets' symmetric difference.

Null and empty texts have no words: set size 0, linked with nothing. Rows with equal doc_id and text get the same
result each; one doc_id with several texts is handled by text. Null doc_ids take part, but never name a component
unless it has no other. Only doc_id and text are read, so further columns can't clash. Empty tables give empty
results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, BooleanType, LongType, MapType
from pyspark.sql.window import Window

from .common import discard, stage
from .components import components

SKETCH = 1 << 16
#: Cells of shingles, and of these the ones that a task reports at most.
OFTEN, MOST_OFTEN = 1 << 20, 1 << 16
#: Lists of up to SHORT nodes are joined to themselves; longer ones are cut into blocks of about BLOCK nodes, and of about
#: BLOCK_WORDS members of their sets.
SHORT, BLOCK, BLOCK_WORDS = 32, 512, 1 << 20
#: Different centres that lists with the same groups take.
CENTRES = 2
#: Nodes, of 32 bytes each, whose texts are found by a broadcast join; more are shuffled.
MOST_BROADCAST = 500_000
#: Stands for a null doc_id in keys.
NO_ID = -(1 << 63)


class Hashes(dict):
    """Hashes of words, remembered; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = Hashes()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in a row."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()  # bytes: A-Z and the ASCII white space only
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the shingles in order; of fewer than n words, one of them all."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mix(out, h[k : len(h) - n + 1 + k])
    return mix(out, np.full(len(out), n, np.uint64))


def members(text: bytes | None, n: int) -> np.ndarray:
    """The set of a text, sorted."""
    return np.unique(shingles(word_hashes(text), n))


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bit for each member; the number of bits is a power of two from 512 to 32768, about four times the members."""
    bits = 1 << min(15, max(9, int(len(found) * 4).bit_length()))
    flags = np.zeros(bits, bool)
    flags[(found >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(flags)


def fold(a: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) folded to `size` bytes."""
    while a.shape[-1] > size:
        half = a.shape[-1] // 2
        a = a[..., :half] | a[..., half:]
    return a


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b."""
    return -(-(percent * (a + b)) // (100 + percent))


def standing_out(counts: np.ndarray) -> np.ndarray:
    """Cells, MOST_OFTEN at most, with far more than the mean count, as shingles of one document each hardly make together."""
    mean = counts.mean()
    at = np.flatnonzero(counts > mean + 6 * mean**0.5 + 8)
    return at if len(at) <= MOST_OFTEN else at[np.argsort(-counts[at], kind="stable")[:MOST_OFTEN]]


def frequencies(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of words by cell of their hash, and of shingles by cell where they stand out, else 0."""

    def run(batches):
        words, often = np.zeros(SKETCH, np.int64), np.zeros(OFTEN, np.int32)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                h = word_hashes(t.as_py())
                words += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                np.add.at(often, (shingles(h, n) % np.uint64(OFTEN)).astype(np.int64), 1)
        at, more = np.flatnonzero(words), standing_out(often)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, SKETCH + more)), pa.array(np.append(words[at], often[more]))], names=["cell", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH + OFTEN, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out[:SKETCH], out[SKETCH:]


def _tied(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, tie (hash of the text), size n, node (hash of the set; null without words), grp (hash of prefix and
    size), prefix and bitmap of each document. Both hashes have 128 bits."""
    counts = docs.sparkSession.sparkContext.broadcast(frequencies(docs, n))

    def one(text: bytes | None):
        h = word_hashes(text)
        if not len(h):
            return 0, None, None, [], b""
        words, often = counts.value
        rare = words[(h % np.uint64(SKETCH)).astype(np.int64)]
        k = min(n, len(h))
        weight = rare[: len(h) - k + 1]
        for i in range(1, k):
            weight = np.minimum(weight, rare[i : len(h) - k + 1 + i])
        found, at = np.unique(shingles(h, n), return_index=True)
        size = len(found)
        order = np.lexsort((found, weight[at], often[(found % np.uint64(OFTEN)).astype(np.int64)]))
        prefix = found[order[: size - -(-percent * size // 100) + 1]]
        return size, xxhash.xxh3_128_digest(found), xxhash.xxh3_128_digest(prefix, seed=size), prefix.view(np.int64), bitmap(found).tobytes()

    def run(batches):
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            size, node, group, prefix, bits = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(group, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "tie", "n", "node", "grp", "prefix", "bits"])

    return _tied(docs).mapInArrow(run, "doc_id long, tie long, n long, node binary, grp binary, prefix array<long>, bits binary")


def distinct_nodes(signed: DataFrame) -> DataFrame:
    """A row for each set, written down: its number id, node, grp, n, prefix, bits, its least doc_id and one document that has it."""
    same = (F.any_value(c).alias(c) for c in ("grp", "n", "prefix", "bits"))
    found = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tie")).alias("one"), *same)
    return stage(found.withColumn("id", F.monotonically_increasing_id()), "distinct")


def grouped(nodes: DataFrame) -> DataFrame:
    """(id, g) of each node, written down: g is the least number in its group, and the node of that number stands for it."""
    return stage(nodes.select("id", "grp").join(nodes.groupBy("grp").agg(F.min("id").alias("g")), "grp").select("id", "g"), "members")


def lists(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(key, g, n, pos): the lists in which similar groups must meet; keys that only one group has are dropped. Rows
    are three numbers until then, for there are many."""
    others = stage(members.where("id <> g").select("id"), "others")
    rows = nodes.select("id", "n", "prefix").join(others, "id", "left_anti").select(F.col("id").alias("g"), "n", F.posexplode("prefix").alias("pos", "key"))
    packed = rows.select("key", "g", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    shared = packed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    return packed.join(shared, "key").select("key", "g", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))


def _may(n: tuple, p: tuple, percent: int) -> F.Column:
    """Whether the bounds on size and position let two groups of a list be similar."""
    return F.least(n[0] - p[0], n[1] - p[1]) * (100 + percent) >= (n[0] + n[1]) * percent


def star_pairs(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Group pairs of each list's centre with its other groups, as pairs of the nodes that stand for them, and such
    pairs within groups. Lists take one of CENTRES orders, so a family that shares many lists has several centres."""
    turn = F.pmod("key", F.lit(CENTRES))
    order = F.when(turn == 0, F.col("pos")).otherwise(F.xxhash64("g", turn))
    centre = rows.groupBy("key").agg(F.min(F.struct(order.alias("order"), "g", "n", "pos")).alias("c"))
    across = rows.join(centre, "key").where(_may((F.col("n"), F.col("c.n")), (F.col("pos"), F.col("c.pos")), percent)).select("g", F.col("c.g").alias("other"))
    both = across.unionByName(members.select("g", F.col("id").alias("other"))).where("g <> other")
    return both.select(F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b")).distinct()


def rest_pairs(rows: DataFrame, members: DataFrame, nodes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (unit, a, b) of nodes of different components that the bounds leave, from lists with several components, written
    down; each in one of the units of work that found it. A group is also a list of its own."""
    light = stage(members.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "g", F.coalesce("component", "id").alias("comp")), "light")
    ends = light.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size"))
    ended = stage(rows.join(ends, "g"), "ended")
    sums = [F.sum("size").alias("total"), F.sum(F.col("n") * F.col("size")).alias("words"), F.min("c0").alias("least"), F.max("c1").alias("most")]
    open_ = ended.groupBy("key").agg(*sums).where("total > 2 AND least < most").select("key", "total", "words")
    left = stage(ended.join(open_, "key"), "open")
    discard(ended)
    own = ends.where("size > 2 AND c0 < c1").join(nodes.select(F.col("id").alias("g"), "n"), "g").select(F.xxhash64("g").alias("key"), "g", "n", F.lit(-1).cast("long").alias("pos"), F.col("size").alias("total"), (F.col("n") * F.col("size")).alias("words"))
    long = left.where(F.col("total") > SHORT).select(*own.columns).unionByName(own)
    both = _short_pairs(left.where(F.col("total") <= SHORT), light, percent).unionByName(_long_pairs(long, light, percent))
    pairs = stage(both.groupBy("a", "b").agg(F.min("unit").alias("unit")), "candidates")
    discard(left, light)
    bits = nodes.select("id", "n", F.col("bits").alias("value"))
    near = stage(met(pairs, bits, lambda n, value, a, b: alike(n, value, a, b, percent)), "pairs")
    discard(pairs)
    return near


def _short_pairs(left: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups of short lists that the bounds on size and position leave, expanded to pairs of nodes; few, for
    SHORT bounds the nodes of a list."""
    side = lambda k: left.select("key", *(F.col(c).alias(f"{k}_{c}") for c in ("g", "n", "pos", "c0", "c1")))
    apart = (F.least("a_c0", "b_c0") < F.greatest("a_c1", "b_c1")) & (F.col("a_g") < F.col("b_g"))
    groups = side("a").join(side("b"), "key").where(apart & _may((F.col("a_n"), F.col("b_n")), (F.col("a_pos"), F.col("b_pos")), percent)).groupBy("a_g", "b_g").agg(F.min("key").alias("unit"))
    member = lambda k: light.select(F.col("g").alias(f"{k}_g"), F.col("id").alias(f"{k}_id"), F.col("comp").alias(f"{k}_comp"))
    both = groups.join(member("a"), "a_g").join(member("b"), "b_g").where("a_comp <> b_comp")
    return both.select("unit", F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def _long_pairs(left: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """As _short_pairs for long lists, which are cut into blocks of about BLOCK nodes (fewer where sets are large). The unit
    of work is a pair of blocks, to which a few numbers of each node are sent: pairs of groups are filtered by size and
    position first, then those left are expanded to pairs of nodes."""
    blocks = F.ceil(F.greatest(F.col("total") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    each = left.withColumn("blocks", blocks).join(light, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = each.select("key", (F.col("pos") < 0).cast("int").alias("alone"), "pos", "own", "id", "g", "comp", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other")

    def run(batches):
        for t in unit_tables(batches, ("key", "alone", "x", "y")):
            a, b = unit_pairs(t, percent)
            unit = np.full(len(a), t["unit"][0].as_py(), np.int64)
            yield from pa.table({"unit": unit, "a": a, "b": b}).to_batches(max_chunksize=10_000)

    keys = ("key", "alone", "x", "y")
    return dealt.withColumn("unit", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "unit long, a long, b long")


def unit_tables(batches, keys):
    """Tables of rows that are equal in all keys, from batches sorted by them; such runs are bounded by the blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *starts.tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = batch.slice(a, b - a)
            if held and (i or any(held[-1].column(k)[0] != part.column(k)[0] for k in keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def unit_pairs(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of one pair of blocks: filter pairs of groups, expand them, filter pairs of nodes."""
    node, g, comp, n, pos, own = (t[c].to_numpy() for c in ("id", "g", "comp", "n", "pos", "own"))
    x, y, alone = t["x"][0].as_py(), t["y"][0].as_py(), pos[0] < 0
    _, of_group, group = np.unique(g, return_index=True, return_inverse=True)
    gn, gpos = n[of_group], pos[of_group]
    may = np.minimum(gn[:, None] - gpos[:, None], gn[None] - gpos[None]) >= needed(gn[:, None], gn[None], percent)
    may = np.eye(len(gn), dtype=bool) if alone else may & ~np.eye(len(gn), dtype=bool)  # pairs within a group belong to its own list
    i, j = np.flatnonzero(own == x), np.flatnonzero(own == y)
    ok = may[group[i][:, None], group[j][None]] & (comp[i][:, None] != comp[j][None])
    if x == y:
        ok &= node[i][:, None] < node[j][None]
    u, v = np.nonzero(ok)
    a, b = node[i[u]], node[j[v]]
    return np.minimum(a, b), np.maximum(a, b)


def met(pairs: DataFrame, values: DataFrame, similar) -> DataFrame:
    """Those of the (written) pairs (unit, a, b) for which similar(n, value, a, b) holds; a and b are places in the arrays n and
    value. What a node has is sent to each of its units once, not with each of its pairs."""
    given = values.select(F.col("id").alias("a"), "n", "value")
    ends = pairs.select("unit", F.explode(F.array("a", "b")).alias("a")).distinct()
    sent = ends.join(given, "a").select("unit", "a", F.lit(None).cast("long").alias("b"), "n", "value")
    asked = pairs.select("unit", "a", "b", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("value"))

    def run(batches):
        for t in unit_tables(batches, ("unit",)):
            asks = pc.is_valid(t["b"])
            nodes, pairs = t.filter(pc.invert(asks)).sort_by("a"), t.filter(asks).select(["unit", "a", "b"])
            a, b = (np.searchsorted(nodes["a"].to_numpy(), pairs[c].to_numpy()) for c in ("a", "b"))
            good = similar(nodes["n"].to_numpy(), [np.frombuffer(v.as_buffer(), np.uint8) for v in nodes["value"]], a, b)
            yield from pairs.filter(pa.array(good, pa.bool_())).to_batches(max_chunksize=10_000)

    return sent.unionByName(asked).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "unit long, a long, b long")


def alike(n: np.ndarray, bits: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether bitmaps leave pairs of sets of sizes n, each compared at the smaller length of its two."""
    sizes, good = np.array([len(x) for x in bits]), np.zeros(len(a), bool)
    least = np.minimum(sizes[a], sizes[b])
    for size in np.unique(least):
        own = np.flatnonzero(least == size)
        used, place = np.unique(np.stack([a[own], b[own]]), return_inverse=True)
        rows, (x, y) = np.stack([fold(bits[i], size) for i in used]).view(np.uint64), place.reshape(2, -1)
        step = max(1, 4_000_000 // int(size))
        for s in range(0, len(own), step):
            at = own[s : s + step]
            apart = np.bitwise_count(rows[x[s : s + step]] ^ rows[y[s : s + step]]).sum(1, dtype=np.int64)
            good[at] = apart <= n[a[at]] + n[b[at]] - 2 * needed(n[a[at]], n[b[at]], percent)
    return good


def overlapping(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


@arrow_udf(LongType())
def _apart(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bits that two bitmaps differ in."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        size = min(len(x), len(y))
        out.append(int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()))
    return pa.array(out, pa.int64())


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the bitmaps leave."""
    side = lambda k: nodes.select(F.col("id").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    least = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent))
    return both.where(_apart("a_bits", "b_bits") <= F.col("a_n") + F.col("b_n") - 2 * least).select("a", "b")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the (written) pairs that are similar, from the whole sets of their nodes, written down. Sets are sent with each
    pair, of which there are few for a node, or where pairs have units once to each of a node's units."""

    @arrow_udf(BinaryType())
    def set_of(text: pa.Array) -> pa.Array:
        return pa.array([members(t.as_py(), n).tobytes() for t in text.cast(pa.binary())], pa.binary())

    @arrow_udf(BooleanType())
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        sets = ((np.frombuffer(v.as_buffer(), np.uint64) for v in p) for p in zip(a, b, strict=True))
        return pa.array([overlapping(*p, percent) for p in sets], pa.bool_())

    def all_similar(n: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[bool]:
        sets = [x.view(np.uint64) for x in sets]
        return [overlapping(sets[i], sets[j], percent) for i, j in zip(a, b, strict=True)]

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    one = stage(nodes.select("id", "one").join(wanted, "id", "left_semi").select("id", F.col("one.doc_id").alias("one_id"), F.col("one.tie").alias("one_tie")), "nodes")
    few = F.broadcast(one) if one.count() <= MOST_BROADCAST else one
    sets = _tied(docs).join(few, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("tie") == F.col("one_tie"))).select("id", set_of("text").alias("members"))
    sets = stage(sets, "sets")
    side = lambda k: sets.select(F.col("id").alias(k), F.col("members").alias(f"{k}_set"))
    if "unit" in pairs.columns:
        found = met(pairs, sets.select("id", F.lit(0).cast("long").alias("n"), F.col("members").alias("value")), all_similar)
    else:
        found = pairs.join(side("a"), "a").join(side("b"), "b").where(similar("a_set", "b_set"))
    links = stage(found.select("a", "b"), "links")
    discard(one, sets, pairs)
    return links


def _linked(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures, and (node, least, component) of each set: its least doc_id and the number of its component."""
    whole = stage(signatures(docs, n, percent), "signatures")
    nodes, signed = distinct_nodes(whole), stage(whole.select("doc_id", "tie", "n", "node"), "signed")
    discard(whole)
    inside = grouped(nodes)
    rows = stage(lists(nodes, inside), "lists")
    first = verified(docs, nodes, stage(_bounded(star_pairs(rows, inside, percent), nodes, percent), "pairs"), n, percent)
    known = components(first)
    more = verified(docs, nodes, rest_pairs(rows, inside, nodes, known, percent), n, percent)
    discard(rows, inside)
    found = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = stage(nodes.select("id", "node", "least").join(found.withColumnRenamed("node", "id"), "id", "left").select("node", "least", F.coalesce("component", "id").alias("component")), "named")
    discard(nodes, first, more)
    return signed, named


def joined(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    signed, found = _linked(docs, n, percent)
    named = found.join(found.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    both = signed.select("doc_id", "n", "node").join(named, "node", "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the least doc_id, nulls last; of several texts
    of one doc_id the one with the smallest hash, of repeated rows one. Rows without a word all stay. Winners are found
    on keys; the rows themselves move once."""
    signed, found = _linked(docs, n, percent)
    row_id = F.coalesce("doc_id", F.lit(NO_ID))
    worded = signed.where("n > 0").select("node", F.struct(F.col("doc_id").isNull().alias("last"), row_id.alias("_nj_id"), F.col("tie").alias("_nj_tie")).alias("k")).distinct()
    winners = worded.join(found, "node").groupBy("component").agg(F.min("k").alias("k")).select("k._nj_id", "k._nj_tie", F.lit(False).alias("_nj_all"))
    empty = signed.where("n = 0").select(row_id.alias("_nj_id"), F.col("tie").alias("_nj_tie"), F.lit(True).alias("_nj_all")).distinct()
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_nj_id"), F.xxhash64(F.col("text").cast("string")).alias("_nj_tie"), F.struct(*docs.columns).alias("_nj_row"))
    hashed = F.xxhash64(*(F.col(f"_nj_row.{f.name}") for f in docs.schema if not isinstance(f.dataType, MapType)))
    rows = given.join(winners.unionByName(empty), ["_nj_id", "_nj_tie"]).withColumn("_nj_no", F.row_number().over(Window.partitionBy("_nj_id", "_nj_tie").orderBy(hashed)))
    return rows.where("_nj_all OR _nj_no = 1").select("_nj_row.*")
