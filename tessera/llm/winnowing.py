"""Operator 3: document fingerprints by winnowing.  DataFrame functions only.

A text is cut into units: words, but signs of scripts that are written without spaces stand alone, and a longer run
without spaces is cut into pieces. A unit is hashed once; the hash of K units in a row is rolled on from hashes that the
neighbouring grams share, and the smallest of WINDOW neighbouring hashes from minima that the neighbouring windows
share, so the work for a unit depends on neither K nor WINDOW. Of each window the smallest hash is kept, of equals the
rightmost, with its position in units; at both ends of the text windows reach beyond it.

So two texts that share K + WINDOW - 1 units in a row share a fingerprint, as do two that begin or end with the same
K units; a run shorter than K units never makes one. A selected hash is one long: 34 bits of hash, then 30 bits
that fall with the position, so that the smallest long is the smallest hash and, of equals, the rightmost one; no
string is long enough for more positions.

A text with fewer than K units has one gram of all its units; null and empty texts have none, and two texts
without any are alike (1.0). Equal texts have equal fingerprints. In `with_next`, documents come by descending doc_id,
null ids last, of equal ids by text; repeated rows follow each other, a single document follows itself, and an empty
table gives an empty result. Only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

#: Units of a gram, and grams of a window (a power of two).
K, WINDOW = 3, 8
#: Signs of scripts written without spaces, and a unit of text at most this long.
ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uA960-\uA97F\uAC00-\uD7FF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
UNIT = rf"[{ALONE}]|[^{ALONE}\x20\x09-\x0D]{{1,24}}"
MASK = (1 << 30) - 1
NOTHING = (1 << 63) - 1
#: Documents that one group of neighbouring ids should have, and groups at most, found in two steps of STEP.
GROUP, STEP = 500, 256


def _neighbours(values: Column, apart: int, f) -> Column:
    """f of each value and the one `apart` places on, as long as there is one."""
    n = F.size(values) - apart
    return F.when(n > 0, F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + apart), n), f)).otherwise(F.slice(values, 1, 0))


def selected(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The selected hashes of a text as longs, by position. The window must be a power of two."""

    def rolled(h: Column, size: int, to: int) -> Column:
        """Hashes of `to` units in a row from those of `size`."""
        if size == to:
            return h
        step = min(size, to - size)
        return let(_neighbours(h, step, lambda a, b: F.xxhash64(a, b)), lambda x: rolled(x, size + step, to))

    def keyed(grams: Column) -> Column:
        return F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(~MASK)).bitwiseOR(F.lit(MASK) - i.cast("long")))

    def smallest(keys: Column, size: int) -> Column:
        if size == window:
            return F.array_distinct(keys)
        return let(_neighbours(keys, size, lambda a, b: F.least(a, b)), lambda x: smallest(x, 2 * size))

    def of_units(h: Column) -> Column:
        grams = F.when(F.size(h) >= k, rolled(h, 1, k)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(h)
        edge = F.array_repeat(F.lit(NOTHING), window - 1)
        return F.when(F.size(h) == 0, h).otherwise(let(F.concat(edge, keyed(grams), edge), lambda x: smallest(x, 1)))

    return let(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda w: F.xxhash64(w)), of_units)


def positions(keys: Column) -> Column:
    """Selected hashes as (hash, pos) structs."""
    return F.transform(keys, lambda x: F.struct(F.shiftright(x, 30).alias("hash"), (F.lit(MASK) - x.bitwiseAND(F.lit(MASK))).alias("pos")))


def rendered(keys: Column) -> Column:
    """Fingerprint as text: position:hash, by position."""
    one = lambda x: F.concat_ws(":", (F.lit(MASK) - x.bitwiseAND(F.lit(MASK))).cast("string"), F.lower(F.hex(F.shiftrightunsigned(x, 30))))
    return F.array_join(F.transform(keys, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two texts' sets of selected hashes."""
    hashes = lambda keys: F.transform(keys, lambda x: F.shiftright(x, 30))
    parts = F.array(F.struct(hashes(a).alias("a"), hashes(b).alias("b")))
    return F.transform(parts, lambda p: F.when(F.size(p["a"]) + F.size(p["b"]) == 0, 1.0).otherwise(F.size(F.array_intersect(p["a"], p["b"])) / F.size(F.array_union(p["a"], p["b"]))))[0]


def _below(cuts: list[int], key: Column) -> Column:
    """How many of the cuts, which are in order, lie below key; looked up in two steps."""
    count = lambda a: F.size(F.filter(a, lambda c: c < key))
    every = F.lit(cuts).cast("array<bigint>")
    coarse = count(F.lit(cuts[STEP - 1 :: STEP]).cast("array<bigint>")) * STEP if len(cuts) >= STEP else F.lit(0)
    return let(coarse, lambda c: c + count(F.slice(every, c + 1, F.lit(STEP))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and selected hashes of each document, and the next one's text and hashes as struct `next`. Ids are
    cut into groups at approximate quantiles; a group also gets a copy of the document that follows its last. Only texts
    are shuffled: hashes are made where a group's documents lie in order."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = given.count()
    groups = max(1, min(STEP * STEP, n // GROUP))
    found = given.agg(F.percentile_approx(key, F.lit([i / groups for i in range(1, groups)] or [1.0]), max(1000, 4 * groups)).alias("q"), F.max(key).alias("last")).first()
    cuts = sorted({*(found.q or []), found.last} - {None}) or [0]
    place = lambda group, copy: F.struct(group.cast("int").alias("group"), F.lit(copy).alias("copy"))

    def places(own: Column) -> Column:
        """A document that ends a group (ids above come first) is also the one that follows the last of the group above; after the very last comes the first."""
        ends = F.element_at(F.lit(cuts).cast("array<bigint>"), F.least(own + 1, F.lit(len(cuts)))) == key
        above = F.when(key == F.lit(cuts[-1]).cast("long"), 0).otherwise(own + 1)
        return F.when(ends, F.array(place(own, False), place(above, True))).otherwise(F.array(place(own, False)))

    placed = given.select("doc_id", "text", F.explode(let(_below(cuts, key), places)).alias("place")).select("doc_id", "text", "place.group", "place.copy")
    order = [F.col("copy"), F.desc_nulls_last("doc_id"), F.col("text")]
    hashed = placed.repartition("group").sortWithinPartitions("group", *order).withColumn("keys", selected(F.col("text")))
    following = F.lead(F.struct("text", "keys")).over(Window.partitionBy("group").orderBy(*order))
    return hashed.withColumn("next", following).where("NOT copy").drop("group", "copy")


def compared(docs: DataFrame) -> DataFrame:
    """Each document beside an edited text, whose last half is the beginning of the next document: both fingerprints
    and their likeness, and that to the next document's."""
    both = with_next(docs)
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = both.select("doc_id", "keys", F.col("next.keys").alias("next_keys"), chars.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next.text", F.lit(1), half)).alias("edited"))
    known = edited.select("*", selected(F.col("edited")).alias("edited_keys"))
    return known.select(
        "doc_id", "n_chars", "edited", "keys", "edited_keys",
        likeness(F.col("keys"), F.col("edited_keys")).alias("near_edited"), likeness(F.col("keys"), F.col("next_keys")).alias("near_next"),
    )
