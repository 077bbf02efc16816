"""Operator 12: prefix trie of conversations.

A turn's id is the SHA-256 of its role and text, a fixed width of big-endian bytes; a conversation's key is its turns'
ids in order. Keys are dealt to tasks by range, so each task holds a contiguous part of the trie, and equal keys lie
side by side in order of conversation, over several tasks where they are many. A task puts up to BATCH keys at a time
into an adaptive radix tree (layouts of 4, 16, 48 and 256 children that grow, compressed paths), whose bytes are walked
once; only depths that are whole turns become nodes, a compressed path of several turns a chain of them. Nodes off the
paths to the batch's first and last key are final. Those on the two paths, which neighbouring batches may share, keep
what hangs beside the path; such path rows, two a batch, meet in key order in one task that holds one open path and
adds them up. So what one task gets is 1/10,000 of the conversations at most, and no node's members are ever collected:
their ids go through SHA-256 in order, one chunk of a batch at a time.

Null roles and texts count as empty. Rows with a null conv_id belong to no conversation and are left out. Turns are
ordered with null first; rows of equal turn by role, then by turn id; repeated rows stay. One conversation is one key,
32 bytes a turn, so it must fit a task, its texts needn't. An empty table has no members, so no root. Only conv_id,
turn, role and text are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

#: Bytes of a turn id; conversations and bytes of keys in a tree at most.
WIDTH, BATCH, MAX_BYTES = 32, 20_000, 1 << 24
NONE = hashlib.sha256().hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Few:
    """Up to `most` children: sorted bytes, and children in the same order."""

    def __init__(self, most: int, keys=b"", kids=()):
        self.most, self.keys, self.kids = most, bytearray(keys), list(kids)

    def find(self, byte: int):
        i = bisect_left(self.keys, byte)
        return self.kids[i] if i < len(self.keys) and self.keys[i] == byte else None

    def put(self, byte: int, kid):
        """Set a child; gives the layout to use from now on."""
        i = bisect_left(self.keys, byte)
        if i < len(self.keys) and self.keys[i] == byte:
            self.kids[i] = kid
            return self
        if len(self.keys) == self.most:
            grown = Few(16, self.keys, self.kids) if self.most == 4 else Indexed(self.keys, self.kids)
            return grown.put(byte, kid)
        self.keys.insert(i, byte)
        self.kids.insert(i, kid)
        return self

    def ordered(self) -> list:
        return self.kids


class Indexed:
    """Up to 48 children: for each byte the child's place, 255 for none."""

    def __init__(self, keys, kids):
        self.places, self.kids = bytearray(b"\xff" * 256), list(kids)
        for i, byte in enumerate(keys):
            self.places[byte] = i

    def find(self, byte: int):
        i = self.places[byte]
        return None if i == 255 else self.kids[i]

    def put(self, byte: int, kid):
        i = self.places[byte]
        if i != 255:
            self.kids[i] = kid
            return self
        if len(self.kids) == 48:
            grown = Direct(self)
            return grown.put(byte, kid)
        self.places[byte] = len(self.kids)
        self.kids.append(kid)
        return self

    def ordered(self) -> list:
        return [self.kids[i] for i in self.places if i != 255]


class Direct:
    """A child for each byte."""

    def __init__(self, old: Indexed):
        self.kids = [old.find(b) for b in range(256)]

    def find(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def ordered(self) -> list:
        return [k for k in self.kids if k is not None]


class Branch:
    """A node of the tree: the bytes that lead to it from its parent, its children, and what ends here."""

    __slots__ = ("path", "kids", "ends")

    def __init__(self, path: bytes, ends=None):
        self.path, self.kids, self.ends = path, None, ends

    def put(self, kid: Branch) -> None:
        self.kids = (self.kids or Few(4)).put(kid.path[0], kid)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Bytes that a shares with b from b's place start on."""
    if b.startswith(a, start):
        return len(a)
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[start + low : start + mid] else (low, mid - 1)
    return low


class Tree:
    """Adaptive radix tree; a value is the sizes of the key's turns and the conversations that end there."""

    def __init__(self):
        self.root = Branch(b"")

    def insert(self, key: bytes, sizes, conv_id: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.find(key[at]) if node.kids else None
            if kid is None:
                kid = Branch(key[at:])
                node.put(kid)
                node, at = kid, len(key)
                break
            same = common(kid.path, key, at)
            if same < len(kid.path):
                upper = Branch(kid.path[:same])
                kid.path = kid.path[same:]
                upper.put(kid)
                node.put(upper)
                kid = upper
            node, at = kid, at + same
        if node.ends is None:
            node.ends = (sizes, [])
        node.ends[1].append(conv_id)


class Sum:
    """What lies below a place of the tree: members, smallest member, trie nodes without a trie node between, leaves,
    tokens saved, rows that wait for their parent, sizes of the turns of any key below."""

    __slots__ = ("n", "least", "tops", "leaves", "saved", "waiting", "sizes")

    def __init__(self):
        self.n, self.least, self.tops, self.leaves, self.saved, self.waiting, self.sizes = 0, None, 0, 0, 0, [], None

    def add(self, other: Sum) -> None:
        self.n += other.n
        self.tops += other.tops
        self.leaves += other.leaves
        self.saved += other.saved
        self.waiting += other.waiting
        self.sizes = self.sizes if self.sizes is not None else other.sizes
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least


def joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def nodes_of(tree: Tree, first: bytes, last: bytes, width: int = WIDTH) -> tuple[list[list], list[dict]]:
    """Walks the tree once. Gives the final nodes as rows of NODE, with the byte length and side (0 first, 1 last) of
    the parent's path where the parent is on one, and what the nodes on the two paths have beside them."""
    out: list[list] = []
    beside: list[dict[int, tuple[Sum, list[int]]]] = [{}, {}]
    todo = [(tree.root, 0, 0, 0, None)]
    sums: list[Sum] = []  # of the branches that are open, innermost last
    while todo:
        node, start, on_first, on_last, state = todo.pop()
        if state is None:  # on the way down: how far the paths to the first and last key lead
            end = start + len(node.path)
            if on_first == start:
                on_first += common(node.path, first, start)
            if on_last == start:
                on_last += common(node.path, last, start)
            sums.append(Sum())
            todo.append((node, start, on_first, on_last, end))
            for kid in reversed(node.kids.ordered() if node.kids else []):
                todo.append((kid, end, on_first, on_last, None))
            continue
        end, own = state, sums.pop()
        ids: list[int] = []
        if node.ends is not None:
            own.sizes, ids = node.ends
            own.n += len(ids)
            own.least = min(ids) if own.least is None else min(own.least, *ids)
        lowest = start // width * width + width if end else 0
        for at in range(end // width * width, lowest - 1, -width):
            depth, here = at // width, ids if at == end else []
            side = 0 if at <= on_first else 1 if at <= on_last else None
            if side is not None:
                for row in own.waiting:
                    row[8:] = [at, side]
                beside[side][at] = (own, here)
                sizes, own = own.sizes, Sum()
                own.sizes = sizes
                continue
            if not own.tops:
                own.leaves = 1
            own.saved += (own.n - 1) * int(own.sizes[depth - 1]) if depth else 0
            for row in own.waiting:
                row[2] = own.least
            row = [own.least, depth, None, own.n, own.tops, own.leaves, own.saved, hashlib.sha256(joined(here).encode()).hexdigest() if here else NONE, None, None]
            out.append(row)
            own.tops, own.waiting = 1, [row]
        if sums:
            sums[-1].add(own)
    return out, beside


def prefix_keys(key: bytes, width: int = WIDTH) -> list[bytes]:
    """Name of each prefix of whole turns: its SHA-256."""
    h, out = hashlib.sha256(), [hashlib.sha256().digest()]
    for i in range(0, len(key), width):
        h.update(key[i : i + width])
        out.append(h.copy().digest())
    return out


_LONGS = pa.list_(pa.int64())
LOCAL = pa.schema([
    *[(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in NODE.split(", ")], ("parent_key", pa.binary()),
    ("task", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), ("sizes", _LONGS), ("n", _LONGS), ("least", _LONGS), ("tops", _LONGS), ("leaves", _LONGS), ("saved", _LONGS), ("ends", pa.list_(pa.string())),
])
LOCAL_DDL = NODE + ", parent_key binary, task long, place long, key binary, sizes array<long>, n array<long>, least array<long>, tops array<long>, leaves array<long>, saved array<long>, ends array<string>"
MERGED = pa.schema([*[(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in NODE.split(", ")], ("parent_key", pa.binary()), ("node_key", pa.binary())])


def _local(batches):
    task, place = TaskContext.get().partitionId(), 0
    tree, n, held, first, last, sizes_of = Tree(), 0, 0, None, b"", {}

    def done():
        nonlocal place
        rows, beside = nodes_of(tree, first, last)
        keys = [prefix_keys(first), prefix_keys(last)]
        found = [r[:8] + [None if r[8] is None else keys[r[9]][r[8] // WIDTH]] for r in rows]
        for i in range(0, len(found), 5000):
            columns = list(zip(*found[i : i + 5000]))
            yield _batch(LOCAL, dict(zip(LOCAL.names, columns)), len(columns[0]))
        for side, key in enumerate((first, last)):
            if not beside[side]:
                continue
            at = [beside[side].get(d * WIDTH, (Sum(), [])) for d in range(len(key) // WIDTH + 1)]
            row = {"task": task, "place": place, "key": key, "sizes": sizes_of[key], "n": [s.n for s, _ in at], "least": [s.least for s, _ in at], "tops": [s.tops for s, _ in at], "leaves": [s.leaves for s, _ in at], "saved": [s.saved for s, _ in at], "ends": [joined(ids) for _, ids in at]}
            place += 1
            yield _batch(LOCAL, {k: [v] for k, v in row.items()}, 1)

    for batch in batches:
        columns = [batch.column(i) for i in range(3)]
        for key, conv_id, sizes in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2]):
            if first is None:
                first = key
                sizes_of = {key: sizes.values.to_numpy()}
            tree.insert(key, sizes.values.to_numpy(), conv_id)
            last, last_sizes = key, sizes
            n, held = n + 1, held + len(key)
            if n >= BATCH or held >= MAX_BYTES:
                sizes_of[last] = last_sizes.values.to_numpy()
                yield from done()
                tree, n, held, first = Tree(), 0, 0, None
    if n:
        sizes_of[last] = last_sizes.values.to_numpy()
        yield from done()


def _batch(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


class Open:
    """A node on the open path while path rows are added up."""

    __slots__ = ("n", "least", "tops", "leaves", "saved", "size", "sha", "some", "name", "id")

    def __init__(self, name: bytes, size: int, id: bytes):
        self.n, self.least, self.tops, self.leaves, self.saved, self.size, self.sha, self.some, self.name, self.id = 0, None, 0, 0, 0, size, hashlib.sha256(), False, name, id


def _merge(batches):
    """Path rows in key order to the nodes on them."""
    path: list[Open] = []
    rows: list[tuple] = []

    def close() -> None:
        v = path.pop()
        v.saved += (v.n - 1) * v.size
        v.leaves = v.leaves if v.tops else 1
        rows.append((v.least, len(path), None, v.n, v.tops, v.leaves, v.saved, v.sha.hexdigest(), path[-1].name if path else None, v.name))
        if path:
            up = path[-1]
            up.n, up.tops, up.leaves, up.saved = up.n + v.n, up.tops + 1, up.leaves + v.leaves, up.saved + v.saved
            up.least = v.least if up.least is None else min(up.least, v.least)

    def flush():
        columns = list(zip(*rows)) or [()] * len(MERGED)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MERGED)], schema=MERGED)

    for batch in batches:
        for r in batch.to_pylist():
            key = r["key"]
            ids = [b"", *(key[i : i + WIDTH] for i in range(0, len(key), WIDTH))]
            same = 0
            while same < min(len(ids), len(path)) and path[same].id == ids[same]:
                same += 1
            while len(path) > same:
                close()
            names = prefix_keys(key) if same < len(ids) else []
            for d in range(same, len(ids)):
                path.append(Open(names[d], int(r["sizes"][d - 1]) if d else 0, ids[d]))
            for d, v in enumerate(path):
                v.n, v.tops, v.leaves, v.saved = v.n + r["n"][d], v.tops + r["tops"][d], v.leaves + r["leaves"][d], v.saved + r["saved"][d]
                if r["least"][d] is not None:
                    v.least = r["least"][d] if v.least is None else min(v.least, r["least"][d])
                if r["ends"][d]:
                    v.sha.update(f"{',' if v.some else ''}{r['ends'][d]}".encode())
                    v.some = True
        yield flush()
    while path:
        close()
    yield flush()


def turn_id(role: Column, text: Column) -> Column:
    """Hex SHA-256 of a role and a text; the role's length keeps the two apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def sequences(messages: DataFrame) -> DataFrame:
    """conv_id and its turns in order (array of turn, role, id, size) from messages (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_id(role, text).alias("id"), F.octet_length(text).cast("long").alias("size"))
    return messages.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(found: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Sequences rebuilt: the first h turns of the conversation that heads the family, then the own turns after the
    first h, where h is the crc32 of the conversation's decimal id modulo heads."""
    head = found.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = found.withColumns({"h": h, "at": F.col("conv_id") - F.col("conv_id") % family}).join(head, F.col("at") == F.col("base"), "left")
    none = F.slice("turns", 1, 0)
    return own.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def trie(found: DataFrame) -> DataFrame:
    """The nodes (NODE) of the trie of sequences (conv_id, turns)."""
    spark = found.sparkSession
    keyed = stage(found.select(F.unhex(F.array_join(F.transform("turns", lambda t: t.id), "")).alias("key"), "conv_id", F.transform("turns", lambda t: t.size).alias("sizes")), "keys")
    dealt = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    local = stage(dealt.mapInArrow(_local, LOCAL_DDL), "local")
    discard(keyed)
    paths = local.where("key IS NOT NULL").select("task", "place", "key", "sizes", "n", "least", "tops", "leaves", "saved", "ends")
    shared = stage(paths.repartition(1).sortWithinPartitions("task", "place").drop("task", "place").mapInArrow(_merge, NODE + ", parent_key binary, node_key binary"), "shared")
    columns = [c.split()[0] for c in NODE.split(", ")]
    nodes = local.where("key IS NULL")
    below = nodes.where("parent_key IS NOT NULL").select(*columns, "parent_key").unionByName(shared.where("parent_key IS NOT NULL").select(*columns, "parent_key"))
    parents = shared.select("node_key", F.col("conv_id").alias("found"))
    named = below.join(parents, below.parent_key == parents.node_key).withColumn("parent_conv_id", F.col("found")).select(columns)
    return nodes.where("parent_key IS NULL").select(columns).unionByName(named).unionByName(shared.where("parent_key IS NULL").select(columns))
