"""Groups of similar drafts (J13): an exact similarity self-join that prunes by angles, and its components.

Every vector belongs to its nearest pivot's cell. By the triangle inequality two vectors within an angle t of each
other lie in cells whose pivots' angles to either differ by 2t at most, and no farther than the cell's radius and t from its
pivot; only into such cells is a vector sent as well. Within a cell, blocks of its own vectors are held one at a time
and all that may be near stream past, so a cell with a third of all vectors is many tasks. Vectors within t / 2 of their
pivot are near each other for certain and need no comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from ..functions import vectors as V
from ..staging import Staging
from .retrieve import TILE, _matrix

#: Distinct vectors of a block, pivots at most, and what rounding may hide of an angle.
DRAFT_BLOCK, MOST_PIVOTS, SLACK = 2048, 1024, 1e-6


def _star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Components (node, component: least node) of edges (a, b): neighbours' least labels are followed until nothing
    changes. Each round is written to the shared folder and the one before it deleted."""
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[Staging, DataFrame]:
        own = Staging(spark)
        return own, own(df)

    held, now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    sign = None
    while (new := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != sign:
        sign, before = new, held
        held, now = written(_star(now))
        before.__exit__()
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _tied(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie the linked ids of both sides (mask: which pairs are) to the least id of their component, so a
    block sends on one link an id at most. Each row and column is visited once."""
    rows, cols, a, b = mask.any(1), mask.any(0), [], []
    for start in range(len(left)):
        if not rows[start]:
            continue
        i, part = np.array([start]), []
        rows[start] = False
        while len(i):
            part.append(left[i])
            j = np.flatnonzero(mask[i].any(0) & cols)
            cols[j] = False
            part.append(right[j])
            i = np.flatnonzero(mask[:, j].any(1) & rows)
            rows[i] = False
        part = np.unique(np.concatenate(part))
        a.append(part[1:])
        b.append(np.repeat(part[:1], len(part) - 1))
    return tuple(np.concatenate(x) if x else left[:0] for x in (a, b))


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1, 1))


def filed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors (id, vector) with `own`, the nearest pivot, and `far`, the angle to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for whole in batches:
            step = max(1, TILE // len(shared.value))
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                angles = _angles(_matrix(b.column("vector"), "cosine"), shared.value)
                own = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], names=["id", "vector", "own", "far"])

    return vectors.select("id", F.col("vector").cast("array<double>")).mapInArrow(run, StructType([vectors.schema["id"], StructField("vector", ArrayType(DoubleType())), StructField("own", IntegerType()), StructField("far", DoubleType())]))


def _copies(b: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, block: np.ndarray, probe: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows `at` of b with where they go, `most` at a time."""
    for lo in range(0, len(at), most):
        part = slice(lo, lo + most)
        own = pa.array(at[part])
        yield pa.RecordBatch.from_arrays([pa.array(cell[part].astype(np.int32)), pa.array(block[part].astype(np.int32)), pa.array(probe[part]), b.column("id").take(own), b.column("vector").take(own)], names=["cell", "block", "probe", "id", "vector"])


def dealt(rows: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """(cell, block, probe, id, vector): each row of filed() as a member of a block of its cell, and as one that streams
    past (probe) the blocks before its own and the blocks of cells of smaller number that it may have neighbours in."""
    theta = math.acos(min(1.0, threshold)) + SLACK
    cells = {r.own: (r.n, r.far) for r in rows.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # MOST_PIVOTS at most
    radius, blocks = np.full(len(pivots), -np.inf), np.zeros(len(pivots), int)
    for c, (n, far) in cells.items():
        radius[c], blocks[c] = far, -(-n // DRAFT_BLOCK)
    shared = rows.sparkSession.sparkContext.broadcast((pivots, radius, blocks))
    hashed = rows.withColumn("h", F.xxhash64("id"))

    def run(batches):
        pivots, radius, blocks = shared.value
        for whole in batches:
            step = max(1, TILE // max(len(pivots), blocks.sum()))  # a row may go to each block
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                own, far = b.column("own").to_numpy(), b.column("far").to_numpy()
                angles = _angles(_matrix(b.column("vector"), "cosine"), pivots)
                near = (angles <= np.minimum(far[:, None] + 2 * theta, radius + theta)) & (np.arange(len(pivots)) < own[:, None])
                mine = b.column("h").to_numpy() % blocks[own]
                at, cell, block, probe = [np.arange(len(own))], [own], [mine], [np.zeros(len(own), bool)]
                i, c = np.nonzero(near)
                for rows_of, cells_of, n in ((np.arange(len(own)), own, mine), (i, c, blocks[c])):
                    at.append(np.repeat(rows_of, n))
                    cell.append(np.repeat(cells_of, n))
                    block.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    probe.append(np.ones(n.sum(), bool))
                yield from _copies(b, *(np.concatenate(x) for x in (at, cell, block, probe)), max(1, TILE // pivots.shape[1]))

    return hashed.mapInArrow(run, StructType([StructField("cell", IntegerType()), StructField("block", IntegerType()), StructField("probe", BooleanType()), rows.schema["id"], rows.schema["vector"]]))


def pairs_compared(parts: DataFrame) -> int:
    """Pairs that the result of dealt() compares."""
    by = parts.groupBy("cell", "block").agg(F.count_if(~F.col("probe")).alias("m"), F.count_if("probe").alias("p"))
    return by.agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2 + F.col("m") * F.col("p")), F.lit(0))).first()[0]


def near_links(vectors: DataFrame, threshold: float, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """Links (a, b) between distinct vectors (id, vector) that give the components of all pairs with a cosine at or
    above the threshold."""
    spark = vectors.sparkSession
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if size.n and size.a != size.b:
        raise ValueError("drafts have vectors of several dimensions")
    m = max(1, min(most_pivots, math.isqrt(size.n)))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(m).select(F.col("vector").cast("array<double>").alias("vector")).toArrow()
    pivots = _matrix(chosen["vector"], "cosine") if len(chosen) else np.zeros((1, size.a or 1))
    id_field = vectors.schema["id"]
    out = StructType([StructField("a", id_field.dataType), StructField("b", id_field.dataType)])

    def run(batches):
        key, ids, block = None, [], []
        built = None  # the block's ids and matrix, once the first probe comes

        def build():
            own, mat = pa.concat_arrays(ids).to_numpy(zero_copy_only=False), np.concatenate(block)
            for i in range(0, len(own), DRAFT_BLOCK):
                mask = mat[i : i + DRAFT_BLOCK] @ mat.T >= threshold
                mask[np.arange(mask.shape[0]), np.arange(i, i + mask.shape[0])] = True
                yield from links(mask, own[i : i + DRAFT_BLOCK], own)
            return own, mat

        def links(mask, left, right):
            a, b = _tied(mask, left, right)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("id").type
            c, k, p = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "block", "probe"))
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(k) != 0) | (np.diff(p.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(c)]):
                if (c[lo], k[lo]) != key:
                    if key is not None and built is None and block:
                        yield from build()
                    key, ids, block, built = (c[lo], k[lo]), [], [], None
                part = batch.slice(lo, hi - lo)
                m = _matrix(part.column("vector"), "cosine")
                if not p[lo]:
                    ids.append(part.column("id"))
                    block.append(m)
                elif block:
                    if built is None:
                        built = yield from build()
                    own = part.column("id").to_numpy(zero_copy_only=False)
                    step = max(1, TILE // len(built[0]))
                    for i in range(0, len(own), step):
                        yield from links(m[i : i + step] @ built[1].T >= threshold, own[i : i + step], built[0])
        if key is not None and built is None and block:
            yield from build()

    with Staging(spark) as staged:
        rows = staged(filed(vectors, pivots))
        half = math.acos(min(1.0, threshold)) / 2 - SLACK
        core = rows.where(F.col("far") <= half)
        least = core.groupBy("own").agg(F.min("id").alias("b"))
        certain = core.join(F.broadcast(least), "own").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b")
        parts = dealt(rows, pivots, threshold).repartition("cell", "block").sortWithinPartitions("cell", "block", "probe")
        return staged(parts.mapInArrow(run, out).unionByName(certain.select("a", "b")), keep=True)


def similar_drafts(drafts: DataFrame, threshold: float) -> DataFrame:
    """(id, component) of drafts (id, vector): groups to handle together, components of all pairs with a cosine at
    or above the threshold (1 at most); equal vectors are one node. A draft without such a pair, a vector or a length
    is a group of its own."""
    norm = V.l2_norm(F.col("vector"))
    nodes = drafts.where((norm > 0) & ~F.isnan(norm)).groupBy("vector").agg(F.min("id").alias("node"))
    found = connected(near_links(nodes.select(F.col("node").alias("id"), "vector"), threshold)).groupBy("node").agg(F.min("component").alias("component"))
    names = nodes.join(found, "node", "left").select("vector", F.coalesce("component", "node").alias("component"))
    return drafts.join(names, "vector", "left").select("id", F.coalesce("component", "id").alias("component"))
