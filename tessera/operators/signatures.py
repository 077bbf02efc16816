"""Approximate nearest neighbours by a stored index of hyperplane signatures.

Each of n_tables tables cuts unit vectors by n_bits random hyperplanes, placed at the medians of a sample so that
buckets are of about equal size; the sides of a vector are its signature, a bucket number. The index holds every row
once a table, as files by `cell` (table and leading bits of the signature) sorted by signature. A query looks into the
buckets of each table that it is nearest to by the margins of the planes crossed; how many is chosen on the sample for a
recall. So only cells with such buckets are read, and only their buckets scored, exactly.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from ..functions import vectors as V
from ..staging import Staging
from .retrieve import MOST_BROADCAST, TRIALS, _best_of, _matrix, _named, _sample, knn, ranked

#: Leading bits of a signature that name a cell, and bits of a signature at most.
CELL_BITS, MOST_BITS = 4, 12
#: Depths k, 2k, 4k and so on for which probes are chosen: filtered searches look deeper, the more the filter leaves out.
DEPTHS = 6
#: Hits that a task holds before it keeps the best only.
HELD = 200_000


@dataclass
class Planes:
    """Hyperplanes of all tables, as (n_tables * n_bits, dim) normals and their cuts."""

    n_tables: int
    n_bits: int
    normals: np.ndarray
    cuts: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, n_tables: int, n_bits: int, seed: int) -> Planes:
        normals = np.random.default_rng(seed).normal(size=(n_tables * n_bits, sample.shape[1]))
        return cls(n_tables, n_bits, normals, np.median(sample @ normals.T, axis=0) if len(sample) else np.zeros(len(normals)))

    def margins(self, m: np.ndarray) -> np.ndarray:
        """(rows, tables, bits): signed distances of unit vectors to the planes."""
        return (m @ self.normals.T - self.cuts).reshape(len(m), self.n_tables, self.n_bits)

    def signatures(self, margins: np.ndarray) -> np.ndarray:
        """(rows, tables): bucket numbers."""
        return (margins >= 0) @ (1 << np.arange(self.n_bits)[::-1])

    def costs(self, margins: np.ndarray) -> np.ndarray:
        """(rows, tables, buckets): how far the bucket that differs from the own one by these bits is."""
        flips = np.arange(1 << self.n_bits)[:, None] >> np.arange(self.n_bits)[::-1] & 1
        return np.square(margins) @ flips.T

    def probes_for(self, sample: np.ndarray, k: int, recall: float) -> int:
        """Buckets of each table that find the share `recall` of the k nearest other sample rows of TRIALS rows."""
        if len(sample) < 2:
            return 1 << self.n_bits
        asked = np.arange(min(TRIALS, len(sample)))
        scores = sample[asked] @ sample.T
        scores[asked, asked] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        of = self.signatures(self.margins(sample))
        needed = np.empty(near.shape, int)
        for i in asked:
            costs = self.costs(self.margins(sample[i : i + 1]))[0]
            place = np.argsort(np.argsort(costs, axis=1, kind="stable"), axis=1)
            flips = of[near[i]] ^ of[i]  # (neighbours, tables)
            needed[i] = place[np.arange(self.n_tables), flips].min(1)
        return int(np.sort(needed.ravel())[max(0, int(np.ceil(recall * needed.size)) - 1)]) + 1

    def nearest(self, m: np.ndarray, probes: int) -> np.ndarray:
        """(rows, tables, probes): the buckets to look into."""
        margins = self.margins(m)
        own, out = self.signatures(margins), []
        for i in range(len(m)):
            flips = np.argsort(self.costs(margins[i : i + 1])[0], axis=1, kind="stable")[:, :probes]
            out.append(own[i][:, None] ^ flips)
        return np.array(out).reshape(len(m), self.n_tables, -1)

    def cells(self, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        bits = min(CELL_BITS, self.n_bits)
        return (table << bits) + (bucket >> (self.n_bits - bits))


def build_index(corpus: DataFrame, path: str, n_tables: int = 8, n_bits: int = 8, keep: tuple[str, ...] = (), k: int = 10, recall: float = 0.95, seed: int = 7) -> None:
    """Write the index of corpus (id, vector and the columns of keep, by which searches may filter). Rows without a
    vector of some length are left out. Planes are fitted on the sample; every row is indexed."""
    if not 1 <= n_bits <= MOST_BITS or n_tables < 1:
        raise ValueError(f"1 to {MOST_BITS} bits and a table at least are needed")
    spark, sample = corpus.sparkSession, _sample(corpus)
    planes = Planes.fitted(sample, n_tables, n_bits, seed)
    rows = corpus.where(F.col("vector").isNotNull() & (V.l2_norm(F.col("vector")) > 0)).select("id", F.col("vector").cast(ArrayType(FloatType())).alias("vector"), *keep)
    shared = spark.sparkContext.broadcast(planes)

    def run(batches):
        for b in batches:
            if b.num_rows:
                p = shared.value
                of = p.signatures(p.margins(_matrix(b.column("vector"), "cosine"))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, of.size + 1, p.n_tables, dtype=np.int32)), pa.array(of.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "of"])

    signed = rows.mapInArrow(run, StructType([*rows.schema, StructField("of", ArrayType(IntegerType()))])).select(*rows.columns, F.posexplode("of").alias("tab", "bucket"))
    bits = min(CELL_BITS, n_bits)
    cell = F.shiftleft("tab", bits) + F.shiftright("bucket", n_bits - bits)
    dealt = signed.withColumn("cell", cell).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "bucket", "id").sortWithinPartitions("cell", "bucket", "id")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    about = json.dumps({"n_tables": n_tables, "n_bits": n_bits, "dim": int(sample.shape[1]), "probes": {k << i: planes.probes_for(sample, k << i, recall) for i in range(DEPTHS)}})
    meta = pa.table({"about": [about], "normals": [planes.normals.astype("<f8").tobytes()], "cuts": [planes.cuts.astype("<f8").tobytes()]})
    spark.createDataFrame(meta).coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, Planes, dict[int, int]]:
    """Rows of a stored index, its planes, and the probes chosen when it was built, by depth."""
    r = spark.read.parquet(f"{path}/planes").first()
    about = json.loads(r.about)
    planes = Planes(about["n_tables"], about["n_bits"], np.frombuffer(bytes(r.normals), "<f8").reshape(-1, about["dim"]), np.frombuffer(bytes(r.cuts), "<f8"))
    return spark.read.parquet(f"{path}/rows"), planes, {int(d): n for d, n in about["probes"].items()}


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, where: Column | None = None, probes: int | None = None, complete: bool = True) -> DataFrame:
    """Approximate cosine top k of queries (qid, vector) by a stored index: qid, id, score, rank. The filter (on
    columns kept in the index) holds exactly, before ranking; the share of rows that pass it is counted, and as many more
    buckets are looked into (all of them, for filters that leave less than the deepest search chosen for). With `complete`, queries that found fewer than k rows
    that pass are answered by an exact search of one table, which has every row. Queries are broadcast, in as many
    groups as needed."""
    rows, planes, chosen = open_index(spark, path)
    usable = queries.where(F.col("vector").isNotNull() & (V.l2_norm(F.col("vector")) > 0)).select("qid", "vector")
    passing, depth = rows, k
    if where is not None:
        passing = rows.where(where)
        left = rows.where("tab = 0").agg(F.count_if(where), F.count(F.lit(1))).first()
        depth = k * left[1] / max(1, left[0])
    chosen = next((n for d, n in sorted(chosen.items()) if d >= depth), 1 << planes.n_bits)
    n = max(1, -(-usable.count() * max(1, planes.normals.shape[1]) // MOST_BROADCAST))
    qid_type, out = queries.schema["qid"].dataType.simpleString(), None
    for i in range(n):
        asked = (usable.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) if n > 1 else usable).toArrow()
        found = _scan(passing, asked, planes, min(probes or chosen, 1 << planes.n_bits), k, qid_type)
        out = found if out is None else out.unionByName(found)
    once = ranked(out.groupBy("qid", "id").agg(F.max("score").alias("score")), k)
    if not complete:
        return once
    with Staging(spark) as staged:
        first = staged(once, keep=True)
    few = usable.join(first.groupBy("qid").count().where(F.col("count") >= k), "qid", "left_anti")
    if few.isEmpty():
        return first
    rest = knn(passing.where("tab = 0").select("id", "vector"), few, k)
    return first.join(few.select("qid"), "qid", "left_anti").unionByName(rest.select(first.columns))


def _scan(rows: DataFrame, asked: pa.Table, planes: Planes, probes: int, k: int, qid_type: str) -> DataFrame:
    if not len(asked):
        return rows.select(F.lit(None).cast(qid_type).alias("qid"), "id", F.lit(0.0).alias("score")).limit(0)
    vectors = _matrix(asked["vector"], "cosine")
    buckets = planes.nearest(vectors, probes)
    q, table = (x.ravel() for x in np.indices(buckets.shape)[:2])
    at = buckets.ravel()
    key = table.astype(np.int64) << planes.n_bits | at
    order = np.argsort(key, kind="stable")
    keys, start = np.unique(key[order], return_index=True)
    wanted = sorted(set(planes.cells(table, at).tolist()))
    shared = rows.sparkSession.sparkContext.broadcast((asked["qid"], vectors, keys, np.append(start, len(order)), q[order], planes.n_bits))

    def scan(batches):
        qids, vectors, keys, start, of, n_bits = shared.value

        def tables():
            for b in batches:
                key = b.column("tab").to_numpy().astype(np.int64) << n_bits | b.column("bucket").to_numpy()
                ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key)) if len(key) else []
                a = 0
                for z in ends:
                    i = np.searchsorted(keys, key[a])
                    if i < len(keys) and keys[i] == key[a]:
                        here = of[start[i] : start[i + 1]]
                        scores = vectors[here] @ _matrix(b.column("vector").slice(a, z - a), "cosine").T
                        r, c = np.nonzero(scores >= np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, [max(0, scores.shape[1] - k)]])
                        yield pa.table({"q": pa.array(here[r]), "id": b.column("id").slice(a, z - a).take(pa.array(c)), "score": pa.array(scores[r, c])})
                    a = z

        held, n = [], 0
        for t in tables():
            held.append(t)
            n += len(t)
            if n > HELD:
                held = [_best_once(held, k)]
                n = 0
        yield from _named(_best_once(held, k) if held else None, qids)

    return rows.where(F.col("cell").isin(wanted)).select("id", "vector", "tab", "bucket").mapInArrow(scan, f"qid {qid_type}, id {rows.schema['id'].dataType.simpleString()}, score double")


def _best_once(tables: list[pa.Table], k: int) -> pa.Table:
    """The best k rows of each query, each (q, id) once: a row may be found by several tables."""
    t = pa.concat_tables(tables).group_by(["q", "id"]).aggregate([("score", "max")])
    return _best_of(iter([pa.table({"q": t["q"], "id": t["id"], "score": t["score_max"]})]), k)
