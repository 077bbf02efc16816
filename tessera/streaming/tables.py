"""Tables that streams write, each row once over crashes and restarts: appends (T8), late rows (T12), records.

A micro-batch is named by its query's id and its number, which a restart repeats. What a batch writes goes to a folder
of that name, then a small confirmation; readers see confirmed batches only. So a batch that ran partly is written
anew, and one that was confirmed is left alone.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..operators.maintain import apply_changes
from ..operators.sessions import extraction_batches, turns
from ..staging import Staging

#: Blocks that rows are dealt to by all keys but the last, bits of a Bloom filter for each key, and hashes.
BLOCKS, BITS, HASHES = 64, 12, 6


class Log:
    """Small files of one value each below `path`, on whatever file system it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def read(self, name: str) -> dict | None:
        where = self.of(f"{self.path}/{name}")
        if not self.fs.exists(where):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value)

    def write(self, name: str, value: dict) -> None:
        """First under another name, then renamed, so none is half written."""
        temporary, where = self.of(f"{self.path}/.{name}"), self.of(f"{self.path}/{name}")
        self.fs.mkdirs(self.of(self.path))
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self.fs.delete(where, False)
        if not self.fs.rename(temporary, where):
            raise OSError(f"{self.path}/{name} can't be written")

    def names(self) -> list[str]:
        where = self.of(self.path)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where) if not x.getPath().getName().startswith(".")) if self.fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.of(f"{self.path}/{name}"))


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that a checkpoint belongs to; it stays over restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first().value)["id"]


def _bloom(hashes: np.ndarray) -> bytes:
    size = 1 << max(6, (BITS * len(hashes)).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[_places(hashes, size)] = 1
    return np.packbits(bits).tobytes()


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    return np.stack([((h + step * np.uint64(i)) % np.uint64(size)).astype(np.int64) for i in range(HASHES)])


class Appends:
    """T8's table: `path/batch=<name>/block=<n>` holds rows, `path/_log` intents, confirmations and Bloom filters of the
    keys. A new batch reads the filters of its blocks, and rows of those batches and blocks only that may have a key."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path, keys
        self.intents, self.confirmed = Log(spark, f"{path}/_log/intents"), Log(spark, f"{path}/_log/confirmed")

    def hashed(self, df: DataFrame) -> DataFrame:
        heads = self.keys[:-1] or self.keys
        return df.withColumns({"block": F.pmod(F.xxhash64(*heads), F.lit(BLOCKS)).cast("int"), "_h": F.xxhash64(*self.keys)})

    def candidates(self, new: DataFrame) -> list[tuple[int, str]]:
        """(block, batch) of confirmed batches whose filter has a key of new."""
        names = self.confirmed.names()
        blocks = sorted(r.block for r in new.select("block").distinct().collect())  # BLOCKS at most
        if not names or not blocks:
            return []
        filters = self.spark.read.parquet(*(f"{self.path}/_log/filters/{n}" for n in names)).where(F.col("block").isin(blocks))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            h, out = left["_h"].to_numpy(), []
            for batch, bits in zip(right["batch"].to_pylist(), right["bits"].to_pylist()):
                own = np.unpackbits(np.frombuffer(bits, np.uint8))
                if own[_places(h, len(own))].all(0).any():
                    out.append(batch)
            block = right["block"][0].as_py() if len(right) else 0
            return pa.table({"block": pa.array([block] * len(out), pa.int32()), "batch": pa.array(out, pa.string())})

        hit = new.select("block", "_h").groupBy("block").cogroup(filters.groupBy("block")).applyInArrow(run, "block int, batch string")
        return [(r.block, r.batch) for r in hit.collect()]

    def append(self, df: DataFrame, name: str) -> int:
        """Adds the rows of df whose keys aren't there yet, as batch `name`; gives how many it has."""
        if done := self.confirmed.read(name):
            return done["rows"]
        where = f"{self.path}/batch={name}"
        intent = self.intents.read(name)
        landed = intent and Log(self.spark, where).exists("_SUCCESS") and self.spark.read.parquet(where).count()
        if not intent or landed != intent["rows"]:  # it didn't land, or in part
            with Staging(self.spark) as staged:
                new = staged(self.hashed(df.dropDuplicates([*self.keys])))
                if there := self.candidates(new):  # one join for all of them: each would hold memory of its own in the same task
                    old = self.spark.read.schema(df.select(*self.keys).schema).parquet(*(f"{self.path}/batch={batch}/block={block}" for block, batch in there))
                    same = functools.reduce(operator.and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys))
                    new = new.alias("a").join(old.alias("b"), same, "left_anti")
                new = staged(new)
                self.intents.write(name, {"rows": new.count()})
                new.drop("_h").write.mode("overwrite").partitionBy("block").parquet(where)
        found = self.read_batch(df.schema, name)
        rows = self.intents.read(name)["rows"]
        filters = self.hashed(found).groupBy("block").applyInArrow(_filter_rows(name), "block int, batch string, bits binary")
        filters.write.mode("overwrite").parquet(f"{self.path}/_log/filters/{name}")
        self.confirm(name, rows)
        return rows

    def confirm(self, name: str, rows: int) -> None:
        self.confirmed.write(name, {"rows": rows})

    def read_batch(self, schema: StructType, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/batch={name}").select(*schema.names)

    def read(self, schema: StructType) -> DataFrame:
        """All rows of confirmed batches, with their batch."""
        names = self.confirmed.names()
        if not names:
            return self.spark.createDataFrame([], StructType([*schema, StructField("batch", StringType())]))
        rows = self.spark.read.schema(StructType([*schema, StructField("batch", StringType())])).option("basePath", self.path).parquet(*(f"{self.path}/batch={n}" for n in names))
        return rows.select(*schema.names, "batch")


def _filter_rows(name: str):
    def run(t: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "batch": [name], "bits": pa.array([_bloom(t["_h"].to_numpy())], pa.binary())})

    return run


def dedup_append(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("harness", "session_id", "position")) -> DataStreamWriter:
    """Append a stream of turns to a table, each key once (of a batch's rows with the same key any one), whatever
    crashes or is read again, by another checkpoint too. Read it by Appends(...).read."""

    def write(df: DataFrame, batch_id: int) -> None:
        Appends(df.sparkSession, path, keys).append(df, f"{query_id(df.sparkSession, checkpoint)}-{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def late_rows(df: DataFrame, watermark: Column, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """T12 on a table: rows in time, and rows older than the watermark."""
    late = F.coalesce(F.col(ts) < watermark, F.lit(False))
    return df.where(~late), df.where(late)


def split_late(stream: DataFrame, path: str, checkpoint: str, on_time: Callable[[DataFrame, int], None], delay: str = "10 minutes", ts: str = "ts") -> DataStreamWriter:
    """Before anything is aggregated, rows of a stream older than the watermark - the newest time of all batches
    before, less the delay - go to the table `path/late` with the batch's name, their number to `path/counts`; on_time
    gets the others. Rows without a time are in time. The newest time is kept with the counts, so a restart goes on with it."""

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        of, counts = query_id(spark, checkpoint), Log(spark, f"{path}/counts")
        before = (counts.read(f"{of}-{batch_id - 1}") or {}) if batch_id else {}
        newest = before.get("newest")
        mark = F.lit(None).cast(TimestampType()) if newest is None else F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {delay}")
        with Staging(spark) as staged:
            rows = staged(df)
            good, late = late_rows(rows, mark, ts)
            late.withColumn("batch", F.lit(f"{of}-{batch_id}")).write.mode("overwrite").parquet(f"{path}/late/batch_dir={of}-{batch_id}")
            on_time(good, batch_id)
            seen = rows.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
            times = [x for x in (newest, seen.m) if x is not None]
            counts.write(f"{of}-{batch_id}", {"rows": seen.n, "late": late.count(), "newest": max(times) if times else None})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, late) of batches that split_late has finished."""
    log = Log(spark, f"{path}/counts")
    found = [(n, r["rows"], r["late"]) for n in log.names() for r in [log.read(n)]]
    return spark.createDataFrame(found, "batch string, rows long, late long")


#: Columns of the records that ingestion makes.
RECORD = StructType([StructField("id", StringType()), StructField("session_id", StringType()), StructField("first_pos", LongType()), StructField("messages", LongType()), StructField("tokens", LongType()), StructField("content", StringType())])
MESSAGE = "session_id string, pos long, role string, text string, ts timestamp, tokens long"


class Ingest:
    """T13's tables: pending messages and records, each in blocks of sessions and versions by batch. A version's manifest
    names the folder of every block, so a batch writes the blocks it touches only, and reads the rest as they are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, Log(spark, f"{path}/_log")

    def manifest(self, before: int | None = None) -> dict:
        names = [n for n in self.log.names() if before is None or int(n) < before]
        return (self.log.read(names[-1]) or {}) if names else {"pending": {}, "records": {}}

    def table(self, kind: str, manifest: dict, schema, blocks: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(manifest[kind].items()) if blocks is None or int(b) in blocks]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        return self.table("records", self.manifest(), RECORD)

    def pending(self) -> DataFrame:
        return self.table("pending", self.manifest(), MESSAGE)

    def run(self, df: DataFrame, batch_id: int, tokens: int, messages: int, idle_seconds: int, keep: int) -> None:
        name = f"{batch_id:012}"
        if self.log.read(name):
            return
        block = F.pmod(F.xxhash64("session_id"), F.lit(BLOCKS)).cast("int")
        old = self.manifest(batch_id)
        with Staging(self.spark) as staged:
            new = staged(df.withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long")).select(*(c.split()[0] for c in MESSAGE.split(", "))))
            now = new.agg(F.max("ts")).first()[0]
            newest = max((x for x in (now.timestamp() if now else None, old.get("newest")) if x is not None), default=None)
            due = [int(b) for b, t in old.get("oldest", {}).items() if newest is not None and t <= newest - idle_seconds]
            touched = sorted({r[0] for r in new.select(block).distinct().collect()} | set(due))
            held = self.table("pending", old, MESSAGE, touched).unionByName(new).dropDuplicates(["session_id", "pos"])
            # a message that a record has already was committed before
            done = self.table("records", old, RECORD, touched).select(F.col("session_id").alias("s"), "first_pos", (F.col("first_pos") + F.col("messages") - 1).alias("last_pos"))
            upto = done.groupBy("s").agg(F.max("last_pos").alias("upto"))
            held = staged(held.join(upto, F.col("session_id") == F.col("s"), "left").where("upto IS NULL OR pos > upto").drop("s", "upto"))
            by = held.groupBy("session_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.max("pos").alias("end"))
            idle = F.unix_micros("last") <= F.lit(None if newest is None else int((newest - idle_seconds) * 1e6)).cast("long")
            full = (F.col("t") >= tokens) | (F.col("n") >= messages)
            # what stays by `keep` stays when a limit was reached; an idle session goes whole
            going = by.where(full | F.coalesce(idle, F.lit(False))).select("session_id", F.when(F.coalesce(idle, F.lit(False)), F.col("end")).otherwise(F.col("end") - keep).alias("upto"))
            marked = staged(held.join(going, "session_id", "left").withColumn("goes", F.coalesce(F.col("pos") <= F.col("upto"), F.lit(False))).drop("upto"))
            went = marked.where("goes")
            packed = extraction_batches(turns(went.select(F.col("session_id").alias("conv_id"), "pos", "role", F.lit(False).alias("is_tool"), "tokens")), tokens, messages)
            spans = packed.groupBy("session", "batch").agg(F.min("pos").alias("first_pos"), F.max(F.col("pos") + F.col("messages") - 1).alias("last_pos"))
            text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n")
            inside = went.join(spans, (F.col("session_id") == F.col("session")) & F.col("pos").between(F.col("first_pos"), F.col("last_pos")))
            made = inside.groupBy("session_id", "first_pos").agg(F.count(F.lit(1)).alias("messages"), F.sum("tokens").alias("tokens"), text.alias("content"))
            changes = made.select(F.concat_ws("#", "session_id", "first_pos").alias("id"), F.lit("upsert").alias("op"), F.lit(batch_id).cast("long").alias("seq"), F.array().cast("array<string>").alias("set"), "session_id", "first_pos", "messages", "tokens", "content")
            records = apply_changes(self.table("records", old, RECORD, touched), changes)
            where = f"{self.path}/v{name}"
            manifest = {"pending": dict(old["pending"]), "records": dict(old["records"]), "oldest": {b: t for b, t in old.get("oldest", {}).items() if int(b) not in touched}, "newest": newest}
            for kind, rows in (("records", records), ("pending", marked.where("NOT goes").drop("goes"))):
                rows.withColumn("block", block).repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{where}/{kind}")
                there = {int(n.split("=")[1]) for n in Log(self.spark, f"{where}/{kind}").names() if n.startswith("block=")}
                for b in touched:
                    manifest[kind].pop(str(b), None)
                    if b in there:
                        manifest[kind][str(b)] = f"{where}/{kind}/block={b}"
            waiting = marked.where("NOT goes").groupBy("session_id").agg(F.max("ts").alias("last")).groupBy(block.alias("b")).agg(F.min("last").alias("t")).collect()
            manifest["oldest"] |= {str(r.b): r.t.timestamp() for r in waiting if r.t is not None}
        self.log.write(name, manifest)


def stream_ingest(turn_stream: DataFrame, path: str, checkpoint: str, tokens: int = 150_000, messages: int = 100, idle_seconds: int = 86_400, keep: int = 0) -> DataStreamWriter:
    """A stream of turns (session_id, pos, role, text, ts, tokens) becomes records. In each micro-batch messages join
    those that wait; sessions that reach a limit of tokens or messages (all but the last `keep` messages), or have been
    idle by the newest time seen, are packed by W7 and applied by S13 to the version that the batch names. Read the
    tables by Ingest(...).records() and .pending()."""

    def write(df: DataFrame, batch_id: int) -> None:
        Ingest(df.sparkSession, path).run(df, batch_id, tokens, messages, idle_seconds, keep)

    return turn_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
