"""Record tables, pages, snapshots and inventories."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import CONTEXT_SCHEMA


def read_records(spark: SparkSession, path: str, schema: StructType = CONTEXT_SCHEMA) -> DataFrame:
    """A record table with its declared schema; columns that files lack are null."""
    return spark.read.schema(schema).parquet(path)


def write_records(df: DataFrame, path: str, natural_key: list[str] = ("account_id", "uri", "level"), mode: str = "error") -> None:
    """Store a record table by context type, sorted by uri so that path scopes skip row groups; without an id column
    one is added, a hash of the natural key."""
    if "id" not in df.columns:
        df = df.withColumn("id", F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in natural_key)).cast("binary")))
    df.sortWithinPartitions("uri").write.mode(mode).partitionBy("context_type").parquet(path)


def read_pages(spark: SparkSession, path: str, most_bytes: int = 5 << 20, types: tuple[str, ...] = ("text/html", "application/xhtml+xml")) -> DataFrame:
    """Pages (url, html, ...) with `rejected`: why a page isn't used (too_large, content_type, empty), else null."""
    return gated_pages(spark.read.parquet(path), most_bytes, types)


def gated_pages(pages: DataFrame, most_bytes: int = 5 << 20, types: tuple[str, ...] = ("text/html", "application/xhtml+xml")) -> DataFrame:
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    reason = F.when(size == 0, "empty").when(size > most_bytes, "too_large")
    if "content_type" in pages.columns:
        reason = reason.when(~F.substring_index("content_type", ";", 1).isin(*types), "content_type")
    return pages.withColumn("rejected", reason)


PORTABLE = ["uri", "parent_uri", "context_type", "category", "level", "is_leaf", "abstract", "content", "name", "description", "account_id", "created_at", "updated_at", "active_count", "search_tags", "vector"]


def manifest_of(records: DataFrame) -> DataFrame:
    """(path, kind, size, sha256) of the contents of records."""
    return records.select(F.concat_ws("#", "uri", F.col("level").cast("string")).alias("path"), F.col("context_type").alias("kind"), F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))


def content_hash(manifest: DataFrame) -> DataFrame:
    """One row: entries, bytes, and a hash of all entries that doesn't depend on their order: the sum of their hashes,
    so no task ever sees all of them."""
    one = F.sha2(F.concat_ws("|", "path", "kind", F.col("size").cast("string"), "sha256"), 256)
    part = lambda k: F.sum(F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return manifest.agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), F.sha2(F.concat_ws(":", *map(part, range(4))), 256).alias("content_hash"))


def export_snapshot(records: DataFrame, path: str, embedding: str = "") -> DataFrame:
    """Write records (portable columns) and their manifest below a path, `complete` last; its row, with the content
    hash, the embedding's signature and the vectors' dimension, is returned. Mixed dimensions are an error."""
    kept = records.select(*(c for c in PORTABLE if c in records.columns))
    dims = [r[0] for r in kept.where("vector IS NOT NULL").select(F.size("vector")).distinct().limit(2).collect()] if "vector" in kept.columns else []
    if len(dims) > 1:
        raise ValueError("vectors of several dimensions")
    kept.write.parquet(f"{path}/records")
    manifest_of(kept).write.parquet(f"{path}/manifest")
    spark = records.sparkSession
    head = content_hash(spark.read.parquet(f"{path}/manifest")).withColumns({"embedding": F.lit(embedding), "dim": F.lit(dims[0] if dims else None).cast("int")})
    head.coalesce(1).write.parquet(f"{path}/complete")
    return spark.read.parquet(f"{path}/complete")


def import_snapshot(spark: SparkSession, path: str, target: DataFrame, source_root: str, target_root: str, on_conflict: str = "fail", embedding: str = "", vectors: str = "auto") -> DataFrame:
    """Rows of a snapshot under another root, checked against the manifest. Uris that the target has: `fail`, `skip`
    or `overwrite`. Vectors stay if the embedding's signature is the same, else go and `recompute` is set (an error if
    vectors = 'require'). Counters start anew."""
    head = spark.read.parquet(f"{path}/complete").first()
    rows = spark.read.parquet(f"{path}/records")
    if content_hash(manifest_of(rows)).first().content_hash != head.content_hash:
        raise ValueError("the records don't agree with the manifest")
    same = head.embedding == embedding
    if vectors == "require" and not same:
        raise ValueError("the snapshot was embedded otherwise")
    moved = rows.withColumns({"uri": F.concat(F.lit(target_root.rstrip("/")), F.substr("uri", F.lit(len(source_root.rstrip("/")) + 1))), "active_count": F.lit(0).cast("long")})
    if "vector" in rows.columns:
        moved = moved.withColumns({"recompute": F.lit(not same), "vector": F.col("vector") if same else F.lit(None).cast(rows.schema["vector"].dataType)})
    there = target.select("uri", "level").distinct()
    if on_conflict == "fail" and not moved.join(there, ["uri", "level"], "left_semi").isEmpty():
        raise ValueError("uris are there already")
    if on_conflict not in ("fail", "skip", "overwrite"):
        raise ValueError(f"unknown conflict policy: {on_conflict}")
    return moved.join(there, ["uri", "level"], "left_anti") if on_conflict == "skip" else moved


def inventory(**tables: DataFrame) -> DataFrame:
    """A typed row for each row of the tables (kind, JSON), and for each table a marker row with their number, so
    that a partial scan can't pass for a complete one."""
    out = None
    for kind, df in tables.items():
        body: Column = F.to_json(F.struct(*df.columns))
        rows = df.select(F.lit(kind).alias("kind"), body.alias("body"), F.lit(False).alias("marker"))
        marker = df.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("rows"))).alias("body")).select(F.lit(kind).alias("kind"), "body", F.lit(True).alias("marker"))
        out = rows.unionByName(marker) if out is None else out.unionByName(rows).unionByName(marker)
    return out


def inventory_export(path: str, **tables: DataFrame) -> str:
    """Write the inventory as JSON lines to a new folder below path; Spark's committer makes it visible at the end."""
    to = f"{path}/inventory-{uuid.uuid4().hex}"
    inventory(**tables).write.json(to)
    return to
