"""Table maintenance (S12-S14, G5, T9): lookups, change batches, deletes, reindex plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fetch_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of the keys, and the keys that no row has."""
    wanted = ids.select(key).distinct()
    return df.join(wanted, key, "left_semi"), wanted.join(df.select(key), key, "left_anti")


def last_changes(changes: DataFrame, key: str = "id") -> DataFrame:
    """Changes of a batch (op, seq, key, `set`: names of the columns given, and columns) with one row a key: values
    given later win; a delete or an upsert forgets what came before it."""
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    whole = F.max(F.when(F.col("op") != "update", F.col("seq"))).over(Window.partitionBy(key))
    live = changes.withColumn("_whole", whole).where("_whole IS NULL OR seq >= _whole").withColumn("_rn", F.row_number().over(w))
    values = [c for c in changes.columns if c not in (key, "op", "seq", "set")]
    given = [F.max(F.when(F.array_contains("set", c) | (F.col("op") == "upsert"), F.struct("seq", F.col(c).alias("v")))).alias(c) for c in values]
    by = live.groupBy(key).agg(F.min_by("op", "seq").alias("op"), F.array_distinct(F.flatten(F.collect_list("set"))).alias("set"), *given)
    return by.select(key, "op", "set", *(F.col(f"{c}.v").alias(c) for c in values))


def apply_changes(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table after a batch of changes: `upsert` replaces a row, `update` keeps what it doesn't set and overwrites
    what it does, null and empty values too, `delete` removes. If an update's key isn't there, the whole batch is an
    error. The last change of a key wins. Written as a new version; the table itself is never changed."""
    last = last_changes(changes, key)
    lost = last.where("op = 'update'").join(df.select(key), key, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"updates of keys that aren't there: {[r[key] for r in lost]}")
    values = [c for c in df.columns if c != key]
    new = last.select(key, F.col("op").alias("_op"), F.col("set").alias("_set"), *((F.col(c) if c in last.columns else F.lit(None).cast(df.schema[c].dataType)).alias(f"_{c}_") for c in values))
    both = df.withColumn("_old", F.lit(True)).join(new, key, "full_outer").where("_op IS NULL OR _op <> 'delete'")
    pick = lambda c: F.when((F.col("_op") == "upsert") | F.array_contains("_set", c), F.col(f"_{c}_")).otherwise(F.col(c)).alias(c)
    return both.select(key, *map(pick, values)).select(*df.columns)


def delete_scope(df: DataFrame, scope: Column, by: str = "context_type") -> tuple[DataFrame, DataFrame]:
    """The table without the rows of a scope, and how many of each group went."""
    return df.where(~F.coalesce(scope, F.lit(False))), df.where(scope).groupBy(by).agg(F.count(F.lit(1)).alias("deleted"))


def clear(df: DataFrame) -> DataFrame:
    """The table without rows."""
    return df.where(F.lit(False))


def change_feed(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(op, key, before, after) of the rows inserted, updated and deleted between two versions."""
    values = [c for c in old.columns if c != key]
    side = lambda df, name: df.select(key, F.struct(*values).alias(name))
    both = side(old, "before").join(side(new, "after"), key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.withColumn("op", F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update"))


def reindex_plan(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Action for each (uri, level) of entries (uri, level, md5, fields_md5) and records (same, and vector_ok):
    upsert if new or its text changed, merge if its vector is missing, update_fields if only other fields changed,
    delete if gone, else none."""
    e = entries.select("uri", "level", F.col("md5").alias("new_md5"), F.col("fields_md5").alias("new_fields"))
    r = records.select("uri", "level", F.col("md5").alias("old_md5"), F.col("fields_md5").alias("old_fields"), "vector_ok", F.lit(True).alias("there"))
    action = F.when(F.col("new_md5").isNull(), "delete").when(F.col("there").isNull() | (F.col("new_md5") != F.coalesce("old_md5", F.lit(""))), "upsert").when(~F.col("vector_ok"), "merge").when(~F.col("new_fields").eqNullSafe(F.col("old_fields")), "update_fields").otherwise("none")
    return e.join(r, ["uri", "level"], "full_outer").select("uri", "level", action.alias("action"))
