"""Window operators and orders."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import ACCENTS, LETTERS, STOP_WORDS, decided_language, language_evidence, squeeze
from .project import skill_root


def merge_packages(matches: DataFrame) -> DataFrame:
    """Of skills one hit for each package root, by score, uri and level; other hits stay; best first."""
    root = skill_root(F.col("uri"))
    skills = matches.where("context_type = 'skill'").withColumn("root", root).where("root <> ''")
    w = Window.partitionBy("root").orderBy(F.desc("score"), "uri", "level")
    one = skills.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    rest = matches.where("context_type <> 'skill'").withColumn("root", F.lit(None).cast("string"))
    return one.unionByName(rest).orderBy(F.desc("score"), F.coalesce("root", "uri"))


def canonical_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The row with the least id of each (uri, level), and the others."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy("uri", "level").orderBy("id")))
    return ranked.where("_rn = 1").drop("_rn"), ranked.where("_rn > 1").drop("_rn")


def signature(body: Column) -> Column:
    """Hash of a body with white space squeezed, in lower case."""
    return F.sha2(F.lower(squeeze(body)), 256)


def dedup_signature(df: DataFrame, body: str = "content", order: str = "id", known: DataFrame | None = None) -> DataFrame:
    """Rows whose signature no earlier row (by order) has, nor any of the known ones (column signature)."""
    own = df.withColumn("signature", signature(F.col(body)))
    first = own.withColumn("_rn", F.row_number().over(Window.partitionBy("signature").orderBy(order))).where("_rn = 1").drop("_rn")
    return first if known is None else first.join(known.select("signature"), "signature", "left_anti")


def quota_select(candidates: DataFrame, quotas: dict[str, int], total: int, peer_penalty: float = 0.0, by: str = "qid", key: str = "id") -> DataFrame:
    """The best of each category up to its quota, then the best of the rest until `total`; the score of other peers'
    rows (other_peer) is lowered by the penalty first."""
    rows = candidates.withColumn("score", F.col("score") - F.when(F.col("other_peer"), peer_penalty).otherwise(0.0)) if "other_peer" in candidates.columns else candidates
    quota = F.coalesce(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("category")], F.lit(0)) if quotas else F.lit(0)
    order = (F.desc("score"), F.asc(key))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy(by, "category").orderBy(*order)) <= quota)
    chosen = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_in"), *order))).where(F.col("_rn") <= total)
    return chosen.withColumnRenamed("_in", "by_quota").drop("_rn")


def pack_batches(units: DataFrame, max_tokens: int, max_messages: int) -> DataFrame:
    """W7's fold: greedy batches of a session's units (session, pos, tokens, messages and others) in order: `batch` from 0, `oversized`
    for a unit that alone is too large. Sessions are packed apart, each as a stream of its sorted rows, so a long one
    needs no more memory than a short one."""

    def run(batches):
        state = {"session": object(), "batch": 0, "tokens": 0, "messages": 0}
        for pdf in batches:
            numbers, over = [], []
            for session, tokens, n in zip(pdf.session, pdf.tokens, pdf.messages):
                large = tokens > max_tokens or n > max_messages
                if session != state["session"]:
                    state = {"session": session, "batch": 0, "tokens": 0, "messages": 0}
                elif state["messages"] and (large or state["tokens"] + tokens > max_tokens or state["messages"] + n > max_messages):
                    state |= {"batch": state["batch"] + 1, "tokens": 0, "messages": 0}
                state["tokens"] += tokens
                state["messages"] += n
                numbers.append(state["batch"])
                over.append(bool(large))
            yield pdf.assign(batch=pd.Series(numbers, index=pdf.index, dtype="int64"), oversized=pd.Series(over, index=pdf.index, dtype=bool))

    rows = units.repartition("session").sortWithinPartitions("session", "pos")
    return rows.mapInPandas(run, StructType([*rows.schema, StructField("batch", LongType()), StructField("oversized", BooleanType())]))


def grep(files: DataFrame, pattern: str, before: int = 0, after: int = 0, limit: int | None = None) -> DataFrame:
    """Lines of files (path, text) that match, numbered from 1, with the lines around them; at most `limit` a file."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    w = Window.partitionBy("path").orderBy("n")
    around = lambda a, b: F.collect_list("line").over(w.rowsBetween(a, b)) if a <= b else F.array().cast("array<string>")
    found = lines.withColumns({"before": around(-before, -1), "after": around(1, after)}).where(F.col("line").rlike(pattern))
    return found if limit is None else found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def page(df: DataFrame, keys: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """Rows in the order of keys after a cursor (their values in the last row seen), limit of them, with has_more."""
    rows = df if after is None else df.where(F.struct(*keys) > F.struct(*(F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True))))
    head = rows.orderBy(*keys).limit(limit + 1)
    w = Window.orderBy(*keys)  # over limit + 1 rows at most
    return head.withColumns({"_rn": F.row_number().over(w), "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > limit}).where(F.col("_rn") <= limit).drop("_rn")


def freshness(children: DataFrame, ratio: float = 0.2, small: int = 5) -> DataFrame:
    """Of directories (parent; children with changed, pending, first_time): noop if nothing changed, refresh at
    first, if small or if enough children are pending, else mark."""
    by = children.groupBy("parent").agg(F.count(F.lit(1)).alias("total"), F.count_if("pending").alias("pending"), F.max("changed").alias("changed"), F.max("first_time").alias("first_time"))
    action = F.when(~F.col("changed"), "noop").when(F.col("first_time") | (F.col("total") <= small) | (F.col("pending") >= F.col("total") * ratio), "refresh").otherwise("mark")
    return by.withColumn("action", action)


def sort(df: DataFrame, fields: list[str], orders: list[str] | None = None, topk: int = 10, key: str | None = None) -> DataFrame:
    """O1: by fields, each `desc` (also the default) or `asc`, missing values last, then by key, the first topk. Without
    a key, rows that are equal so far are ordered by all their columns that have an order, so the same rows come always."""
    orders = orders or ["desc"] * len(fields)
    if len(orders) != len(fields):
        raise ValueError("as many orders as fields are needed")
    if bad := [o for o in orders if not re.fullmatch("asc|desc", o)]:
        raise ValueError(f"unknown orders: {bad}")
    ties = [key] if key else [c.name for c in df.schema if c.name not in fields and isinstance(c.dataType, AtomicType)]
    return df.orderBy(*(F.col(f).desc_nulls_last() if o == "desc" else F.col(f).asc_nulls_last() for f, o in zip(fields, orders, strict=True)), *(F.col(c).asc_nulls_last() for c in ties)).limit(topk)


def sort_center1d(df: DataFrame, field: str, center: float, topk: int = 10, key: str = "id") -> DataFrame:
    """O2: nearest to center first."""
    return df.where(F.col(field).isNotNull()).orderBy(F.abs(F.col(field) - center), key).limit(topk)


def sort_geo(df: DataFrame, lon: str, lat: str, center: tuple[float, float], topk: int = 10, key: str = "id") -> DataFrame:
    """O3: by planar distance from a place."""
    d2 = F.pow(F.col(lon) - center[0], 2) + F.pow(F.col(lat) - center[1], 2)
    return df.where(d2.isNotNull()).orderBy(d2, key).limit(topk)


def path_order(df: DataFrame, path: str = "path") -> DataFrame:
    """By path, segment after segment."""
    return df.orderBy(F.split(path, "/"))


def limited(df: DataFrame, *order, limit: int = 10, offset: int = 0) -> DataFrame:
    """Limit (10 by default) rows after offset."""
    return df.orderBy(*order).offset(offset).limit(limit)


def conversation_language(turns: DataFrame, fallback: str = "en") -> DataFrame:
    """(conv_id, value), the language of a conversation's user messages (conv_id, role, text), or of all where no user said
    anything. Each message is counted by itself and counts are added up, so no conversation is gathered."""
    kinds = [*LETTERS, "grammar", "words", *(f"stop_{k}" for k in STOP_WORDS), *(f"accent_{k}" for k in ACCENTS)]
    told = turns.select("conv_id", (F.coalesce(F.col("role"), F.lit("")) == "user").alias("own"), (F.coalesce(F.trim("text"), F.lit("")) != "").alias("said"), language_evidence(F.col("text")).alias("e"))
    sums = lambda of: F.create_map(*(x for k in kinds for x in (F.lit(k), F.coalesce(F.sum(of(F.col("e")[k])), F.lit(0).cast("long")))))
    found = told.groupBy("conv_id").agg(F.max(F.col("own") & F.col("said")).alias("own"), sums(lambda c: F.when(F.col("own"), c)).alias("user"), sums(lambda c: c).alias("every"))
    return found.select("conv_id", decided_language(F.when(F.col("own"), F.col("user")).otherwise(F.col("every")), fallback).alias("value"))
