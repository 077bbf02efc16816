"""The record table: one row for each context record and level of detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, MapType, StringType, StructType, TimestampType

SCHEME = "ctx://"
LEVELS = {0: "abstract", 1: "overview", 2: "detail"}
CONTEXT_TYPES = ("memory", "resource", "skill")

CONTEXT_SCHEMA = StructType()
for _kind, _names in (
    (StringType(), "id uri parent_uri context_type category"), (IntegerType(), "level"), (BooleanType(), "is_leaf"),
    (StringType(), "abstract content name description"), (ArrayType(FloatType()), "vector"), (MapType(StringType(), FloatType()), "sparse_vector"),
    (LongType(), "active_count"), (TimestampType(), "created_at updated_at"), (StringType(), "account_id owner_user_id owner_space session_id md5"),
    (ArrayType(StringType()), "search_tags related_uri"),
):
    for _name in _names.split():
        CONTEXT_SCHEMA.add(_name, _kind)

#: What a declared column holds where a row lacks it.
TYPE_DEFAULTS = {StringType: "", LongType: 0, IntegerType: 0, BooleanType: False, FloatType: 0.0}


def records_from_documents(documents: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """The driver's documents as resource records of level 2: uri from language, source and doc_id, vectors where
    embeddings has them, and times, counters, accounts and tags by fixed rules. doc_id is kept beside."""
    doc = F.col("doc_id")
    out = documents.select(
        "doc_id",
        F.concat(F.lit(f"{SCHEME}resources/"), "lang", F.lit("/"), "source", F.lit("/"), doc.cast("string"), F.lit(".md")).alias("uri"),
        F.concat(F.lit(f"{SCHEME}resources/"), "lang", F.lit("/"), "source").alias("parent_uri"),
        F.lit("resource").alias("context_type"),
        F.lit(2).alias("level"),
        F.col("text").alias("content"),
        F.substring("text", 1, 80).alias("abstract"),
        (doc % 50).alias("active_count"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 3600).alias("updated_at"),
        F.concat(F.lit("acc"), (doc % 4).cast("string")).alias("account_id"),
        F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("src="), "source")).alias("search_tags"),
        "lang",
        "source",
    )
    if embeddings is not None:
        out = out.join(embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    return out
