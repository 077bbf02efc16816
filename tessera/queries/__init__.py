"""Registered queries: each applies an operator to the driver's tables; `sql` is its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, and records made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def records(self) -> DataFrame:
        from ..schema import records_from_documents

        return records_from_documents(self.documents)


def query(name: str, sql: str | None = None):
    """Register a function of Tables."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


#: The records of schema.records_from_documents, for DuckDB.
RECORDS = """WITH records AS (SELECT doc_id, 'ctx://resources/' || lang || '/' || source || '/' || doc_id || '.md' AS uri, 'ctx://resources/' || lang || '/' || source AS parent_uri,
 'resource' AS context_type, 2 AS level, text AS content, substr(text, 1, 80) AS abstract, doc_id % 50 AS active_count, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS updated_at,
 'acc' || (doc_id % 4) AS account_id, ['lang=' || lang, 'src=' || source] AS search_tags, lang, source FROM documents) """

from . import analytics, filtering, joining, retrieval, scalars  # noqa: E402, F401
