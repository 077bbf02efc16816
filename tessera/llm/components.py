"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    """Each edge of a with the least of a's neighbours and a itself; a node's edges are never gathered."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return edges.join(least, "a")


def _round(edges: DataFrame) -> DataFrame:
    large = _least(_both(edges)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    small = _least(down)
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether edges (a > b) aren't yet stars: an end a that has two, or that is an end b too."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    return not twice.unionByName(edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is its least node. Rounds go on until
    the edges are stars; each is written to the shared folder. Null ends are left out."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while _open(now):
        before, now = now, stage(_round(now), "edges")
        discard(before)
    return now.unionByName(now.select(F.col("b").alias("a"), "b").distinct()).toDF("node", "component")
