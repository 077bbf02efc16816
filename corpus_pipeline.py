"""A corpus pipeline of five stages over `documents`, each of which calls one operator of tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. `run`
writes each stage's rows to the shared folder and reads them again as the next one's docs; what came before is deleted. Null and empty texts,
repeated rows and empty tables are handled as the operators say; further columns of docs are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from tessera.llm.common import SPACE_CHARS, crc_mod, discard, scratch, stage, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier, fitted as in its query, rejects."""
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"))
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    return quality_rules.kept(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs, and documents of which no word is left; n_chars follows."""
    has_word = lambda: F.length(F.translate("text", SPACE_CHARS, "")) > 0
    found = line_dedup.deduped(docs.where(has_word())).where(has_word())
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document that names its component. Near copies share 80 percent of their five-word shingles; three
    words and 90 percent are the contract of op2 alone."""
    return jaccard_join.representatives(docs, n=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality_classifier", classify), ("quality_rules", apply_rules), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_copies), ("best_fit_packing", pack)]

#: The classifier's training can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with scratch() as made:
            before, docs = docs, stage(step(spark, docs, sf_dir), name)
            made.pop()  # all else was only on the way to it
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # its pieces are written
    return out


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
