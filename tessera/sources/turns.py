"""Conversation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN = "harness string, session_id string, role string, text string, created_at timestamp, peer_id string"

#: Of each log format: the condition that a line is a message, and JSON paths of session, role, text and time.
HARNESSES = {
    "typed": ("$.type", ("user", "assistant"), "$.sessionId", "$.message.role", "$.message.content", "$.timestamp"),
    "payload": ("$.payload.type", ("message",), "$.payload.session_id", "$.payload.role", "$.payload.content", "$.timestamp"),
    "flat": ("$.role", ("user", "assistant"), "$.session_id", "$.role", "$.content", "$.created_at"),
}


def parse_lines(lines: DataFrame, harness: str) -> DataFrame:
    """Turns of JSON lines (value): lines that aren't JSON have `malformed`, lines of other kinds are left out."""
    kind, accepted, session, role, text, time = HARNESSES[harness]
    get = lambda path: F.get_json_object("value", path)
    bad = F.try_parse_json("value").isNull()
    rows = lines.where(F.trim("value") != "").withColumn("malformed", bad)
    return rows.where(F.col("malformed") | get(kind).isin(*accepted)).select(
        F.lit(harness).alias("harness"), get(session).alias("session_id"), get(role).alias("role"), get(text).alias("text"),
        F.try_to_timestamp(get(time)).alias("created_at"), get("$.peer_id").alias("peer_id"), "malformed", F.col("value").alias("line"),
    )


def read_turn_logs(spark: SparkSession, path: str, harness: str, since=None) -> tuple[DataFrame, DataFrame]:
    """Turns of JSONL logs, from a time on, and the malformed lines."""
    rows = parse_lines(spark.read.text(path), harness)
    good = rows.where("NOT malformed").drop("malformed", "line")
    return good if since is None else good.where(F.col("created_at") >= F.lit(since)), rows.where("malformed").select("harness", "line")


def stream_turn_logs(spark: SparkSession, path: str, harness: str, files_a_batch: int = 100) -> DataFrame:
    """S3: a stream of the turns in files that appear in a folder (written elsewhere and renamed, so none is half
    written); the query's checkpoint remembers what was read."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path), harness).where("NOT malformed").drop("malformed", "line")


def read_turn_table(df: DataFrame, cursor: tuple | None, limit: int = 100) -> DataFrame:
    """The next rows (time_created, id, complete) after a cursor, in order, up to the first incomplete one."""
    rows = df if cursor is None else df.where(F.struct("time_created", "id") > F.struct(F.lit(cursor[0]).cast(df.schema["time_created"].dataType).alias("time_created"), F.lit(cursor[1]).cast(df.schema["id"].dataType).alias("id")))
    head = rows.orderBy("time_created", "id").limit(limit)
    ready = F.min(F.col("complete").cast("int")).over(Window.orderBy("time_created", "id"))  # over `limit` rows at most
    return head.withColumn("_ready", ready).where("_ready = 1").drop("_ready")


def folded_role(role: Column) -> Column:
    return F.when(F.lower(F.trim(role)).isin("user", "human"), "user").otherwise("assistant")


def normalize_turns(df: DataFrame) -> DataFrame:
    """Roles folded to user and assistant, texts trimmed, empty turns dropped, other columns kept."""
    return df.withColumns({"role": folded_role(F.col("role")), "text": F.regexp_replace("text", r"^\s+|\s+$", "")}).where("text <> ''")
