"""Streams against the same operators on tables."""

import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.sources.turns import stream_turn_logs
from tessera.streaming import streams as S

DAY = datetime(2024, 1, 1, tzinfo=UTC)


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def streamed(spark, df, tmp_path, name="in", files=1):
    df.repartition(files).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


@pytest.fixture(scope="module")
def usage(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), F.floor("value").alias("token_count"))


def test_rollup_stream_is_the_batch(spark, usage, tmp_path):
    twice = usage.unionByName(usage.where("event_id % 3 = 0"))
    batch = {tuple(r) for r in S.usage_rollup_stream(usage, keys=("source",)).collect()}
    got = run(S.usage_rollup_stream(streamed(spark, twice, tmp_path), keys=("source",), delay="60 days"), "update", tmp_path, "rollup")
    assert {tuple(r) for r in got.groupBy("source", "bucket").agg(F.max("tokens")).collect()} == batch


def test_sliding_rate_and_pending(spark, usage, tmp_path):
    batch = {tuple(r) for r in S.sliding_rate(usage).collect()}
    got = run(S.sliding_rate(streamed(spark, usage, tmp_path)), "update", tmp_path, "sliding")
    assert {tuple(r) for r in got.collect()} == batch
    pending = run(S.pending_changes(streamed(spark, usage.select(F.col("source").alias("parent")), tmp_path, "p")), "complete", tmp_path, "pending")
    assert pending.agg(F.sum("pending")).first()[0] == usage.count()


def test_microbatches_by_count_or_age(spark, tmp_path):
    rows = [("k", DAY + timedelta(seconds=i), f"i{i}") for i in range(5)] + [("k", DAY + timedelta(hours=1), "late")]
    df = spark.createDataFrame(rows, "key string, ts timestamp, item string").coalesce(1)
    got = run(S.microbatch(streamed(spark, df, tmp_path), most=3, age_seconds=10), "append", tmp_path, "mb")
    assert sorted(len(r["items"]) for r in got.collect())[-1] == 3 and {r.why for r in got.collect()} <= {"count", "age"}


def test_commits(spark, tmp_path):
    rows = [("s", DAY + timedelta(minutes=i), 40) for i in range(5)] + [("t", DAY, 1), ("u", DAY + timedelta(days=3), 1)]
    got = run(S.auto_commit(streamed(spark, spark.createDataFrame(rows, "session_id string, ts timestamp, tokens int").coalesce(1), tmp_path), tokens=100, messages=50), "append", tmp_path, "commits")
    found = {(r.session_id, r.why) for r in got.collect()}
    assert ("s", "tokens") in found and ("t", "idle") in found and not any(s == "u" for s, _ in found)


def test_expiry(spark, tmp_path):
    rows = [("a", DAY, DAY + timedelta(hours=1), "register"), ("b", DAY, DAY + timedelta(hours=1), "register"), ("b", DAY + timedelta(minutes=1), None, "unregister"), ("z", DAY + timedelta(days=2), DAY + timedelta(days=9), "register")]
    got = run(S.expiry_stream(streamed(spark, spark.createDataFrame(rows, "key string, ts timestamp, due timestamp, op string").coalesce(1), tmp_path)), "append", tmp_path, "expiry")
    assert [r.key for r in got.collect()] == ["a"]


def in_order(spark, batches, schema, tmp_path, name):
    """A stream that reads one of the batches at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/part={i}")
    for i in range(len(batches)):
        for f in os.listdir(f"{tmp_path}/{name}/part={i}"):
            os.utime(f"{tmp_path}/{name}/part={i}/{f}", (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")


def test_a_commit_held_back_goes_out_without_a_message(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    batches = [[("s", at(0), 100), ("s", at(1), 100)], [("s", at(2), 1), ("x", at(30), 1)], [("x", at(31), 1)]]
    stream = in_order(spark, batches, "session_id string, ts timestamp, tokens int", tmp_path, "held")
    found = run(S.auto_commit(stream, tokens=100, messages=50, idle_seconds=7200, min_interval_seconds=600), "append", tmp_path, "held_out")
    # the first message commits; the second reaches the limit within 10 minutes, and waits with the third for their end
    assert [(r.session_id, r.why, r.tokens, r.messages) for r in found.collect() if r.session_id == "s"] == [("s", "tokens", 100, 1), ("s", "tokens", 101, 2)]


def test_expiry_is_tried_again_with_backoff(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    batches = [[("a", at(0), at(10), "register"), ("b", at(0), at(10), "register"), ("c", at(0), at(10), "register")], [("z", at(11), at(999), "register")], [("z", at(11), at(999), "register")], [("b", at(11.5), None, "done"), ("z", at(11.5), at(999), "register")], [("z", at(90), at(999), "register")], [("z", at(91), at(999), "register")], [("z", at(92), at(999), "register")], [("z", at(93), at(999), "register")]]
    stream = in_order(spark, batches, "key string, ts timestamp, due timestamp, op string", tmp_path, "tries")
    got = run(S.expiry_stream(stream, most_attempts=3, backoff_seconds=120), "append", tmp_path, "tries_out").collect()
    start = int(at(10).timestamp() * 1000)
    tries = lambda key: sorted((r.attempt, r.expired_at - start, r.last) for r in got if r.key == key)
    assert tries("a") == tries("c") == [(1, 0, False), (2, 120_000, False), (3, 360_000, True)]
    assert tries("b") == [(1, 0, False)]


def test_reask_join(spark, tmp_path):
    a = spark.createDataFrame([("c", 1, DAY), ("c", 2, DAY + timedelta(hours=5))], "conv_id string, msg_id int, ts timestamp")
    q = spark.createDataFrame([("c", 9, DAY + timedelta(minutes=3))], "conv_id string, q_id int, q_ts timestamp")
    got = run(S.reask_stream(streamed(spark, a, tmp_path, "a"), streamed(spark, q, tmp_path, "q")), "append", tmp_path, "reask")
    assert (1, 9) in {(r.msg_id, r.q_id) for r in got.collect()}


def test_sinks_and_sources(spark, usage, tmp_path):
    ev = streamed(spark, usage.select("ts", F.lit("search.completed").alias("event_name")), tmp_path)
    S.event_sink_files(ev, f"{tmp_path}/json", f"{tmp_path}/cj").trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.json(f"{tmp_path}/json")
    assert out.count() == usage.count() and {"date", "hour"} <= set(out.columns) and out.first().event_name == "retrieval.search.count"
    seen = []
    S.custom_sink(ev, lambda df, i: seen.append(df.count()), f"{tmp_path}/cc").trigger(availableNow=True).start().awaitTermination(120)
    assert sum(seen) == usage.count()
    enriched = S.stream_enrich(ev.withColumn("uri", F.col("event_name")), spark.createDataFrame([("search.completed", 1)], "uri string, n int"))
    assert run(enriched, "append", tmp_path, "enriched").where("n = 1").count() == usage.count()
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"role":"user","session_id":"s","content":"hi","created_at":"2026-01-01T00:00:00Z"}\n{nope\n')
    assert run(stream_turn_logs(spark, str(logs), "flat"), "append", tmp_path, "turns").count() == 1


def test_microbatch_ages_by_its_oldest_row(spark, tmp_path):
    """Rows that come out of order go out by the oldest one's age; state is handed over once a key, not row by row."""
    at = lambda s: DAY + timedelta(seconds=s)
    stream = in_order(spark, [[("k", at(20), "a"), ("k", at(0), "b")], [("z", at(40), "c")]], "key string, ts timestamp, item string", tmp_path, "aged")
    df = S.microbatch(stream, most=3, age_seconds=30)
    assert "FlatMapGroupsInPandasWithState" in df._jdf.queryExecution().logical().toString()
    assert [(r.key, sorted(r["items"]), r.why) for r in run(df, "append", tmp_path, "aged_out").collect()] == [("k", ["a", "b"], "age")]


def test_microbatches_of_many_keys_keep_what_is_left_over(spark, tmp_path):
    """Rows that don't fill a batch wait in the state for the next micro-batch."""
    rows = lambda n: [(f"k{k}", DAY + timedelta(days=n, seconds=i), f"{n}-{i}") for k in range(50) for i in range(5)]
    got = run(S.microbatch(in_order(spark, [rows(0), rows(1)], "key string, ts timestamp, item string", tmp_path, "many"), most=4, age_seconds=10**8), "append", tmp_path, "many_out").collect()
    assert sorted((r.key, len(r["items"]), r.why) for r in got) == sorted((f"k{k}", 4, "count") for k in range(50) for _ in range(2))
