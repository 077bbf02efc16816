"""Streaming operators (T1-T7, T10, T11, S9, S10, G10) for Structured Streaming, by event time; T8, T12 and T13, which write
tables, are in tables.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.aggregates import HOURLY


def count_or_age(most: int, age_ms: int) -> Callable[..., Iterator[pd.DataFrame]]:
    """Buffers rows (item, ms) of a key; a batch goes out at `most` rows or when its oldest is `age_ms` old. A key's state
    comes and goes with its rows, once for each micro-batch."""

    def run(key, rows, state: GroupState) -> Iterator[pd.DataFrame]:
        items, due, out = [], None, []
        if state.exists:
            items, due = [*state.get[0]], state.get[1]
        for pdf in () if state.hasTimedOut else rows:
            for item, ms in zip(pdf["item"], pdf["ms"]):
                items.append(item)
                if ms == ms:  # a row without a time doesn't age
                    due = int(ms) + age_ms if due is None else min(due, int(ms) + age_ms)
                if len(items) >= most:
                    out.append((items, "count"))
                    items, due = [], None
        if items and (state.hasTimedOut or due is not None and due <= state.getCurrentWatermarkMs()):
            out.append((items, "age"))
            items = []
        if items:
            state.update((items, due))
            if due is not None:
                state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"key": key[0], "items": [i for i, _ in out], "why": [w for _, w in out]})

    return run


def microbatch(stream: DataFrame, most: int = 8, age_seconds: int = 10, delay: str = "0 seconds") -> DataFrame:
    """Batches (key, items, why) of a stream (key, ts, item)."""
    rows = stream.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")).groupBy("key")
    return rows.applyInPandasWithState(count_or_age(most, age_seconds * 1000), "key string, items array<string>, why string", "items array<string>, due long", "append", GroupStateTimeout.EventTimeTimeout)


def usage_rollup_stream(events: DataFrame, grain: str = "1 hour", delay: str = "10 minutes", keys: tuple[str, ...] = HOURLY) -> DataFrame:
    """Tokens by keys and tumbling window, each event_id counted once within the watermark. Works on a batch too."""
    once = events.withWatermark("ts", delay)
    once = once.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else once.dropDuplicates(["event_id"])
    by = once.groupBy(*keys, F.window("ts", grain).alias("w")).agg(F.sum("token_count").alias("tokens"))
    return by.select(*keys, F.col("w.start").alias("bucket"), "tokens")


def sliding_rate(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes", value: str = "token_count") -> DataFrame:
    """Tokens a minute in sliding windows."""
    minutes = F.unix_timestamp("w.end").cast("double") / 60 - F.unix_timestamp("w.start").cast("double") / 60
    by = events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide).alias("w")).agg(F.sum(value).alias("tokens"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "tokens", (F.col("tokens") / minutes).alias("per_minute"))


MIN_IDLE, DEFAULT_IDLE = 300, 86_400


def idle_seconds(timeout: Column) -> Column:
    """Idle time of a session's policy: null is the default, at least MIN_IDLE."""
    return F.greatest(F.coalesce(timeout, F.lit(DEFAULT_IDLE)), F.lit(MIN_IDLE))


def session_idle(messages: DataFrame, delay: str = "10 minutes", timeout: str = "idle_timeout") -> DataFrame:
    """T4: (session_id, first, closes_at, messages): a session closes when no message came for its idle time; new
    messages open it again. Sessions with timeout 0 never close."""
    own = messages.where(F.coalesce(F.col(timeout), F.lit(DEFAULT_IDLE)) != 0).withWatermark("ts", delay)
    by = own.groupBy("session_id", F.session_window("ts", F.concat(idle_seconds(F.col(timeout)).cast("string"), F.lit(" seconds"))).alias("w")).agg(F.count(F.lit(1)).alias("messages"))
    return by.select("session_id", F.col("w.start").alias("first"), F.col("w.end").alias("closes_at"), "messages")


class Commit(StatefulProcessor):
    """T5: counts pending tokens and messages of a session; emits a commit at either limit, or when idle. A commit that
    the interval holds back has a timer of its own, so it goes out without a further message."""

    def __init__(self, tokens: int, messages: int, idle_ms: int, keep: int, interval_ms: int):
        self.limits = (tokens, messages, idle_ms, keep, interval_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", "tokens long, messages long, last_commit long, idle_at long, held_until long")

    def _now(self) -> list[int]:
        return [*self.state.get()] if self.state.exists() else [0, 0, -(1 << 62), 0, 0]

    def _reached(self, tokens: int, messages: int) -> str | None:
        return "tokens" if tokens >= self.limits[0] else "messages" if messages >= self.limits[1] else None

    def _rest(self, tokens: int, messages: int, last: int, idle_at: int) -> None:
        """Keep the state, with the timers it needs: 0 stands for none."""
        held = last + self.limits[4] if self._reached(tokens, messages) else 0
        idle_at = idle_at if messages else 0
        self.state.update((tokens, messages, last, idle_at, held))
        for t in [*self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        for t in {held, idle_at} - {0}:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        idle, keep, interval = self.limits[2:]
        tokens, messages, last, idle_at, _ = self._now()
        out = []
        for pdf in rows:
            for t, n in sorted(zip((pdf["ts"].astype("int64") // 10**6 if str(pdf["ts"].dtype).endswith("[ns]") else pdf["ts"].map(lambda x: int(x.timestamp() * 1000))), pdf["tokens"])):
                tokens, messages, idle_at = tokens + int(n), messages + 1, max(idle_at, int(t) + idle)
                why = self._reached(tokens, messages)
                if why and t - last >= interval:
                    out.append((key[0], why, tokens, max(messages - keep, 0)))
                    tokens, messages, last = 0, 0, int(t)
        self._rest(tokens, messages, last, idle_at)
        yield pd.DataFrame(out, columns=["session_id", "why", "tokens", "messages"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, keep = expiredTimerInfo.getExpiryTimeInMs(), self.limits[3]
        tokens, messages, last, idle_at, held = self._now()
        why = self._reached(tokens, messages)
        if messages and why and at == held:
            self._rest(0, 0, at, 0)
            yield pd.DataFrame([(key[0], why, tokens, max(messages - keep, 0))], columns=["session_id", "why", "tokens", "messages"])
        elif messages and at == idle_at:
            self._rest(0, 0, at, 0)
            yield pd.DataFrame([(key[0], "idle", tokens, messages)], columns=["session_id", "why", "tokens", "messages"])

    def close(self) -> None:
        pass


def auto_commit(stream: DataFrame, tokens: int = 150_000, messages: int = 100, idle_seconds: int = 86_400, keep: int = 0, min_interval_seconds: int = 0, delay: str = "0 seconds") -> DataFrame:
    """T5: commits (session_id, why, tokens, messages) of a stream (session_id, ts, tokens)."""
    return stream.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(Commit(tokens, messages, idle_seconds * 1000, keep, min_interval_seconds * 1000), "session_id string, why string, tokens long, messages long", "append", "eventTime")


def pending_changes(stream: DataFrame) -> DataFrame:
    """Running number of changed children by parent (output mode `update`)."""
    return stream.groupBy("parent").agg(F.count(F.lit(1)).alias("pending"))


class Expiry(StatefulProcessor):
    """An item (key, due, op) expires at its due time unless it is unregistered before. What expired is due again
    after a back-off that doubles, until it is reported as done or was tried `most` times."""

    def __init__(self, most: int, backoff_ms: int):
        self.most, self.backoff_ms = most, backoff_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tried = handle.getValueState("tried", "attempts int")

    def _arm(self, at: int | None, attempts: int) -> None:
        for t in [*self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        if at is None:
            self.tried.clear()
        else:
            self.handle.registerTimer(at)
            self.tried.update((attempts,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for r in pdf.sort_values("ts").itertuples():
                self._arm(int(r.due.timestamp() * 1000) if r.op == "register" else None, 0)
        yield pd.DataFrame({"key": pd.Series(dtype=str), "expired_at": pd.Series(dtype="int64"), "attempt": pd.Series(dtype="int32"), "last": pd.Series(dtype=bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, attempt = expiredTimerInfo.getExpiryTimeInMs(), (self.tried.get()[0] if self.tried.exists() else 0) + 1
        self._arm(at + (self.backoff_ms << (attempt - 1)) if attempt < self.most else None, attempt)
        yield pd.DataFrame({"key": [key[0]], "expired_at": [at], "attempt": pd.Series([attempt], dtype="int32"), "last": [attempt >= self.most]})

    def close(self) -> None:
        pass


def expiry_stream(stream: DataFrame, delay: str = "0 seconds", most_attempts: int = 1, backoff_seconds: int = 60) -> DataFrame:
    """(key, expired_at in ms, attempt, last, bucket: its minute) of a stream (key, ts, due, op: register, or
    unregister or done)."""
    found = stream.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Expiry(most_attempts, backoff_seconds * 1000), "key string, expired_at long, attempt int, last boolean", "append", "eventTime")
    return found.withColumn("bucket", F.date_trunc("minute", F.timestamp_millis("expired_at")))


def expiry_batch(records: DataFrame, now: Column, most_attempts: int = 5) -> DataFrame:
    """T7 on a table (expire_at, attempts): what is due, by minute bucket, without rows tried too often."""
    due = records.where((F.col("expire_at") <= now) & (F.col("attempts") < most_attempts))
    return due.withColumn("bucket", F.date_trunc("minute", "expire_at"))


def reask_stream(answers: DataFrame, questions: DataFrame, minutes: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Answers (conv_id, msg_id, ts) with the user's questions (conv_id, q_id, q_ts) up to `minutes` later, each pair
    a row; answers without one come with nulls once the watermark has passed."""
    a, q = answers.withWatermark("ts", delay), questions.withColumnRenamed("conv_id", "q_conv").withWatermark("q_ts", delay)
    near = (F.col("conv_id") == F.col("q_conv")) & (F.col("q_ts") >= F.col("ts")) & (F.col("q_ts") <= F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return a.join(q, near, "left_outer").drop("q_conv")


def stream_enrich(stream: DataFrame, records: DataFrame, key: str = "uri") -> DataFrame:
    """Events with the columns of the record table."""
    return stream.join(records, key, "left")


#: Names of usage events in the sink.
EVENT_NAMES = {"memory.recalled": "experience.recall.count", "memory.extracted": "experience.extract.count", "search.completed": "retrieval.search.count", "resource.added": "resource.add.count"}


def sink_rows(events: DataFrame) -> DataFrame:
    """Events (event_name, ts, ...) with the sink's names, date and hour."""
    names = F.create_map(*(F.lit(x) for kv in EVENT_NAMES.items() for x in kv))
    return events.withColumns({"event_name": F.coalesce(names[F.col("event_name")], F.col("event_name")), "date": F.date_format("ts", "yyyy-MM-dd"), "hour": F.date_format("ts", "HH")})


def event_sink_files(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """JSON files by date and hour."""
    return sink_rows(events).writeStream.format("json").partitionBy("date", "hour").option("path", path).option("checkpointLocation", checkpoint)


def kafka_rows(events: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """Key, value and `oversized` of events (account, resource, owner_account and others)."""
    value = F.to_json(F.struct(*events.columns))
    return events.select(F.concat_ws("|", "account", "resource", "owner_account").alias("key"), value.alias("value")).withColumn("oversized", F.octet_length("value") > most_bytes)


def event_sink_kafka(events: DataFrame, topic: str, servers: str, checkpoint: str, most_bytes: int = 1 << 20) -> DataStreamWriter:
    """Events as JSON to a topic; payloads above most_bytes are left out and counted in the observed metric
    `oversized`."""
    rows = kafka_rows(events, most_bytes).observe("sink", F.count_if("oversized").alias("oversized")).where("NOT oversized").select("key", "value")
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def custom_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Micro-batches go to a user's function of (rows, batch id)."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
