"""Queries of aggregations, evaluation statistics and roll-ups."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluation as E
from ..session import SETTINGS
from ..staging import fresh_path
from ..streaming import streams as S
from ..streaming import tables as ST
from . import RECORDS, query

NOW = datetime(2024, 1, 31, tzinfo=UTC)
ISO = "yyyy-MM-dd HH:mm:ss"


def usage(t):
    """Events as token usage."""
    return t.events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("acc"), (F.col("user_id") % 4).cast("string")).alias("account_id"), F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, "input").otherwise("output").alias("token_type"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_name"), F.floor("value").cast("long").alias("token_count"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency_ms"), (F.col("event_id") % 7).alias("n_results"),
    )


USAGE = """WITH usage AS (SELECT event_id, ts, 'acc' || (user_id % 4) AS account_id, user_id::VARCHAR AS user_id, event_type AS source, CASE WHEN event_id % 2 = 0 THEN 'input' ELSE 'output' END AS token_type,
 'p' || (user_id % 3) AS provider, 'm' || (user_id % 5) AS model_name, floor(value)::BIGINT AS token_count, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency_ms, event_id % 7 AS n_results FROM events) """
KEYS = "account_id, user_id, source, token_type, provider, model_name"


def _text(df, *columns: str, pattern: str = ISO):
    return df.withColumns({c: F.date_format(c, pattern) for c in columns})


@query("a01_count", "SELECT count(*) AS _total FROM lineitem WHERE l_quantity > 25")
def _(t):
    return A.count(t.lineitem, F.col("l_quantity") > 25)


@query("a02_count_by", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 100")
def _(t):
    return A.count_by(t.lineitem, "l_returnflag", "l_linestatus", gt=100)


@query("a02_count_by_list", f"{RECORDS} SELECT tag AS search_tags, count(*) AS count FROM (SELECT unnest(search_tags) AS tag FROM records) GROUP BY tag")
def _(t):
    return A.count_by(t.records, "search_tags")



@query("a03_memory_stats", """WITH m AS (SELECT CASE event_type WHEN 'view' THEN 'preferences' WHEN 'click' THEN 'events' WHEN 'error' THEN 'cases' END AS category, event_id % 60 AS n, ts FROM events),
 h AS (SELECT category, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6 AS age, 1 / (1 + exp(-ln(1 + n))) * pow(2, -greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6, 0) / 7) AS heat FROM m),
 a AS (SELECT category, count(*) AS total, count(*) FILTER (heat < 0.2) AS cold, count(*) FILTER (heat BETWEEN 0.2 AND 0.6) AS warm, count(*) FILTER (heat > 0.6) AS hot, count(*) FILTER (age > 7) AS idle_7d, count(*) FILTER (age > 30) AS idle_30d, round(max(age), 1) AS oldest_days FROM h GROUP BY category
  UNION ALL SELECT NULL, count(*), count(*) FILTER (heat < 0.2), count(*) FILTER (heat BETWEEN 0.2 AND 0.6), count(*) FILTER (heat > 0.6), count(*) FILTER (age > 7), count(*) FILTER (age > 30), round(max(age), 1) FROM h)
 SELECT * FROM a WHERE category IS NOT NULL OR total = (SELECT count(*) FROM events) UNION ALL SELECT c, 0, 0, 0, 0, 0, 0, NULL FROM (SELECT unnest(['entities', 'patterns', 'profile', 'tools', 'skills']) AS c)""")
def _(t):
    part = F.when(F.col("event_type") == "view", "preferences").when(F.col("event_type") == "click", "events").when(F.col("event_type") == "error", "cases").otherwise("other")
    rows = t.events.select(F.concat(F.lit("ctx://user/u/memories/"), part, F.lit("/1.md")).alias("uri"), (F.col("event_id") % 60).alias("active_count"), F.col("ts").cast("timestamp").alias("updated_at"))
    return A.memory_stats(rows, F.lit(NOW))


@query("a04_retrieval_stats", """WITH l AS (SELECT event_type AS context_type, event_id % 7 AS n, value, event_id % 3 = 0 AS reranked FROM events)
 SELECT context_type, count(*) AS queries, sum(n)::BIGINT AS results, round(count(*) FILTER (n = 0) / count(*), 4) AS zero_rate, round(sum(n) / count(*), 6) AS avg_results, round(sum(value) / count(*), 6) AS avg_score, min(value) AS min_score, max(value) AS max_score,
  count(*) FILTER (reranked) AS reranked, count(*) FILTER (NOT reranked) AS fallback, round(avg(value), 6) AS avg_ms, max(value) AS max_ms FROM l GROUP BY ROLLUP (context_type)""")
def _(t):
    log = t.events.select(F.col("event_type").alias("context_type"), (F.col("event_id") % 7).alias("n_results"), F.array("value").alias("scores"), (F.col("event_id") % 3 == 0).alias("reranked"), F.col("value").alias("latency_ms"))
    return A.retrieval_stats(log).withColumns({c: F.round(c, 6) for c in ("avg_results", "avg_score", "avg_ms")})


@query("a05_io_stats", "SELECT event_type AS io_type, 'op' || (event_id % 3) AS operation, count(*) AS n, count(*) FILTER (value <= 5) AS errors, round(sum(value), 3) AS total_ms, round(avg(value), 6) AS avg_ms FROM events GROUP BY ROLLUP (event_type, 'op' || (event_id % 3))")
def _(t):
    rows = t.events.select(F.col("event_type").alias("io_type"), F.concat(F.lit("op"), (F.col("event_id") % 3).cast("string")).alias("operation"), (F.col("value") > 5).alias("success"), F.col("value").alias("latency_ms"))
    return A.io_stats(rows).withColumns({"total_ms": F.round("total_ms", 3), "avg_ms": F.round("avg_ms", 6)})


@query("a06_token_rollup_hour", f"{USAGE} SELECT {KEYS}, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, sum(token_count)::BIGINT AS tokens FROM usage GROUP BY ALL")
def _(t):
    return _text(A.token_rollup(usage(t)), "bucket")


@query("a06_token_rollup_minute", f"{USAGE} SELECT account_id, token_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS bucket, sum(token_count)::BIGINT AS tokens FROM usage GROUP BY ALL")
def _(t):
    return _text(A.token_rollup(usage(t), "minute", ("account_id", "token_type")), "bucket")


@query("a07_request_rollup", f"{USAGE} SELECT source, status, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS requests, sum(n_results)::BIGINT AS results FROM usage GROUP BY ALL")
def _(t):
    return _text(A.request_rollup(usage(t), "source", "status"), "bucket")


@query("a08_tokens_for_day", f"{USAGE} SELECT token_type, sum(token_count)::BIGINT AS tokens FROM usage WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-09 16:00:00' AND date_trunc('hour', ts) < TIMESTAMP '2024-01-10 16:00:00' GROUP BY ALL")
def _(t):
    return A.tokens_for_day(A.token_rollup(usage(t)), "2024-01-10", "Asia/Shanghai")


@query("a08_tokens_window", f"{USAGE} SELECT token_type, sum(token_count)::BIGINT AS tokens FROM usage WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06 12:00:00' GROUP BY ALL")
def _(t):
    return A.tokens_window(A.token_rollup(usage(t)), datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 6, 12, tzinfo=UTC))


@query("a09_token_series", f"{USAGE} SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(sum(token_count), 0)::BIGINT AS tokens FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-03', INTERVAL 1 DAY)) AS d) LEFT JOIN usage ON date_trunc('day', ts + INTERVAL 8 HOUR) = d GROUP BY d")
def _(t):
    return _text(A.token_series(A.token_rollup(usage(t)), "2023-12-30", "2024-02-03", "Asia/Shanghai"), "day", pattern="yyyy-MM-dd")


@query("a10_write_heatmap", f"{USAGE} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, (hour(ts) // 4)::BIGINT AS block, count(*)::BIGINT AS n FROM usage WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21' GROUP BY ALL")
def _(t):
    return _text(A.write_heatmap(A.request_rollup(usage(t), "source"), "2024-01-03", "2024-01-20", 4), "day", pattern="yyyy-MM-dd")


@query("a11_token_rate", f"{USAGE}, m AS (SELECT date_trunc('minute', ts) AS b, sum(token_count)::BIGINT AS n FROM usage GROUP BY 1) SELECT sum(n)::BIGINT AS tokens, round(avg(n), 6) AS per_minute, strftime(arg_max(b, (n, -epoch_us(b))), '%Y-%m-%d %H:%M:%S') AS peak_minute, max(n) AS peak FROM m")
def _(t):
    return _text(A.token_rate(A.token_rollup(usage(t), "minute", ("token_type",))), "peak_minute").withColumn("per_minute", F.round("per_minute", 6))


@query("a11_request_health", f"{USAGE} SELECT count(*) AS requests, round(count(*) FILTER (status >= 500) / count(*), 6) AS error_rate, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM usage WHERE ts > TIMESTAMP '2024-01-22' AND ts <= TIMESTAMP '2024-01-29'")
def _(t):
    return A.request_health(usage(t), F.lit(datetime(2024, 1, 29, tzinfo=UTC)), 168).select("requests", *(F.round(c, 6).alias(c) for c in ("error_rate", "p50", "p95", "p99")))


@query("a11_health_windows", f"""{USAGE} SELECT h AS hours, count(*) AS requests, round(count(*) FILTER (status >= 500) / count(*), 6) AS error_rate, true AS p50_near, true AS p99_near
 FROM usage, (SELECT unnest([1, 6, 24, 168]) AS h) WHERE ts < TIMESTAMP '2024-01-29' AND ts >= TIMESTAMP '2024-01-29' - h * INTERVAL 1 HOUR GROUP BY h""")
def _(t):
    """Merged hourly sketches, whose quantiles' true ranks are looked up: they may be off by 2 percent of all ranks."""
    now, rows = F.lit(datetime(2024, 1, 29, tzinfo=UTC)), usage(t)
    found = A.health_windows(A.latency_sketches(rows), now)
    each = rows.withColumn("hours", F.explode(F.array(*map(F.lit, A.HEALTH_HOURS)))).where((F.col("ts") < now) & (F.col("ts") >= now - F.make_interval(hours=F.col("hours"))))
    both = each.join(F.broadcast(found.select("hours", "p50", "p99")), "hours").groupBy("hours")
    near = lambda p, q: (F.avg((F.col("latency_ms") < F.col(p)).cast("int")) <= q + 0.02) & (F.avg((F.col("latency_ms") <= F.col(p)).cast("int")) >= q - 0.02)
    return found.select("hours", "requests", F.round("error_rate", 6).alias("error_rate")).join(both.agg(near("p50", 0.5).alias("p50_near"), near("p99", 0.99).alias("p99_near")), "hours")


@query("a13_judge_stats", """WITH r AS (SELECT (event_id % 6)::VARCHAR AS question_type, CASE event_id % 4 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'wrong' WHEN 2 THEN 'correct' ELSE 'unsure' END AS result, value FROM events WHERE event_id % 6 <> 5)
 SELECT question_type, count(*) FILTER (lower(result) = 'correct') AS correct, count(*) FILTER (result = 'wrong') AS wrong, count(*) FILTER (result = 'unsure') AS other, round(count(*) FILTER (lower(result) = 'correct') / nullif(count(*) FILTER (result <> 'unsure'), 0), 6) AS accuracy, round(avg(value), 6) AS avg_time, round(avg(floor(value)), 6) AS avg_tokens FROM r GROUP BY ROLLUP (question_type)""")
def _(t):
    m = F.col("event_id") % 4
    rows = t.events.select((F.col("event_id") % 6).cast("string").alias("question_type"), F.when(m == 0, "CORRECT").when(m == 1, "wrong").when(m == 2, "correct").otherwise("unsure").alias("result"), F.col("value").alias("time_cost"), F.to_json(F.struct(F.floor("value").alias("total_tokens"))).alias("token_usage"))
    return E.judge_stats(rows).withColumns({c: F.round(c, 6) for c in ("accuracy", "avg_time", "avg_tokens")})


@query("a14_run_summary", """WITH v AS (SELECT 'price' AS metric, o_totalprice AS v FROM orders UNION ALL SELECT 'key', o_custkey FROM orders), m AS (SELECT metric, count(*) AS n, median(v) AS median, min(v) AS min, max(v) AS max FROM v GROUP BY metric)
 SELECT metric, any_value(n) AS n, round(any_value(median), 6) AS median, round(median(abs(v - median)), 6) AS mad, any_value(min) AS min, any_value(max) AS max FROM v JOIN m USING (metric) GROUP BY metric""")
def _(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.lit("d").alias("dataset"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("key"))
    return E.run_summary(runs, ["price", "key"]).withColumns({c: F.round(c, 6) for c in ("median", "mad")})


@query("a15_partition_grade", """WITH f AS (SELECT user_id AS c, event_type AS e, event_id % 2 AS a, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY ALL),
 b AS (SELECT x.c, max(x.n + coalesce(y.n, 0)) AS best FROM f x LEFT JOIN f y ON x.c = y.c AND x.e <> y.e AND x.a <> y.a GROUP BY x.c)
 SELECT user_id AS case_id, round(count(*) FILTER (event_id % 7 <> 0) / count(*), 9) AS recall, count(*) FILTER (event_id % 7 = 0) AS missing,
 count(*) FILTER (event_id % 7 <> 0) - coalesce(any_value(best), 0) AS misplaced FROM events LEFT JOIN b ON c = user_id GROUP BY user_id""")
def _(t):
    facts = lambda grp: t.events.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("fact"), grp.alias("grp"))
    return E.partition_grade(facts(F.col("event_type")), facts(F.col("event_id") % 2).where("fact % 7 <> 0")).select("case_id", F.round("recall", 9).alias("recall"), "missing", "misplaced")


@query("a16_paired_outcomes", """WITH r AS (SELECT c_custkey AS c, c_acctbal > 1000 AS a, c_nationkey < 12 AS b FROM customer), n AS (SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (NOT a AND b) AS right_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM r)
 SELECT n."both", left_only, right_only, neither FROM n""".replace("AS both", 'AS "both"'))
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("case_id"), F.lit(0).alias("repeat"), F.explode(F.create_map(F.lit("a"), F.col("c_acctbal") > 1000, F.lit("b"), F.col("c_nationkey") < 12)).alias("protocol", "success"))
    return E.paired_outcomes(rows, "a", "b").drop("p")


@query("a17_response_outcomes", """WITH m AS (SELECT user_id AS conv_id, event_id AS msg_id, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, ts FROM events),
 n AS (SELECT *, lead(role) OVER w AS nr, lead(ts) OVER w AS nt FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY ts, msg_id)),
 o AS (SELECT CASE WHEN msg_id % 10 = 1 THEN 'negative' WHEN msg_id % 10 = 3 THEN 'positive' WHEN nr = 'user' AND nt - ts <= INTERVAL 10 MINUTE THEN 'reask' WHEN nt IS NULL THEN 'resolved' ELSE 'followup' END AS outcome FROM n WHERE role = 'assistant')
 SELECT outcome, count(*) AS n FROM o GROUP BY ALL""")
def _(t):
    messages = t.events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("msg_id"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("ts").cast("timestamp").alias("ts"))
    feedback = t.events.where("event_id % 10 IN (1, 3)").select(F.col("event_id").alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 10 == 1, "thumb_down").otherwise("rated").alias("kind"), F.when(F.col("event_id") % 10 == 3, 5).alias("rating"))
    return E.response_outcomes(messages, feedback).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("a18_outcome_distribution", "SELECT o AS outcome, count(event_id) AS n FROM (SELECT unnest(['view', 'click', 'never']) AS o) LEFT JOIN events ON event_type = o GROUP BY o")
def _(t):
    return E.outcome_distribution(t.events.select(F.col("event_type").alias("outcome")), ["view", "click", "never"])


@query("a19_cache_hit_rates", """WITH m AS (SELECT event_type AS kind, 'op' || (event_id % 2) AS operation, ['hit', 'miss', 'bypass'][event_id % 3 + 1] AS outcome FROM events)
 SELECT kind, operation, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'bypass') AS bypasses, round(count(*) FILTER (outcome = 'hit') / nullif(count(*) FILTER (outcome <> 'bypass'), 0), 6) AS hit_rate FROM m GROUP BY ROLLUP (kind, operation)""")
def _(t):
    m = t.events.select(F.col("event_type").alias("kind"), F.concat(F.lit("op"), (F.col("event_id") % 2).cast("string")).alias("operation"), F.element_at(F.array(F.lit("hit"), F.lit("miss"), F.lit("bypass")), (F.col("event_id") % 3 + 1).cast("int")).alias("outcome"), F.lit(1).cast("long").alias("n"))
    return A.cache_hit_rates(m).withColumn("hit_rate", F.round("hit_rate", 6))


@query("a20_metric_rollup", """WITH e AS (SELECT ['hits', 'load', 'wait'][event_id % 3 + 1] AS name, 'type=' || event_type AS series, value, ts FROM events)
 SELECT name, series, round(CASE name WHEN 'hits' THEN sum(value) FILTER (value > 0) WHEN 'load' THEN arg_max(value, ts) END, 4) AS value, CASE WHEN name = 'wait' THEN count(*) END AS observed FROM e GROUP BY name, series""")
def _(t):
    i = F.col("event_id") % 3
    rows = t.events.select(F.when(i == 0, "hits").when(i == 1, "load").otherwise("wait").alias("name"), F.when(i == 0, "counter").when(i == 1, "gauge").otherwise("histogram").alias("kind"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), "value", "ts")
    return A.metric_rollup(rows).select("name", "series", F.round("value", 4).alias("value"), F.aggregate(F.map_values("histogram"), F.lit(0).cast("long"), lambda s, x: s + x).alias("observed"))


@query("a20_metric_rollup_bounded", """WITH e AS (SELECT 'hits' AS name, 'page=' || lpad((event_id % 97)::VARCHAR, 2, '0') AS series, value FROM events), k AS (SELECT series FROM e GROUP BY series ORDER BY series LIMIT 20)
 SELECT series, round(sum(value) FILTER (value > 0), 4) AS value, 0 AS dropped FROM e WHERE series IN (FROM k) GROUP BY series UNION ALL SELECT NULL, NULL, count(*) FROM e WHERE series NOT IN (FROM k)""")
def _(t):
    rows = t.events.select(F.lit("hits").alias("name"), F.lit("counter").alias("kind"), F.create_map(F.lit("page"), F.lpad((F.col("event_id") % 97).cast("string"), 2, "0")).alias("labels"), "value", "ts")
    return A.metric_rollup(rows, 20).select("series", F.round("value", 4).alias("value"), "dropped")


@query("a21_tier_counts", f"{RECORDS} SELECT tier, count(*) AS entries, sum(tokens)::BIGINT AS tokens FROM (SELECT lang AS tier, active_count AS tokens FROM records) GROUP BY ROLLUP (tier)")
def _(t):
    return A.tier_counts(t.records.select(F.col("lang").alias("tier"), F.col("active_count").alias("tokens")))


@query("a22_inventory_counts", f"{RECORDS} SELECT account_id, count(*) AS files, 0::BIGINT AS skills, 0::BIGINT AS memories, count(*) AS total FROM records GROUP BY account_id")
def _(t):
    return A.inventory_counts(t.records)


@query("a23_audit_page", f"{USAGE} SELECT event_id AS id FROM usage WHERE status >= 400 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 10")
def _(t):
    return A.audit_query(usage(t).withColumnRenamed("event_id", "id"), F.col("status") >= 400, 20, 10)[0].select("id")


@query("a23_audit_stats", f"{USAGE} SELECT count(*) AS total, count(*) FILTER (status >= 400) AS errors, round(avg(latency_ms), 6) AS avg_ms FROM usage WHERE account_id = 'acc1'")
def _(t):
    return A.audit_query(usage(t).withColumnRenamed("event_id", "id"), F.col("account_id") == "acc1")[1].withColumn("avg_ms", F.round("avg_ms", 6))


@query("a24_mean_score", "SELECT round(avg(CASE WHEN value > 10 THEN value END), 6) AS mean_score FROM events")
def _(t):
    return A.mean_score(t.events.select(F.when(F.col("value") > 10, F.col("value")).alias("score"))).withColumn("mean_score", F.round("mean_score", 6))


@query("a25_model_usage", f"{USAGE} SELECT model_name AS model, provider, sum(token_count)::BIGINT AS prompt, sum(n_results)::BIGINT AS completion, sum(token_count + n_results)::BIGINT AS total, count(*)::BIGINT AS calls, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last_used FROM usage GROUP BY ROLLUP (model_name, provider)")
def _(t):
    calls = usage(t).select(F.col("model_name").alias("model"), "provider", F.col("token_count").alias("prompt"), F.col("n_results").alias("completion"), F.lit(1).cast("long").alias("calls"), F.col("ts").alias("last_used"))
    return _text(A.model_usage(calls), "last_used")


@query("t02_usage_rollup", f"{USAGE} SELECT {KEYS}, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, sum(token_count)::BIGINT AS tokens FROM usage GROUP BY ALL")
def _(t):
    u = usage(t)
    return _text(S.usage_rollup_stream(u.unionByName(u.where("event_id % 3 = 0"))), "bucket")


@query("t03_sliding_rate", f"""{USAGE}, w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE AS s, token_count FROM usage, (SELECT unnest(range(5)) AS i)) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, sum(token_count)::BIGINT AS tokens, round(sum(token_count) / 5, 6) AS per_minute FROM w GROUP BY s""")
def _(t):
    return _text(S.sliding_rate(usage(t)), "start").select("start", "tokens", F.round("per_minute", 6).alias("per_minute"))


@query("t04_session_idle", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e) SELECT user_id::VARCHAR AS session_id, strftime(date_trunc('second', max(ts) + INTERVAL 6 HOUR), '%Y-%m-%d %H:%M:%S') AS closes_at, count(*) AS messages FROM s GROUP BY user_id, n""")
def _(t):
    rows = usage(t).select(F.col("user_id").alias("session_id"), "ts", F.lit(6 * 3600).alias("idle_timeout"))
    return _text(S.session_idle(rows), "closes_at").select("session_id", "closes_at", "messages")


@query("t07_expiry", "SELECT event_id, strftime(date_trunc('minute', ts + INTERVAL 1 DAY), '%Y-%m-%d %H:%M:%S') AS bucket FROM events WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15' AND event_id % 7 < 5")
def _(t):
    rows = usage(t).select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expire_at"), F.col("n_results").alias("attempts"))
    return _text(S.expiry_batch(rows, F.lit(datetime(2024, 1, 15, tzinfo=UTC))), "bucket").select("event_id", "bucket")


@query("t10_reask", """WITH m AS (SELECT user_id, event_id, event_id % 2 = 0 AS q, ts FROM events) SELECT a.event_id AS msg_id, q.event_id AS q_id FROM m a LEFT JOIN m q ON q.q AND q.user_id = a.user_id AND q.ts >= a.ts AND q.ts <= a.ts + INTERVAL 10 MINUTE WHERE NOT a.q""")
def _(t):
    m = t.events.select(F.col("user_id").alias("conv_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    answers, questions = m.where("event_id % 2 = 1").withColumnRenamed("event_id", "msg_id"), m.where("event_id % 2 = 0").select("conv_id", F.col("event_id").alias("q_id"), F.col("ts").alias("q_ts"))
    return S.reask_stream(answers, questions).select("msg_id", "q_id")


@query("t01_microbatch", "SELECT user_id::VARCHAR AS key, count(*) // 8 AS batches FROM events GROUP BY user_id HAVING count(*) >= 8")
def _(t):
    """Events by user in batches of eight, as far as they fill one."""
    path, out, check = (fresh_path(t.spark) for _ in range(3))
    rows = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("item"))
    rows.write.parquet(path)
    own = t.spark.newSession()  # state is held outside the heap
    own.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    stream = S.microbatch(own.readStream.schema(rows.schema).parquet(path), 8, 10**8)
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out).where("why = 'count'").groupBy("key").agg(F.count(F.lit(1)).alias("batches"))


@query("t12_late_rows", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-08'")
def _(t):
    return ST.late_rows(usage(t), F.lit(datetime(2024, 1, 8, tzinfo=UTC)))[1].select("event_id")


@query("s09_sink_rows", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, CASE WHEN event_type = 'view' THEN 'retrieval.search.count' ELSE event_type END AS event_name FROM events")
def _(t):
    rows = usage(t).select("event_id", "ts", F.when(F.col("source") == "view", "search.completed").otherwise(F.col("source")).alias("event_name"))
    return S.sink_rows(rows).select("event_id", "date", "hour", "event_name")


@query("s10_kafka_rows", "SELECT 'acc' || (user_id % 4) || '|' || event_type || '|' || user_id AS key, strlen('{\"account\":\"acc' || (user_id % 4) || '\",\"resource\":\"' || event_type || '\",\"owner_account\":\"' || user_id || '\"}') > 55 AS oversized FROM events")
def _(t):
    return S.kafka_rows(usage(t).select(F.col("account_id").alias("account"), F.col("source").alias("resource"), F.col("user_id").alias("owner_account")), 55).select("key", "oversized")
