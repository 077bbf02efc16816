"""Aggregations over records, logs and evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..functions.tags import hotness
from .project import CATEGORIES, category_of

MOST_GROUPS = 10_000


def count(df: DataFrame, where: Column | None = None) -> DataFrame:
    """A1: number of rows as `_total`."""
    return (df if where is None else df.where(where)).agg(F.count(F.lit(1)).alias("_total"))


def count_by(df: DataFrame, *fields: str, gt: int | None = None, most: int = MOST_GROUPS) -> DataFrame:
    """A2: rows by fields, of list fields by element; groups above gt only; the largest `most` groups."""
    for f in fields:
        if isinstance(df.schema[f].dataType, ArrayType):
            df = df.withColumn(f, F.explode_outer(f))
    out = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("count"))
    return (out if gt is None else out.where(F.col("count") > gt)).orderBy(F.desc("count"), *fields).limit(most)


def memory_stats(df: DataFrame, now: Column) -> DataFrame:
    """A3: a row for each category (all are listed) and one for all together (null): rows, cold (< 0.2), warm and hot
    (> 0.6) ones, those not accessed for 7 and 30 days, and the oldest age in days."""
    heat = hotness(F.col("active_count"), F.col("updated_at"), now)
    age = (F.unix_micros(now) - F.unix_micros("updated_at")) / 86_400e6
    rows = df.select(category_of(F.col("uri")).alias("category"), heat.alias("heat"), age.alias("age"))
    one = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("heat") < 0.2).alias("cold"), F.count_if(F.col("heat").between(0.2, 0.6)).alias("warm"), F.count_if(F.col("heat") > 0.6).alias("hot"), F.count_if(F.col("age") > 7).alias("idle_7d"), F.count_if(F.col("age") > 30).alias("idle_30d"), F.round(F.max("age"), 1).alias("oldest_days")]
    by = rows.where("category IS NOT NULL").groupBy("category").agg(*one)
    names = df.sparkSession.createDataFrame([(n,) for _, n in CATEGORIES], "category string")
    listed = names.join(by, "category", "left").fillna(0, ["total", "cold", "warm", "hot", "idle_7d", "idle_30d"])
    return listed.unionByName(rows.agg(F.lit(None).cast("string").alias("category"), *one))


def retrieval_stats(log: DataFrame) -> DataFrame:
    """A4: of log (context_type, n_results, scores, reranked, latency_ms), a row by type and one for all (null)."""
    s = "scores"
    flat = lambda f: F.aggregate(F.col(s), F.lit(None).cast("double"), f)
    rows = log.withColumns({"s_sum": F.aggregate(s, F.lit(0.0), lambda a, x: a + x), "s_min": flat(lambda a, x: F.least(a, x)), "s_max": flat(lambda a, x: F.greatest(a, x)), "s_n": F.size(s)})
    return rows.rollup("context_type").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("n_results").alias("results"),
        F.round(F.try_divide(F.count_if(F.col("n_results") == 0), F.count(F.lit(1))), 4).alias("zero_rate"), F.try_divide(F.sum("n_results"), F.count(F.lit(1))).alias("avg_results"),
        F.try_divide(F.sum("s_sum"), F.sum("s_n")).alias("avg_score"), F.min("s_min").alias("min_score"), F.max("s_max").alias("max_score"),
        F.count_if("reranked").alias("reranked"), F.count_if(~F.col("reranked")).alias("fallback"), F.avg("latency_ms").alias("avg_ms"), F.max("latency_ms").alias("max_ms"),
    )


def io_stats(records: DataFrame) -> DataFrame:
    """A5: rows, errors and latency by io_type and operation, with totals (nulls)."""
    return records.rollup("io_type", "operation").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"), F.sum("latency_ms").alias("total_ms"), F.avg("latency_ms").alias("avg_ms"))


HOURLY = ("account_id", "user_id", "source", "token_type", "provider", "model_name")


def token_rollup(events: DataFrame, grain: str = "hour", keys: tuple[str, ...] = HOURLY) -> DataFrame:
    """Tokens by keys and hour or minute (`bucket`, UTC)."""
    return events.groupBy(*keys, F.date_trunc(grain, "ts").alias("bucket")).agg(F.sum("token_count").alias("tokens"))


def request_rollup(events: DataFrame, *keys: str) -> DataFrame:
    """Requests and results by keys and hour."""
    return events.groupBy(*keys, F.date_trunc("hour", "ts").alias("bucket")).agg(F.count(F.lit(1)).alias("requests"), F.sum("n_results").alias("results"))


def tokens_for_day(rollup: DataFrame, date: str, tz: str = "UTC") -> DataFrame:
    """Tokens by type on a viewer's local day, from UTC hours."""
    return rollup.where(F.to_date(F.from_utc_timestamp("bucket", tz)) == F.lit(date).cast("date")).groupBy("token_type").agg(F.sum("tokens").alias("tokens"))


def tokens_window(rollup: DataFrame, start, end) -> DataFrame:
    """Tokens by type in the half-open UTC window."""
    return rollup.where((F.col("bucket") >= F.lit(start)) & (F.col("bucket") < F.lit(end))).groupBy("token_type").agg(F.sum("tokens").alias("tokens"))


def _days(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def token_series(rollup: DataFrame, start: str, end: str, tz: str = "UTC") -> DataFrame:
    """Tokens of each local day from start to end, 0 where there are none."""
    by = rollup.groupBy(F.to_date(F.from_utc_timestamp("bucket", tz)).alias("day")).agg(F.sum("tokens").alias("tokens"))
    return _days(rollup, start, end).join(by, "day", "left").select("day", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def write_heatmap(rollup: DataFrame, start: str, end: str, hours: int = 1, tz: str = "UTC", value: str = "requests") -> DataFrame:
    """A10: sums of local days by blocks of hours (1 or 4)."""
    local = F.from_utc_timestamp("bucket", tz)
    rows = rollup.select(F.to_date(local).alias("day"), F.floor(F.hour(local) / hours).alias("block"), F.col(value).alias("v"))
    return rows.where(F.col("day").between(start, end)).groupBy("day", "block").agg(F.sum("v").alias("n"))


def token_rate(minutes: DataFrame) -> DataFrame:
    """Tokens a minute over the minutes given (bucket, tokens): the mean of those that have any, and the peak."""
    by = minutes.groupBy("bucket").agg(F.sum("tokens").alias("tokens"))
    top = F.max(F.struct("tokens", (-F.unix_micros("bucket")).alias("u"), "bucket"))
    return by.agg(F.sum("tokens").alias("tokens"), F.avg("tokens").alias("per_minute"), top.alias("t")).select("tokens", "per_minute", F.col("t.bucket").alias("peak_minute"), F.col("t.tokens").alias("peak"))


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact interpolated quantiles of a numeric column: by, share, value. A sketch cuts the values into about 1,024
    ranges of like size; counts of the ranges tell which of them hold the places asked for, and only values of those are
    counted one by one and put in order, so no buffer or task holds them all. `by` should have few groups. Nulls don't
    count, nor rows with a null in `by`; without values there are no rows."""
    keys = [*by, "_all"]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.lit(0).alias("_all"), F.col(value).cast("double").alias("v"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("v", [i / 1024 for i in range(1, 1024)], 10_000).alias("cuts"))
    halves = F.array(*(F.lit(1 << i) for i in range(9, -1, -1)))
    cell = F.aggregate(halves, F.lit(0), lambda at, h: at + F.when(F.get("cuts", at + h - 1) <= F.col("v"), h).otherwise(0))
    placed = rows.join(F.broadcast(cuts), keys).select(*keys, "v", cell.alias("cell"))
    each = Window.partitionBy(*keys)
    ranges = placed.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n")).withColumns({"upto": F.sum("n").over(each.orderBy("cell")), "total": F.sum("n").over(each)})
    place = F.col("share") * (F.col("total") - 1)
    ends = ranges.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    wanted = ends.where((F.col("place") >= F.col("upto") - F.col("n")) & (F.col("place") < F.col("upto"))).select(*keys, "cell", "share", "place", "total", (F.col("upto") - F.col("n")).alias("before"))
    few = placed.join(F.broadcast(wanted.select(*keys, "cell").distinct()), [*keys, "cell"], "left_semi").groupBy(*keys, "cell", "v").agg(F.count(F.lit(1)).alias("n"))
    few = few.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "cell").orderBy("v")))
    at = F.col("place") - F.col("before")
    found = few.join(F.broadcast(wanted), [*keys, "cell"]).where((at >= F.col("upto") - F.col("n")) & (at < F.col("upto")))
    weight = 1 - F.abs(F.col("place") - place)  # the nearer end counts more; a whole place has one end
    return found.groupBy(*by, "share").agg(F.sum(F.col("v") * weight).alias("value"))


def request_health(audit: DataFrame, now: Column, hours: int, approx: bool = False) -> DataFrame:
    """Requests (ts, status, latency_ms) of the last hours: number, share of 5xx, latency percentiles."""
    recent = audit.where((F.col("ts") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= now))
    rates = F.count(F.lit(1)).alias("requests"), F.try_divide(F.count_if(F.col("status") >= 500), F.count(F.lit(1))).alias("error_rate")
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if approx:
        return recent.agg(*rates, *(F.percentile_approx("latency_ms", q).alias(n) for n, q in names.items()))
    exact = quantiles(recent, "latency_ms", [*names.values()]).agg(*(F.max(F.when(F.col("share") == q, F.col("value"))).alias(n) for n, q in names.items()))
    return recent.agg(*rates).crossJoin(exact)  # one row each


#: Windows of request health in hours, and the size of its sketches: ranks are off by about 1.65 percent at most.
HEALTH_HOURS, SKETCH_K = (1, 6, 24, 168), 200


def latency_sketches(audit: DataFrame, keys: tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """Requests (ts, status, latency_ms) by keys and hour: number, 5xx errors and a KLL sketch of the latencies. Such
    tables of several days or jobs can be put together; nothing else of the requests is needed again."""
    latency = F.when(~F.isnan("latency_ms"), F.col("latency_ms").cast("double"))
    return audit.where("ts IS NOT NULL").groupBy(*keys, F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.count(latency).alias("measured"), F.kll_sketch_agg_double(latency, F.lit(k)).alias("sketch"))


def health_windows(hourly: DataFrame, now: Column, hours: tuple[int, ...] = HEALTH_HOURS, keys: tuple[str, ...] = (), shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(keys, hours, requests, error_rate, latencies at the shares as p50 and so on) of the whole hours before `now`,
    for all windows in one pass over latency_sketches tables, whose sketches merge. Windows without requests have no row."""
    end = F.date_trunc("hour", now)
    each = hourly.withColumn("hours", F.explode(F.array(*map(F.lit, hours)))).where((F.col("hour") < end) & (F.col("hour") >= end - F.make_interval(hours=F.col("hours"))))
    by = each.groupBy(*keys, "hours").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum("measured").alias("measured"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda q: F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(f"p{q * 100:g}".replace(".", "_"))
    return by.select(*keys, "hours", "requests", F.try_divide("errors", "requests").alias("error_rate"), *map(at, shares))


def cache_hit_rates(metrics: DataFrame) -> DataFrame:
    """Hits, misses and bypasses (kind, operation, outcome, n) with the hit rate (null without lookups), by both,
    by kind and in all."""
    n = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0))
    out = metrics.rollup("kind", "operation").agg(n("hit").alias("hits"), n("miss").alias("misses"), n("bypass").alias("bypasses"))
    return out.withColumn("hit_rate", F.try_divide("hits", F.col("hits") + F.col("misses")))


#: Upper bounds of histogram buckets: 1, 2 and 5 times powers of ten from 10^-2 to 5 * 10^6.
BOUNDS = [m * 10.0**e for e in range(-2, 7) for m in (1, 2, 5)]


def metric_rollup(events: DataFrame, most_series: int = 2048, approx: bool = False) -> DataFrame:
    """Series by name, kind and sorted labels of events (name, kind, labels: map, value, ts): counters add positive
    values, gauges keep the last, histograms count by BOUNDS. Series beyond most_series of a name, by order of labels,
    are summed up in one row with null labels and `dropped` rows; a task sends on at most_series of a name. With `approx`
    series beyond the bound are kept by weight instead: a sketch (approx_top_k) finds the most frequent ones."""
    label = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    rows = events.withColumns({"series": label, "b": F.array_position(F.transform(F.lit(BOUNDS), lambda x: x >= F.col("value")), F.lit(True))})
    cell = rows.groupBy("name", "kind", "series", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("pos"), F.max(F.struct("ts", "value")).alias("last"))
    by = cell.groupBy("name", "kind", "series").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("last").alias("last"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "n")))).alias("histogram"))
    if approx:
        # the sketch holds most_series entries and the least frequent are found with an error, so it is given room
        top = rows.groupBy("name").agg(F.expr(f"approx_top_k(series, {most_series}, {min(1_000_000, 8 * most_series)})").alias("top")).select("name", F.explode("top.item").alias("series"))
        chosen = by.join(top, ["name", "series"], "left_semi")
    else:
        chosen = by.withColumn("rank", F.dense_rank().over(Window.partitionBy("name").orderBy("series"))).where(F.col("rank") <= most_series)
    value = F.when(F.col("kind") == "counter", F.coalesce("pos", F.lit(0.0))).when(F.col("kind") == "gauge", F.col("last.value"))
    kept = chosen.select("name", "kind", "series", value.alias("value"), F.when(F.col("kind") == "histogram", F.col("histogram")).alias("histogram"), F.lit(0).cast("long").alias("dropped"))
    names = chosen.select(F.col("name").alias("_n"), F.col("series").alias("_s")).distinct()
    rest = by.join(names, F.col("name").eqNullSafe(F.col("_n")) & F.col("series").eqNullSafe(F.col("_s")), "left_anti").groupBy("name", "kind").agg(F.sum("n").alias("dropped"))
    rest = rest.select("name", "kind", F.lit(None).cast("string").alias("series"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("map<bigint,bigint>").alias("histogram"), "dropped")
    return kept.unionByName(rest)


def tier_counts(entries: DataFrame) -> DataFrame:
    """Entries and tokens by tier, and in all (null)."""
    return entries.rollup("tier").agg(F.count(F.lit(1)).alias("entries"), F.sum("tokens").alias("tokens"))


def inventory_counts(records: DataFrame) -> DataFrame:
    """Skills, memories, resource files and all rows by account."""
    of = lambda t: F.count_if((F.col("context_type") == t) & (F.col("level") == 2))
    return records.groupBy("account_id").agg(of("resource").alias("files"), of("skill").alias("skills"), of("memory").alias("memories"), F.count(F.lit(1)).alias("total"))


def audit_query(audit: DataFrame, where: Column, limit: int = 10, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the rows that pass, newest first, and a row of statistics over all that do."""
    rows = audit.where(where)
    stats = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") >= 400).alias("errors"), F.avg("latency_ms").alias("avg_ms"))
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit), stats


def mean_score(df: DataFrame, field: str = "score") -> DataFrame:
    """Mean without nulls, null if there are none."""
    return df.agg(F.avg(field).alias("mean_score"))


def model_usage(calls: DataFrame) -> DataFrame:
    """Tokens, calls and last use by model and provider, by model and in all. Partial results of it can be summed
    again: sums and maxima don't depend on the grouping."""
    return calls.rollup("model", "provider").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.col("prompt") + F.col("completion")).alias("total"), F.sum("calls").alias("calls"), F.max("last_used").alias("last_used"))
