"""Jobs composed of operators, and extension points."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegralType
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.chunks import chunk_ranges
from ..operators.joins import exclude_served, publish_plan, target_collisions, update_ledger
from ..operators.retrieve import hybrid_search, keyword_search, knn, time_decay
from ..operators.windows import pack_batches, quota_select
from ..staging import Staging


def find(records: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, fields: list[str] | None = None, alpha: float = 0.3) -> DataFrame:
    """G1: hits of queries (qid, query and/or vector) among records (uri, content, vector, ...): vector and keyword
    search under one filter; where both are asked for, each row is scored by both, so no hit is lost to a cut of either
    side. The fields are joined to the final hits only."""
    rows = (records if where is None else records.where(where)).withColumn("id", F.col("uri"))
    if {"vector", "query"} <= set(queries.columns):
        hits = hybrid_search(rows, queries, k, alpha)
    else:
        hits = (knn if "vector" in queries.columns else keyword_search)(rows, queries, k)
    return hits.select("qid", F.col("id").alias("uri"), "score", "rank").join(rows.select("uri", *(fields or [])), "uri")


#: Tiers from least to most; a text longer than an entry's share is kept from all but the bare URI.
TIERS = ("uri", "abstract", "overview", "full")
#: Upgrades once all are placed, in order: the tier aimed at, whether an entry must stay within its share, and as what
#: they are counted.
UPGRADES = (("overview", True, "overview_upgrades"), ("full", True, "full_upgrades"), ("full", False, "spare_upgrades"), ("abstract", False, "spare_upgrades"), ("overview", False, "spare_upgrades"))
COUNTED = ("overview_upgrades", "full_upgrades", "spare_upgrades")


class _Request:
    """Entries of one request that are placed, at most one a token of the budget."""

    def __init__(self, budget: int, candidates: int):
        self.budget, self.share, self.used = budget, max(1, budget // max(1, candidates) * 2), 0
        self.held: list[dict] = []
        self.bodies: set = set()

    def fits(self, row: dict, tier: str) -> bool:
        return row[tier] is not None and (tier == "uri" or row[tier] <= self.share)

    def place(self, row: dict) -> str:
        """What becomes of a candidate: the first of its tiers that fits its share and what is left."""
        separator = 1 if self.held else 0
        tier = next((t for t in row["tiers"] if self.fits(row, t) and self.used + row[t] + separator <= self.budget), None)
        if tier is None:
            return "dropped"
        if row[f"{tier}_key"] in self.bodies:
            return "deduped"
        self.bodies.add(row[f"{tier}_key"])
        self.held.append(row | {"tier": tier, "floor_tokens": row[tier], "upgrades": 0} | dict.fromkeys(COUNTED, 0))
        self.used += row[tier] + separator
        return "placed"

    def upgrade(self) -> list[dict]:
        for to, within, kind in UPGRADES:
            for e in self.held:
                now = e["tier"]
                if not TIERS.index(now) < TIERS.index(to) <= TIERS.index(e["ceiling"]) or e[to] is None or within and not self.fits(e, to):
                    continue
                old, new = e[f"{now}_key"], e[f"{to}_key"]
                if new != old and new in self.bodies or self.used + e[to] - e[now] > self.budget:
                    continue
                self.bodies.discard(old)
                self.bodies.add(new)
                self.used += e[to] - e[now]
                e["tier"], e["upgrades"], e[kind] = to, e["upgrades"] + 1, e[kind] + 1
        return self.held


def _fill(budget: int, schema: pa.Schema):
    """Over rows sorted by request, best first. What isn't placed is sent on at once."""

    def fill(batches):
        request, qid, started = None, None, False
        table = lambda rows: pa.RecordBatch.from_pylist(rows, schema=schema)
        out_row = lambda r, outcome, tier=None: {"qid": r["qid"], "uri": r["id"], "tier": tier, "tokens": r[tier] if tier else 0, "outcome": outcome} | {c: r.get(c, 0) for c in ("upgrades", "floor_tokens", *COUNTED)}
        done = lambda q: [out_row(e, "placed", e["tier"]) for e in q.upgrade()] if q else []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started or r["qid"] != qid:
                    out += done(request)
                    request, qid, started = _Request(budget, r["n"]), r["qid"], True
                if (outcome := request.place(r)) != "placed":
                    out.append(out_row(r, outcome))
            if out:
                yield table(out)
        if request:
            yield table(done(request))

    return fill


def fill_budget(candidates: DataFrame, max_tokens: int) -> DataFrame:
    """(qid, uri, tier, tokens, outcome, upgrades in all and by kind, tokens before upgrades) of all candidates of a request (qid, uri, score, start_tier,
    body_hash, and the costs full, overview, abstract, uri_cost; null where a tier has no text; optionally ceiling, the
    highest tier it may take, whole_abstract, whether its abstract is its body, and full_hash, overview_hash and
    abstract_hash of the tiers' texts). Best first, each is placed at its start tier or below; an entry's share is twice
    the even part of the budget, and a separator costs a token between entries. Of entries that would show the same
    text the best one stays, the others are `deduped`; bare URIs differ. Then what is left upgrades the best first.
    tier is null for what is deduped or dropped. Rows are placed in one pass over the sorted candidates, of any number."""
    cost = lambda c: F.col(c).cast("long")
    has = lambda c, default: F.col(c) if c in candidates.columns else default
    own = F.concat_ws(":", F.lit("uri"), F.col("uri").cast("string"))
    key = lambda tier: F.coalesce(F.concat(F.lit(f"{tier}:") if f"{tier}_hash" not in candidates.columns else F.lit("text:"), has(f"{tier}_hash", F.col("body_hash")).cast("string")), F.concat(F.lit(f"{tier}:"), own))
    late = F.col("score").isNull() | F.isnan("score")
    down = F.array(*map(F.lit, TIERS[::-1]))
    below = F.slice(down, F.array_position(down, F.col("start_tier")).cast("int"), len(TIERS))
    short = (F.col("start_tier") == "abstract") & has("whole_abstract", F.lit(False))  # its overview says less than its abstract
    tiers = F.when(short, F.array(*map(F.lit, ("abstract", "overview", "uri")))).otherwise(below)
    rows = candidates.select(
        "qid", F.col("uri").alias("id"), tiers.alias("tiers"), late.alias("late"), (-F.col("score")).alias("order"), has("ceiling", F.lit("full")).alias("ceiling"),
        cost("full").alias("full"), cost("overview").alias("overview"), cost("abstract").alias("abstract"), cost("uri_cost").alias("uri"), key("full").alias("full_key"), key("overview").alias("overview_key"), key("abstract").alias("abstract_key"), own.alias("uri_key"),
    )
    counts = rows.groupBy(F.col("qid").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    known = rows.join(counts, F.col("qid").eqNullSafe(F.col("of"))).drop("of")
    fields = f"qid {candidates.schema['qid'].dataType.simpleString()}, uri string, tier string, tokens long, outcome string, upgrades long, floor_tokens long, " + ", ".join(f"{c} long" for c in COUNTED)
    schema = to_arrow_schema(candidates.sparkSession.createDataFrame([], fields).schema)
    return known.repartition("qid").sortWithinPartitions("qid", "late", "order", "id", "full_key").mapInArrow(_fill(max_tokens, schema), fields)


def plan_stats(filled: DataFrame, max_tokens: int) -> DataFrame:
    """Of each request in the result of fill_budget: tokens used with separators, now and before any upgrade, an
    entry's share, entries returned, dropped and deduped, upgrades in all and by kind, and entries by tier."""
    placed = F.col("outcome") == "placed"
    of_tier = [F.count_if(placed & (F.col("tier") == t)).alias(t) for t in TIERS]
    found = filled.groupBy("qid").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.count_if(placed).alias("returned"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("dropped", "deduped")), *(F.sum(c).alias(c) for c in ("upgrades", *COUNTED)), F.sum("floor_tokens").alias("floor"), *of_tier)
    between = F.greatest(F.col("returned") - 1, F.lit(0))
    used, share = F.col("tokens") + between, F.greatest(F.lit(1), F.floor(F.lit(max_tokens) / F.col("n")).cast("long") * 2)
    return found.select("qid", used.alias("used_tokens"), (F.col("floor") + between).alias("floor_tokens"), share.cast("long").alias("per_entry_cap"), "returned", "dropped", "deduped", "upgrades", *COUNTED, F.struct(*TIERS).alias("tier_counts"))


def tier_costs(rows: DataFrame) -> DataFrame:
    """Costs of each tier of rows (uri, abstract, content)."""
    cost = lambda c: F.when(F.coalesce(c, F.lit("")) != "", T.token_estimate(c))
    return rows.withColumns({"full": cost(F.col("content")), "overview": cost(T.doc_overview(F.col("content"))), "abstract_cost": cost(F.col("abstract")), "uri_cost": T.token_estimate(F.col("uri")), "body_hash": F.xxhash64("content"), "full_hash": F.xxhash64("content"), "overview_hash": F.xxhash64(T.doc_overview(F.col("content"))), "abstract_hash": F.xxhash64("abstract")})


def assemble_context(requests: DataFrame, records: DataFrame, ledger: DataFrame, turn: int, max_tokens: int, quotas: dict[str, int], origin: Column, k: int = 50, dedup_turns: int = 3, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """For requests (qid, query and/or vector): find, time decay, what was served lately left out, quotas by
    context_type, token budget, rendering; the contexts (qid, context, entries, tokens) and the ledger after them."""
    hits = find(records, requests, k, where, ["updated_at", "context_type", "abstract", "content"]).withColumn("id", F.col("uri"))
    fresh = time_decay(hits, origin, 7, limit=k).drop("rank").withColumn("session", F.col("qid").cast("string"))
    left = exclude_served(fresh, ledger, turn, dedup_turns).withColumn("category", F.col("context_type"))
    chosen = tier_costs(quota_select(left, quotas, k))
    plan = fill_budget(chosen.select("qid", "uri", "score", F.lit("overview").alias("start_tier"), "body_hash", "full_hash", "overview_hash", "abstract_hash", "full", "overview", F.col("abstract_cost").alias("abstract"), "uri_cost"), max_tokens).where("tier IS NOT NULL")
    body = F.when(F.col("tier") == "full", F.col("content")).when(F.col("tier") == "overview", T.doc_overview(F.col("content"))).when(F.col("tier") == "abstract", F.col("abstract"))
    entries = plan.join(chosen.select("qid", "uri", "score", "content", "abstract"), ["qid", "uri"]).select("qid", "uri", "tier", "tokens", F.struct((-F.col("score")).alias("s"), "uri", T.render_entry(F.col("uri"), F.col("tier"), F.col("score"), body).alias("text")).alias("e"))
    contexts = entries.groupBy("qid").agg(T.render_context(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"])).alias("context"), F.count(F.lit(1)).alias("entries"), F.sum("tokens").alias("tokens"))
    return contexts, update_ledger(ledger, plan.select(F.col("qid").cast("string").alias("session"), "uri", "tier"), turn, dedup_turns)


def embed(df: DataFrame, column: str, fn: Callable[[pd.Series], pd.Series], dim: int, to: str = "vector") -> DataFrame:
    """A user's batch function adds vectors; other dimensions or numbers that aren't finite are an error."""

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield fn(b)

    v = F.col(to)
    bad = v.isNotNull() & ((F.size(v) != dim) | F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return df.withColumn(to, run(column)).withColumn(to, F.when(bad, F.raise_error(F.lit(f"vectors of {dim} finite numbers are needed")).cast("array<float>")).otherwise(v))


def score(df: DataFrame, columns: list[str], fn: Callable[..., pd.Series], to: str = "new_score") -> DataFrame:
    """A user's batch function adds scores; those that aren't finite become null."""

    @pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return fn(*cols)

    return df.withColumn(to, run(*columns)).withColumn(to, F.when(F.isnan(to) | (F.abs(to) == float("inf")), None).otherwise(F.col(to)))


def _tried(fn: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame, attempts: int) -> tuple[pd.DataFrame | None, str | None]:
    """fn(rows), or what it raised at the last attempt."""
    for n in range(1, attempts + 1):
        try:
            return fn(rows), None
        except Exception as e:  # noqa: BLE001 - whatever a user's function raises is that group's failure
            if n == attempts:
                return None, f"{type(e).__name__}: {e}"[:1000]


#: Rows of results that a task sends on at a time.
OUT_ROWS = 10_000


def _joined(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Small frames of the same columns and types put together; columns that they lack are null."""
    held: dict = {}

    def out(parts):
        whole = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        return whole.assign(**{c: None for c in columns if c not in whole})[columns]

    for f in frames:
        parts = held.setdefault((tuple(f.columns), tuple(f.dtypes)), [])
        parts.append(f)
        if len(parts) >= OUT_ROWS or len(f) >= OUT_ROWS or len(parts) % 256 == 0 and sum(map(len, parts)) >= OUT_ROWS:
            yield out(held.pop((tuple(f.columns), tuple(f.dtypes))))
    yield from map(out, held.values())


def _group_frames(frames: Iterator[tuple[np.ndarray, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """The rows of each group, from frames with the ascending numbers of their rows' groups."""
    held, last = [], None  # of the group that the frames end in so far
    for group, f in frames:
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in itertools.pairwise([0, *cuts, len(f)]):
            if held and group[lo] != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(f.iloc[lo:hi])
            last = group[lo]
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def _apply_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """As groupBy(keys).applyInPandas(fn, schema), but many small groups share a batch, in and out. Spark marks where a
    group begins, so keys of any type will do, nulls among them. Whole numbers and booleans travel without nulls, which
    would make floats or objects of a whole batch."""
    own = Window.partitionBy(*keys).orderBy(F.lit(0))
    strict = {f.name: "object" if isinstance(f.dataType, BooleanType) else "float64" for f in df.schema if isinstance(f.dataType, (BooleanType, IntegralType))}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small rows that take long aren't put together
    marked = df.repartition(parts, *keys).select("*", (F.row_number().over(own) == 1).alias("_first"))
    rows = marked.select(*(F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in strict else F.col(c) for c in df.columns), "_first", *(F.isnull(c).alias(f"_null_{c}") for c in strict))
    columns = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(frames):
        def numbered():
            started = 0
            for f in (f for f in frames if len(f)):
                group = started + f["_first"].to_numpy().cumsum()
                started = group[-1]
                yield group, f.drop(columns=["_first", *(f"_null_{c}" for c in strict if not f[f"_null_{c}"].any())])

        def with_nulls(g: pd.DataFrame) -> pd.DataFrame:
            for c, kind in strict.items():
                if f"_null_{c}" in g:
                    gone = g.pop(f"_null_{c}").eq(True).to_numpy()
                    if gone.any():
                        g[c] = g[c].astype(kind).mask(gone, None if kind == "object" else np.nan)
            return g

        yield from _joined((fn(with_nulls(g)) for g in _group_frames(numbered())), columns)

    return rows.mapInPandas(run, schema)


def reduce_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None, partial: str | None = None, most_rows: int = 100_000, attempts: int = 1) -> tuple[DataFrame, DataFrame]:
    """A user's function merges each group's rows into any number of rows (schema). A group for which it raises, at
    each of its attempts, gives no rows; it is a row of the second result (keys and error).

    With `combine` groups may have any size: parts of about most_rows rows are first combined into rows of the schema
    `partial` (keys among them), each part in a task of its own, and fn merges the combined rows of a group. Without it
    a group must fit a task. The functions run once; results are staged."""
    spark = df.sparkSession
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def guarded(step: Callable, out: list[str]):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            broken = rows["_error"].dropna() if "_error" in rows else ()
            given = rows.drop(columns=extra) if (extra := [c for c in ("_error", "_part") if c in rows]) else rows
            made, error = (None, broken.iloc[0]) if len(broken) else _tried(step, given, attempts)
            if error is None and (lost := [c for c in out if c not in made]):
                error = f"columns are missing: {lost}"
            if error is None:
                return made[out]
            return pd.DataFrame({c: [None] for c in out} | {"_error": [error]} | {f"_key_{k}": [rows[k].iloc[0]] for k in keys})

        return run

    key_types = ", ".join(f"_key_{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df
    with Staging(spark) as staged:
        if combine is not None:
            sizes = df.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.ceil(F.count(F.lit(1)) / most_rows).alias("_parts"))
            large = sizes.where("_parts > 1")
            same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
            parts = df.join(large, same, "left").withColumn("_part", F.when(F.col("_parts") > 1, F.floor(F.rand(7) * F.col("_parts"))).otherwise(F.lit(0).cast("long"))).drop("_parts", *(f"_of_{k}" for k in keys))
            parts = staged(parts)  # so that a part is the same rows however often a task runs
            own = [f.name for f in spark.createDataFrame([], partial).schema]
            if missing := [k for k in keys if k not in own]:
                raise ValueError(f"partial rows lack keys: {missing}")
            combined = _apply_groups(parts, [*keys, "_part"], guarded(combine, own), f"{partial}, _error string, {key_types}")
            rows = staged(combined.select(*(F.coalesce(k, f"_key_{k}").alias(k) if k in keys else F.col(k) for k in own), "_error"))
        done = staged(_apply_groups(rows, keys, guarded(fn, names), f"{schema}, _error string, {key_types}"), keep=True)
    return done.where("_error IS NULL").select(*names), done.where("_error IS NOT NULL").select(*(F.col(f"_key_{k}").alias(k) for k in keys), F.col("_error").alias("error"))


def field_merge_agg(patches: DataFrame, key: str, ops: dict[str, str]) -> DataFrame:
    """Patches (key, seq, fields) folded in order, by field: sum, immutable (the first value given stays), replace or
    patch (the last given stays). All are plain aggregates, so they combine before the shuffle."""
    def merged(c: str, op: str) -> Column:
        given = F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
        at = F.when(given, F.col("seq"))
        return (F.sum(F.when(given, F.col(c).cast("double"))) if op == "sum" else F.min_by(c, at) if op == "immutable" else F.max_by(c, at)).alias(c)

    return patches.groupBy(key).agg(*(merged(c, op) for c, op in ops.items()))


def corpus_build(docs: DataFrame, draft: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], target: DataFrame, read_set: DataFrame, most_chars: int = 8000, attempts: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Map (ranges of each text to drafts: path, content, source), group by path, reduce by a user's function (path,
    content, sources) and plan the publication. `draft` gets (doc_id, range_no, text) and runs once; where it raises for
    a batch, its halves are tried, down to single ranges. The second result has the paths several sources went into, the third the
    status of each source: failed (a range of it, or a group it went into, failed; none of such a group is published),
    unreferenced (nothing was made of it) or published."""
    parts = chunk_ranges(docs, most_chars).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "range_no", F.substr(F.coalesce("text", F.lit("")), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("text"))
    columns = ["path", "content", "source"]

    def drafted(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        made, error = _tried(draft, b, 1 if len(b) > 1 else attempts)
        if error is None:
            yield made[columns]
        elif len(b) == 1:
            yield pd.DataFrame({"path": [None], "content": [None], "source": [str(b.doc_id.iloc[0])], "error": [error]})
        else:
            for half in (b.iloc[: len(b) // 2], b.iloc[len(b) // 2 :]):
                yield from drafted(half.reset_index(drop=True))

    def run(batches):
        yield from _joined((x for b in batches if len(b) for x in drafted(b)), [*columns, "error"])

    with Staging(docs.sparkSession) as staged:
        drafts = staged(parts.mapInPandas(run, "path string, content string, source string, error string"), keep=True)
    good = drafts.where("error IS NULL")
    outputs, failed = reduce_groups(good.select(*columns), ["path"], merge, "path string, content string", attempts=attempts)
    sources = docs.select(F.col("doc_id").cast("string").alias("source")).unionByName(drafts.select("source")).distinct()
    broken = drafts.where("error IS NOT NULL").select("source").unionByName(good.join(failed, "path", "left_semi").select("source")).distinct().withColumn("broken", F.lit(True))
    used = good.join(outputs.select("path").distinct(), "path", "left_semi").select("source").distinct().withColumn("used", F.lit(True))
    status = F.when(F.col("broken"), "failed").when(F.col("used"), "published").otherwise("unreferenced")
    return publish_plan(outputs, target, read_set), target_collisions(good.select("path", F.array("source").alias("sources"))), sources.join(broken, "source", "left").join(used, "source", "left").select("source", status.alias("status"))


def rollup_hierarchy(files: DataFrame, depth: int, sample: int = 32, max_chars: int = 40_000, summarise: Callable[[Column], Column] = T.doc_overview) -> DataFrame:
    """Summaries (uri, summary, batches) of directories, from the deepest up: a directory sees the texts of its files
    (uri, content) and its child directories' summaries only, a fixed sample of `sample` children where it has more,
    packed into batches of max_chars. Each level is written before the next reads it, so plans don't grow with the
    depth; a task sends on at most `sample` children of a directory."""
    up = lambda uri: F.regexp_replace(uri, "/[^/]*$", "")
    with Staging(files.sparkSession) as staged:
        level = staged(files.select("uri", up("uri").alias("parent"), F.coalesce("content", F.lit("")).alias("text")).withColumn("depth", F.size(F.split("parent", "/"))))
        out, made = None, None
        deepest = level.agg(F.max("depth")).first()[0] or 0
        for d in range(deepest, max(deepest - depth, 3), -1):
            rows = level.where(F.col("depth") == d).select("uri", "parent", "text")
            if made is not None:
                rows = rows.unionByName(made.select("uri", up("uri").alias("parent"), F.col("summary").alias("text")))
            few = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("parent").orderBy(F.xxhash64("uri"), "uri"))).where(F.col("_rn") <= sample)
            few = staged(few)
            packed = pack_batches(few.select(F.col("parent").alias("session"), F.col("_rn").cast("long").alias("pos"), F.length("text").cast("long").alias("tokens"), F.lit(1).cast("long").alias("messages")), max_chars, 1 << 31).groupBy(F.col("session").alias("parent")).agg((F.max("batch") + 1).alias("batches"))
            body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uri", "text"))), lambda x: x["text"]), "\n\n")  # `sample` texts at most
            made = staged(few.groupBy("parent").agg(summarise(body).alias("summary")).join(packed, "parent").select(F.col("parent").alias("uri"), "summary", "batches"), keep=True)
            out = made if out is None else out.unionByName(made)
        return files.sparkSession.createDataFrame([], "uri string, summary string, batches long") if out is None else out


def register_sql(spark: SparkSession, **tables: DataFrame) -> None:
    """Tables as temporary views and scalar functions for SQL users."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for f in (
        "hotness(n BIGINT, t TIMESTAMP, now TIMESTAMP) RETURNS DOUBLE RETURN coalesce(1 / (1 + exp(-ln(1 + n))) * pow(2D, -greatest((unix_micros(now) - unix_micros(t)) / 86400e6 / 7, 0)), 0D)",
        "vec_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)",
        "in_subtree(uri STRING, root STRING) RETURNS BOOLEAN RETURN uri = root OR startswith(uri, root || '/')",
        "category_key(tag STRING) RETURNS STRING RETURN substring_index(tag, '=', 1)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")

