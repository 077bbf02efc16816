"""Joins over records, links, messages and snapshots (J1-J12, J14) and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.filters import any_of, uri_scope, url_filter
from .retrieve import keep_best

TEXT_FILES = r"(?i)\.(md|txt|rst|json|ya?ml|csv|html?|py|js|ts|go|rs|java|c|cc|cpp|h|sh|toml|ini|sql)$"


def index_consistency(entries: DataFrame, records: DataFrame, sample: int = 20) -> tuple[DataFrame, DataFrame]:
    """Expected (uri, level) without a record, and their count with a sample. entries (uri, is_dir, size,
    has_abstract, has_overview): a directory is expected at levels 0 and 1 if it has that text, a text file that is
    neither empty nor hidden at level 2; uris of sessions aren't."""
    name = F.regexp_extract("uri", "([^/]*)$", 1)
    own = entries.where(~F.col("uri").contains("/session/") & ~F.col("uri").startswith("ctx://session"))
    dirs = own.where("is_dir").select("uri", F.explode(F.array_compact(F.array(F.when(F.col("has_abstract"), 0), F.when(F.col("has_overview"), 1)))).alias("level"))
    files = own.where(~F.col("is_dir") & (F.col("size") > 0) & ~name.startswith(".") & name.rlike(TEXT_FILES)).select("uri", F.lit(2).alias("level"))
    missing = dirs.unionByName(files).distinct().join(records.select("uri", "level"), ["uri", "level"], "left_anti")
    first = missing.orderBy("uri", "level").limit(sample).agg(F.array_sort(F.collect_list(F.struct("uri", "level"))).alias("sample"))
    return missing, missing.agg(F.count(F.lit(1)).alias("missing")).join(F.broadcast(first))


def snapshot_diff(source: DataFrame, head: DataFrame) -> DataFrame:
    """Path and change (write, delete, unchanged) that lead from head to source; both have (path, oid)."""
    a, b = source.select("path", F.col("oid").alias("new_oid")), head.select("path", F.col("oid").alias("old_oid"))
    change = F.when(F.col("new_oid").isNull(), "delete").when(F.col("new_oid").eqNullSafe(F.col("old_oid")), "unchanged").otherwise("write")
    return a.join(b, "path", "full_outer").withColumn("change", change)


def diff_paths(base: DataFrame | None, head: DataFrame, dirs: list[str] = ()) -> DataFrame:
    """Path and status (added, modified, deleted) under the directories (all, if none); no base means all added."""
    base = head.limit(0) if base is None else base
    found = snapshot_diff(head, base).where("change <> 'unchanged'")
    status = F.when(F.col("old_oid").isNull(), "added").when(F.col("new_oid").isNull(), "deleted").otherwise("modified")
    inside = any_of([uri_scope("path", d) for d in dirs]) if dirs else F.lit(True)
    return found.where(inside).select("path", status.alias("status"))


def publish_plan(outputs: DataFrame, target: DataFrame, read_set: DataFrame) -> DataFrame:
    """What publishing outputs (path, content) over target (path, content) does, given what was read (path,
    sha): created, updated, unchanged, conflict (exists, never read), stale (changed since read, an error) or
    duplicate (path given twice, an error)."""
    sha = lambda c: F.sha2(F.col(c), 256)
    n = F.count(F.lit(1)).over(Window.partitionBy("path"))
    new = outputs.select("path", sha("content").alias("new_sha"), n.alias("n"))
    both = new.join(target.select("path", sha("content").alias("old_sha")), "path", "left").join(read_set.select("path", F.col("sha").alias("read_sha")), "path", "left")
    action = F.when(F.col("n") > 1, "duplicate").when(F.col("old_sha").isNull(), "created").when(F.col("old_sha") == F.col("new_sha"), "unchanged").when(F.col("read_sha").isNull(), "conflict").when(F.col("read_sha") != F.col("old_sha"), "stale").otherwise("updated")
    return both.select("path", "new_sha", action.alias("action")).distinct()


def namespace(uri: Column) -> Column:
    """The first two segments of a uri."""
    return F.regexp_extract(uri, "^([a-z]+://[^/]*/?[^/]*)", 1)


def resolve_links(links: DataFrame, page_uris: DataFrame) -> DataFrame:
    """Links (link_id, from_page, to_page, match_text) as uris through page_uris (page, uri): pairs in one
    namespace where a link has any, else all; without self-links and repeats."""
    both = links.join(page_uris.select(F.col("page").alias("from_page"), F.col("uri").alias("from_uri")), "from_page").join(page_uris.select(F.col("page").alias("to_page"), F.col("uri").alias("to_uri")), "to_page")
    both = both.where("from_uri <> to_uri").withColumn("same", namespace(F.col("from_uri")) == namespace(F.col("to_uri")))
    best = F.max("same").over(Window.partitionBy("link_id"))
    return both.withColumn("any", best).where("same = any").select("from_uri", "to_uri", "match_text").dropDuplicates()


def merge_links(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Links by (from_uri, to_uri, match_text): weight the largest (1.0 if none), link_type and description the
    latest given, created_at the earliest; rows have `seq` for their order."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return existing.unionByName(new, allowMissingColumns=True).groupBy("from_uri", "to_uri", "match_text").agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight"), last("link_type"), last("description"), F.min("created_at").alias("created_at"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """A row for each result in messages (conv_id, pos, parts: type, tool_id, tool_name, tool_input, tool_output,
    tool_status), with the input of the last call before it of the same id and name where it has none itself."""
    each = messages.select("conv_id", "pos", F.posexplode("parts").alias("n", "p")).where("p.type = 'tool'").select("conv_id", "pos", "n", "p.*")
    before = Window.partitionBy("conv_id", "tool_id", "tool_name").orderBy("pos", "n").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("tool_input", F.last("tool_input", ignorenulls=True).over(before)).where("tool_output IS NOT NULL").drop("n", "type")


def read_lineage(messages: DataFrame, owner: str) -> DataFrame:
    """(conv_id, uri, first_pos) of uris that tools read with status completed and no error, and that belong to
    the owner or to no user, in the order first seen."""
    calls = tool_calls(messages).where("tool_status = 'completed'")
    uris = F.concat(F.coalesce(F.from_json("tool_input", "struct<uris:array<string>>")["uris"], F.array().cast("array<string>")), F.array_compact(F.array(F.get_json_object("tool_input", "$.uri"))))
    each = calls.where(~F.coalesce(F.col("tool_output").startswith("ERROR"), F.lit(False))).select("conv_id", "pos", F.explode(uris).alias("uri")).withColumn("uri", F.regexp_replace("uri", r"[/#]+$", ""))
    mine = ~F.col("uri").startswith("ctx://user/") | uri_scope("uri", f"ctx://user/{owner}")
    return each.where(mine).groupBy("conv_id", "uri").agg(F.min("pos").alias("first_pos"))


def trajectories_of(records: DataFrame, experiences: DataFrame, start=None, end=None) -> DataFrame:
    """Memory records of level 2 that name an experience (column uri) in a tag `experience=<uri>`, updated within
    [start, end], with the total of each and the newest first by `rank`."""
    tagged = records.where("context_type = 'memory' AND level = 2").select("uri", "updated_at", F.explode("search_tags").alias("tag"))
    if start is not None:
        tagged = tagged.where(F.col("updated_at") >= F.lit(start))
    if end is not None:
        tagged = tagged.where(F.col("updated_at") <= F.lit(end))
    found = tagged.join(experiences.select(F.col("uri").alias("experience"), F.concat(F.lit("experience="), F.lower("uri")).alias("tag")), "tag")
    own = Window.partitionBy("experience")
    return found.withColumns({"total": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy(F.desc("updated_at"), "uri"))}).drop("tag")


def exclude_served(candidates: DataFrame, ledger: DataFrame, turn: Column | int, dedup_turns: int) -> DataFrame:
    """Candidates (session, uri) without those served with a body in the last dedup_turns turns; what was served
    as uri only, or at later turns, doesn't count."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    recent = ledger.where((F.col("tier") != "uri") & (F.col("turn") <= turn) & (F.col("turn") > turn - dedup_turns)).select("session", "uri")
    return candidates.join(recent, ["session", "uri"], "left_anti")


def update_ledger(ledger: DataFrame, served: DataFrame, turn: int, dedup_turns: int, most: int = 500) -> DataFrame:
    """The ledger (session, uri, tier, turn) with what was served now in place of older rows of the same uri,
    pruned to the last 4 * dedup_turns turns and the newest `most` rows of a session."""
    both = ledger.unionByName(served.select("session", "uri", "tier", F.lit(turn).cast(ledger.schema["turn"].dataType).alias("turn")))
    newest = both.groupBy("session", "uri").agg(F.max_by("tier", "turn").alias("tier"), F.max("turn").alias("turn")).where((F.col("turn") >= turn - 4 * dedup_turns) & (F.col("turn") <= turn))
    w = Window.partitionBy("session").orderBy(F.desc("turn"), "uri")
    return newest.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def target_collisions(drafts: DataFrame) -> DataFrame:
    """Output paths that several drafts (path, sources: array) want, with their distinct sources in order."""
    return drafts.groupBy("path").agg(F.count(F.lit(1)).alias("drafts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources")).where("drafts > 1")


def absolute_url(base: Column, href: Column) -> Column:
    """A link's target without fragment, resolved against its page."""
    clean = F.regexp_replace(F.trim(href), "#.*$", "")
    root = F.regexp_extract(base, "^([a-z]+://[^/]*)", 1)
    folder = F.when(base.rlike("^[a-z]+://[^/]*$"), F.concat(base, F.lit("/"))).otherwise(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), "[^/]*$", ""))
    return F.when(clean == "", None).when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), clean).when(clean.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), clean)).when(clean.startswith("/"), F.concat(root, clean)).otherwise(F.concat(folder, F.regexp_replace(clean, r"^(\./)+", "")))


def link_graph(pages: DataFrame, most: int = 500) -> DataFrame:
    """(page_id, from_url, to_url, pos) of the anchors of pages (page_id, url, html): absolute, without fragments,
    mail, script and phone links, each target once and at most `most` a page, in order."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    urls = F.array_distinct(F.filter(F.transform(F.filter(hrefs, lambda h: ~h.rlike(r"(?i)^\s*(mailto|javascript|tel|data):")), lambda h: absolute_url(F.col("url"), h)), lambda u: u.isNotNull()))
    return pages.select("page_id", F.col("url").alias("from_url"), F.posexplode(F.slice(urls, 1, most)).alias("pos", "to_url"))


def crawl_frontier(pages: DataFrame, links: DataFrame, max_depth: int, max_pages: int, **rules) -> DataFrame:
    """(url, depth) to fetch next: targets of links that pass the url filter, aren't pages (url, depth) already and
    lie at most max_depth deep, the shallowest first, max_pages in all."""
    to = links.join(pages.select(F.col("url").alias("from_url"), "depth"), "from_url").where(url_filter("to_url", **rules))
    new = to.groupBy(F.col("to_url").alias("url")).agg((F.min("depth") + 1).alias("depth")).where(F.col("depth") <= max_depth)
    return new.join(pages.select("url"), "url", "left_anti").orderBy("depth", "url").limit(max_pages)


def union_best(*candidates: DataFrame, keys: tuple[str, ...] = ("qid", "id")) -> DataFrame:
    """All candidates, each key once with its best score."""
    out = candidates[0]
    for c in candidates[1:]:
        out = out.unionByName(c)
    return keep_best(out, [*keys], tie=keys[-1])


def set_operation(a: DataFrame, b: DataFrame, how: str, key: str = "id") -> DataFrame:
    """Rows of a and b by key: intersect, exclude (a without b), xor (of one side only) or union (a's rows first)."""
    only = lambda x, y: x.join(y.select(key), key, "left_anti")
    if how == "intersect":
        return a.join(b.select(key).distinct(), key, "left_semi")
    if how == "exclude":
        return only(a, b)
    if how == "xor":
        return only(a, b).unionByName(only(b, a))
    if how == "union":
        return a.unionByName(only(b, a))
    raise ValueError(f"unknown set operation: {how}")


def exclude_uris(candidates: DataFrame, uris: list[str], most: int = 200) -> DataFrame:
    """Candidates without the first `most` of the uris, trimmed."""
    return candidates.where(~F.col("uri").isin(*[u.strip() for u in uris[:most]])) if uris else candidates
