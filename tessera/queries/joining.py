"""Queries of other joins, windows, sources and jobs."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..functions.filters import ASSETS
from ..functions.text import token_estimate
from ..operators import joins as J
from ..operators import sessions as Z
from ..operators import windows as W
from ..operators.similar import similar_drafts
from ..operators.chunks import chunk_ranges, pack_ranges, section_chunks
from ..plans import jobs as G
from ..sources import records as S
from ..sources import turns as C
from ..staging import fresh_path
from . import RECORDS, query

D = "doc_id % 20"


@query("j01_index_consistency", f"{RECORDS} SELECT uri, level FROM (SELECT uri, 2 AS level FROM records WHERE content <> '' UNION ALL SELECT DISTINCT parent_uri, 0 FROM records) EXCEPT (SELECT uri, level FROM records WHERE active_count < 40 AND content <> '')")
def _(t):
    files = t.records.select("uri", F.lit(False).alias("is_dir"), F.length("content").alias("size"), F.lit(False).alias("has_abstract"), F.lit(False).alias("has_overview"))
    dirs = t.records.select(F.col("parent_uri").alias("uri"), F.lit(True).alias("is_dir"), F.lit(0).alias("size"), F.lit(True).alias("has_abstract"), F.lit(False).alias("has_overview")).distinct()
    return J.index_consistency(files.unionByName(dirs), t.records.where("active_count < 40"))[0]


def _head(t):
    """A changed copy of the documents: of each 20, one has another text, one is gone, and one is under another path."""
    d = F.col("doc_id") % 20
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    new = t.documents.select(path.alias("path"), F.sha2("text", 256).alias("oid"))
    old = t.documents.where(d != 1).select(F.when(d == 2, F.concat(path, F.lit(".old"))).otherwise(path).alias("path"), F.sha2(F.when(d == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("oid"))
    return new, old


@query("j02_snapshot_diff", f"""SELECT 'docs/' || lang || '/' || doc_id AS path, CASE WHEN {D} IN (0, 1, 2) THEN 'write' ELSE 'unchanged' END AS change FROM documents
 UNION ALL SELECT 'docs/' || lang || '/' || doc_id || '.old', 'delete' FROM documents WHERE {D} = 2""")
def _(t):
    return J.snapshot_diff(*_head(t)).select("path", "change")


@query("j03_diff_paths", f"""SELECT 'docs/' || lang || '/' || doc_id AS path, CASE WHEN {D} = 0 THEN 'modified' ELSE 'added' END AS status FROM documents WHERE {D} IN (0, 1, 2) AND lang IN ('en', 'de')
 UNION ALL SELECT 'docs/' || lang || '/' || doc_id || '.old', 'deleted' FROM documents WHERE {D} = 2 AND lang IN ('en', 'de')""")
def _(t):
    new, old = _head(t)
    return J.diff_paths(old, new, ["docs/en", "docs/de/"])


@query("j04_publish_plan", "SELECT doc_id::VARCHAR AS path, CASE doc_id % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'conflict' WHEN 3 THEN 'stale' ELSE 'updated' END AS action FROM documents")
def _(t):
    d, path = F.col("doc_id") % 6, F.col("doc_id").cast("string").alias("path")
    outputs = t.documents.select(path, F.when(d == 1, F.col("text")).otherwise(F.concat("text", F.lit("+"))).alias("content"))
    target = t.documents.where(d != 0).select(path, F.col("text").alias("content"))
    read = t.documents.where(d.isin(3, 4, 5)).select(path, F.sha2(F.when(d == 3, F.lit("before")).otherwise(F.col("text")), 256).alias("sha"))
    return J.publish_plan(outputs, target, read).select("path", "action")


@query("j05_resolve_links", """WITH p AS (SELECT c_custkey // 3 AS page, 'ctx://n' || (c_custkey % 3) || '/a/' || c_custkey AS uri, 'ctx://n' || (c_custkey % 3) || '/a' AS ns FROM customer),
 l AS (SELECT DISTINCT o_orderkey AS id, o_custkey // 3 AS f, (o_custkey + 4) // 3 AS g, o_orderpriority AS m FROM orders), b AS (SELECT id, x.uri AS from_uri, y.uri AS to_uri, m AS match_text, x.ns = y.ns AS same FROM l JOIN p x ON x.page = f JOIN p y ON y.page = g WHERE x.uri <> y.uri)
 SELECT DISTINCT from_uri, to_uri, match_text FROM (SELECT *, max(same) OVER (PARTITION BY id) AS best FROM b) WHERE same = best""")
def _(t):
    links = t.orders.select(F.col("o_orderkey").alias("link_id"), F.floor(F.col("o_custkey") / 3).alias("from_page"), F.floor((F.col("o_custkey") + 4) / 3).alias("to_page"), F.col("o_orderpriority").alias("match_text"))
    pages = t.customer.select(F.floor(F.col("c_custkey") / 3).alias("page"), F.concat(F.lit("ctx://n"), (F.col("c_custkey") % 3).cast("string"), F.lit("/a/"), F.col("c_custkey").cast("string")).alias("uri"))
    return J.resolve_links(links, pages)


@query("j06_merge_links", """WITH l AS (SELECT o_custkey AS from_uri, o_orderpriority AS to_uri, o_orderstatus AS match_text, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS weight, CASE WHEN o_orderkey % 2 = 0 THEN 't' || o_orderkey END AS link_type, o_orderkey AS seq FROM orders)
 SELECT from_uri, to_uri, match_text, coalesce(max(weight), 1.0) AS weight, arg_max(link_type, seq) FILTER (link_type IS NOT NULL) AS link_type, min(seq) AS created_at FROM l GROUP BY ALL""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("from_uri"), F.col("o_orderpriority").alias("to_uri"), F.col("o_orderstatus").alias("match_text"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("weight"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("link_type"), F.lit(None).cast("string").alias("description"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("created_at"))
    return J.merge_links(o.where("seq % 5 < 3"), o.where("seq % 5 >= 3")).drop("description")


@query("j09_trajectories", f"{RECORDS}, x AS (SELECT doc_id, updated_at, 'ctx://x/' || (doc_id % 9) AS experience FROM records WHERE updated_at >= TIMESTAMP '2024-01-03' AND updated_at <= TIMESTAMP '2024-01-30') SELECT experience, doc_id, count(*) OVER (PARTITION BY experience) AS total, row_number() OVER (PARTITION BY experience ORDER BY updated_at DESC) AS rank FROM x")
def _(t):
    experience = F.concat(F.lit("ctx://x/"), (F.col("doc_id") % 9).cast("string"))
    memories = t.records.withColumns({"context_type": F.lit("memory"), "search_tags": F.array(F.concat(F.lit("experience="), experience), F.lit("k=v"))})
    found = J.trajectories_of(memories, t.records.select(experience.alias("uri")).distinct(), datetime(2024, 1, 3, tzinfo=UTC), datetime(2024, 1, 30, tzinfo=UTC))
    return found.select("experience", F.regexp_extract("uri", r"(\d+)\.md$", 1).cast("long").alias("doc_id"), "total", "rank")


@query("j10_exclude_served", "SELECT DISTINCT user_id::VARCHAR AS session, event_type AS uri FROM events EXCEPT SELECT user_id::VARCHAR, event_type FROM events WHERE event_id % 4 <> 0 AND event_id % 30 <= 20 AND event_id % 30 > 15")
def _(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("uri"), F.when(F.col("event_id") % 4 == 0, "uri").otherwise("full").alias("tier"), (F.col("event_id") % 30).alias("turn"))
    return J.exclude_served(rows.select("session", "uri").distinct(), rows, 20, 5)


@query("j11_update_ledger", """WITH l AS (SELECT user_id::VARCHAR AS session, event_type AS uri, (event_id % 30)::INT AS turn FROM events UNION ALL SELECT DISTINCT user_id::VARCHAR, 'view', 30 FROM events) SELECT session, uri, max(turn) AS turn FROM l GROUP BY ALL HAVING max(turn) >= 10""")
def _(t):
    ledger = t.events.select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("uri"), F.lit("full").alias("tier"), (F.col("event_id") % 30).cast("int").alias("turn"))
    served = ledger.select("session", F.lit("view").alias("uri"), "tier").distinct()
    return J.update_ledger(ledger, served, 30, 5).select("session", "uri", "turn")


@query("j12_target_collisions", "SELECT lang || '/' || source AS path, count(*) AS drafts, list_sort(list_distinct(list(doc_id::VARCHAR))) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return J.target_collisions(t.documents.select(F.concat_ws("/", "lang", "source").alias("path"), F.array(F.col("doc_id").cast("string")).alias("sources")))


@query("j13_similar_drafts", """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.4),
 reach(id, other) AS (SELECT a, b FROM links UNION SELECT id, b FROM reach JOIN links ON other = a)
 SELECT vec_id AS id, least(vec_id, min(other)) AS component FROM embeddings LEFT JOIN reach ON id = vec_id GROUP BY vec_id""")
def _(t):
    return similar_drafts(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 0.4)


#: Targets u of the anchors of pages, for DuckDB.
LINKS = r"""WITH h AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hs FROM pages),
 e AS (SELECT page_id, url, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM h), c AS (SELECT page_id, url, i, regexp_replace(trim(h), '#.*$', '') AS h FROM e WHERE NOT regexp_matches(h, '(?i)^\s*(mailto|javascript|tel|data):')),
 a AS (SELECT page_id, i, CASE WHEN h = '' THEN NULL WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN h WHEN h LIKE '//%' THEN regexp_extract(url, '^([a-z]+:)', 1) || h WHEN h LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/]*)', 1) || h
  ELSE CASE WHEN regexp_matches(url, '^[a-z]+://[^/]*$') THEN url || '/' ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') END || regexp_replace(h, '^(\./)+', '') END AS u FROM c)"""


@query("j14_link_graph", f"{LINKS} SELECT page_id, u AS to_url FROM a WHERE u IS NOT NULL GROUP BY ALL")
def _(t):
    return J.link_graph(t.pages).select("page_id", "to_url")


@query("j14_crawl_frontier", rf"""{LINKS} SELECT DISTINCT u AS url, 1 AS depth FROM a WHERE regexp_matches(u, '^(?i:https?)://[^/?#]')
 AND NOT regexp_matches(regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '{ASSETS}') AND u NOT IN (SELECT url FROM pages) ORDER BY url LIMIT 1000""")
def _(t):
    return J.crawl_frontier(t.pages.select("url", F.lit(0).alias("depth")), J.link_graph(t.pages), 2, 1000)


@query("w02_merge_packages", "SELECT uri FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, uri) AS n FROM (SELECT 'ctx://user/u/skills/s' || (event_id % 40) || '/f' || event_id || '.md' AS uri, event_id % 40 AS r, value AS score FROM events WHERE event_id % 2 = 0)) WHERE n = 1 UNION ALL SELECT 'ctx://resources/' || event_id FROM events WHERE event_id % 2 = 1")
def _(t):
    skill = F.col("event_id") % 2 == 0
    uri = F.when(skill, F.concat(F.lit("ctx://user/u/skills/s"), (F.col("event_id") % 40).cast("string"), F.lit("/f"), F.col("event_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("ctx://resources/"), F.col("event_id").cast("string")))
    return W.merge_packages(t.events.select(uri.alias("uri"), F.when(skill, "skill").otherwise("resource").alias("context_type"), F.lit(2).alias("level"), F.col("value").alias("score"))).select("uri")


@query("w03_canonical_records", "SELECT min(o_orderkey) AS id FROM orders GROUP BY o_custkey, o_orderstatus")
def _(t):
    return W.canonical_records(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uri"), F.col("o_orderstatus").alias("level")))[0].select("id")


@query("w04_dedup_signature", r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))")
def _(t):
    return W.dedup_signature(t.documents, "text", "doc_id").select("doc_id")


@query("w05_quota_select", """WITH c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 1 ELSE 0 END AS q FROM events)
 SELECT user_id AS qid, event_id AS id, q AS by_quota FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY q DESC, value DESC, event_id) AS n FROM c) WHERE n <= 8""")
def _(t):
    rows = t.events.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.col("value").alias("score"))
    return W.quota_select(rows, {"view": 3, "click": 1}, 8).select("qid", "id", "by_quota")


@query("w06_turns", """WITH t AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)
 SELECT conv_id, turn AS pos, turn_no::BIGINT AS turn_no, (sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn_no ORDER BY turn))::BIGINT AS step_no FROM t""")
def _(t):
    return Z.turns(t.conversations.select("conv_id", F.col("turn").alias("pos"), "role", F.lit(False).alias("is_tool"))).select("conv_id", "pos", "turn_no", "step_no")


#: Messages with turns, steps and tokens, for DuckDB.
TURNS = """m AS (SELECT conv_id, turn AS pos, role, coalesce(text, '') AS text, ceil(len(coalesce(text, '')) / 4)::BIGINT AS tokens, role = 'user' AS anchor, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations),
 s AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id, turn_no ORDER BY pos) AS step_no FROM m)"""


def _messages(t):
    text = F.coalesce("text", F.lit(""))
    return Z.turns(t.conversations.select("conv_id", F.col("turn").alias("pos"), "role", F.lit(False).alias("is_tool"), text.alias("text"), token_estimate(text).alias("tokens")))


@query("w07_pack_batches", f"""WITH RECURSIVE {TURNS},
 o AS (SELECT *, CASE WHEN anchor THEN -1 ELSE step_no END AS part, sum(tokens) OVER t > 300 OR count(*) OVER t > 2 AS opened FROM s WINDOW t AS (PARTITION BY conv_id, turn_no)),
 l AS (SELECT *, CASE WHEN NOT opened THEN 'turn' WHEN part = -1 OR sum(tokens) OVER p > 300 OR count(*) OVER p > 2 THEN 'message' ELSE 'step' END AS level FROM o WINDOW p AS (PARTITION BY conv_id, turn_no, part)),
 u AS (SELECT conv_id, min(pos) AS pos, level, sum(tokens)::BIGINT AS tokens, count(*) AS messages FROM l GROUP BY conv_id, turn_no, level, CASE WHEN level <> 'turn' THEN part END, CASE WHEN level = 'message' THEN pos END),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i, tokens > 300 OR messages > 2 AS oversized FROM u),
 f AS (SELECT *, 0 AS batch, tokens AS held, messages AS many FROM n WHERE i = 1
  UNION ALL SELECT n.*, CASE WHEN cut THEN batch + 1 ELSE batch END, CASE WHEN cut THEN n.tokens ELSE held + n.tokens END, CASE WHEN cut THEN n.messages ELSE many + n.messages END
   FROM (SELECT f.conv_id AS c, f.i AS prev, f.batch, f.held, f.many FROM f) JOIN n ON n.conv_id = c AND n.i = prev + 1, LATERAL (SELECT n.oversized OR held + n.tokens > 300 OR many + n.messages > 2 AS cut))
 SELECT conv_id AS session, pos, level, tokens, messages, batch::BIGINT AS batch, oversized FROM f""")
def _(t):
    return Z.extraction_batches(_messages(t), 300, 2)


@query("w08_retain", f"""WITH {TURNS},
 t AS (SELECT conv_id, turn_no, sum(tokens) AS size, sum(CASE WHEN anchor THEN tokens END) AS anchor_tokens, max(CASE WHEN NOT anchor THEN step_no END) AS last_step FROM s GROUP BY ALL),
 k AS (SELECT *, row_number() OVER w AS back, sum(size) OVER w AS upto FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no DESC)),
 f AS (SELECT *, CASE WHEN back <= 2 AND upto <= 250 THEN 'keep' WHEN back > 1 OR anchor_tokens IS NULL THEN 'archive' WHEN last_step IS NULL THEN 'keep' ELSE 'split' END AS fate FROM k),
 p AS (SELECT s.conv_id, s.turn_no, s.step_no, sum(s.tokens) AS step, greatest(250 - any_value(f.anchor_tokens), 0) AS room FROM s JOIN f USING (conv_id, turn_no) WHERE fate = 'split' AND NOT anchor GROUP BY ALL),
 q AS (SELECT *, sum(step) OVER (PARTITION BY conv_id ORDER BY step_no DESC) AS behind, step_no = max(step_no) OVER (PARTITION BY conv_id) AS at_end FROM p),
 r AS (SELECT s.conv_id, s.pos, s.text, s.tokens, s.anchor, f.fate, CASE WHEN q.step IS NULL THEN NULL WHEN behind <= room THEN 'keep' WHEN at_end THEN 'preview' ELSE 'archive' END AS own, floor(s.tokens * room / greatest(q.step, 1))::BIGINT AS share
  FROM s JOIN f USING (conv_id, turn_no) LEFT JOIN q ON q.conv_id = s.conv_id AND q.turn_no = s.turn_no AND q.step_no = s.step_no AND NOT s.anchor),
 g AS (SELECT *, 'archive' AS place, fate = 'split' AND NOT anchor AS checkpoint, NULL::BIGINT AS preview_tokens FROM r WHERE fate = 'archive' OR fate = 'split' AND (anchor OR own <> 'keep')
  UNION ALL SELECT *, 'keep', false, CASE WHEN own = 'preview' THEN share END FROM r WHERE fate = 'keep' OR fate = 'split' AND (anchor OR own <> 'archive'))
 SELECT conv_id, pos, place, checkpoint, preview_tokens, sha256(CASE WHEN preview_tokens IS NULL OR tokens <= preview_tokens THEN text WHEN preview_tokens <= 2 THEN left(text, preview_tokens)
  ELSE left(text, floor((4 * preview_tokens - 8) * 0.75)::INT) || chr(10) || '...' || chr(10) || right(text, (4 * preview_tokens - 8 - floor((4 * preview_tokens - 8) * 0.75))::INT) END) AS text_sha256 FROM g""")
def _(t):
    return Z.retain(_messages(t), 2, 250).select("conv_id", "pos", "place", "checkpoint", "preview_tokens", F.sha2("text", 256).alias("text_sha256"))


@query("w09_fill_budget", None)
def _(t):
    rows = t.events.select(F.col("user_id").alias("qid"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("uri"), F.col("value").alias("score"), F.lit("overview").alias("start_tier"), F.xxhash64("event_id").alias("body_hash"), (F.col("event_id") % 90 + 20).alias("full"), (F.col("event_id") % 30 + 5).alias("overview"), F.lit(3).cast("long").alias("abstract"), token_estimate(F.col("event_type")).alias("uri_cost"))
    return G.fill_budget(rows, 400)


@query("w10_grep", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents), a AS (SELECT *, coalesce(lag(line) OVER w, '') AS before, coalesce(lead(line) OVER w, '') AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)) SELECT doc_id, n, before, after FROM a WHERE regexp_matches(line, '[0-9]{3}')")
def _(t):
    one = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return W.grep(t.documents.select(F.col("doc_id").alias("path"), "text"), "[0-9]{3}", 1, 1).select(F.col("path").alias("doc_id"), F.col("n").cast("long").alias("n"), one(F.col("before")).alias("before"), one(F.col("after")).alias("after"))


@query("w11_page", "SELECT c_nationkey, c_custkey, true AS has_more FROM customer WHERE (c_nationkey, c_custkey) > (4, 0) ORDER BY c_nationkey, c_custkey LIMIT 25")
def _(t):
    return W.page(t.customer.select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], 25, (4, 0))


@query("w12_freshness", """WITH c AS (SELECT user_id AS parent, count(*) AS total, count(*) FILTER (event_type = 'click') AS pending, max(event_type = 'error') AS changed FROM events GROUP BY 1) SELECT parent, CASE WHEN NOT changed THEN 'noop' WHEN total <= 5 OR pending >= total * 0.2 THEN 'refresh' ELSE 'mark' END AS action FROM c""")
def _(t):
    return W.freshness(t.events.select(F.col("user_id").alias("parent"), (F.col("event_type") == "click").alias("pending"), (F.col("event_type") == "error").alias("changed"), F.lit(False).alias("first_time"))).select("parent", "action")


@query("s02_parse_turns", "SELECT CASE WHEN event_type = 'click' THEN 'user' WHEN event_type = 'view' THEN 'assistant' END AS role, event_id::VARCHAR AS text, user_id::VARCHAR AS session_id FROM events WHERE event_type IN ('click', 'view')")
def _(t):
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "assistant").otherwise("other")
    lines = t.events.select(F.when(F.col("event_type") == "error", "{broken").otherwise(F.to_json(F.struct(role.alias("role"), F.col("event_id").cast("string").alias("content"), F.col("user_id").cast("string").alias("session_id")))).alias("value"))
    return C.parse_lines(lines, "flat").where("NOT malformed").select("role", "text", "session_id")


@query("s05_normalize_turns", r"SELECT conv_id, turn, CASE WHEN lower(role) = 'user' THEN 'user' ELSE 'assistant' END AS role, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text FROM conversations WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def _(t):
    return C.normalize_turns(t.conversations).select("conv_id", "turn", "role", F.sha2("text", 256).alias("text"))


@query("s06_gated_pages", "SELECT page_id, CASE WHEN strlen(html) > 3000 THEN 'too_large' END AS rejected FROM pages")
def _(t):
    return S.gated_pages(t.pages, 3000).select("page_id", "rejected")


@query("s07_manifest", f"{RECORDS} SELECT uri || '#' || level AS path, context_type AS kind, strlen(content) AS size, sha256(content) AS sha256 FROM records")
def _(t):
    return S.manifest_of(t.records)


@query("s11_inventory", "SELECT 'customer' AS kind, false AS marker, count(*) AS n FROM customer UNION ALL SELECT 'customer', true, 1 UNION ALL SELECT 'nation', false, count(*) FROM nation UNION ALL SELECT 'nation', true, 1")
def _(t):
    return S.inventory(customer=t.customer, nation=t.nation).groupBy("kind", "marker").agg(F.count(F.lit(1)).alias("n"))


def _last(of: str, what: str, size: int) -> str:
    """Place (from 0) of the last occurrence of `what`, whose characters are written backwards, in a text; null if none."""
    return f"CASE WHEN strpos(reverse({of}), {what}) > 0 THEN len({of}) - strpos(reverse({of}), {what}) + 1 - {size} END"


#: Cuts of texts into ranges of 1,000 characters, for DuckDB: the parts of a range in which headings, blank lines and
#: line ends are looked for, the last of each, and where the range stops.
CUTS = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 r(doc_id, range_no, start, stop) AS (SELECT doc_id, -1, 0, 0 FROM d
  UNION ALL SELECT doc_id, range_no + 1, stop, CASE WHEN len(text) - stop <= 1000 THEN len(text) ELSE coalesce(greatest(h + 1, b + 2), CASE WHEN l IS NOT NULL THEN stop + 1 + l + 1 END, stop + 1000) END FROM
   (SELECT *, stop + 500 + {_last("s1", "'#' || chr(10)", 2)} AS h, stop + 500 + {_last("s2", "chr(10) || chr(10)", 2)} AS b, {_last("s3", "chr(10)", 1)} AS l FROM
    (SELECT r.*, text, substr(text, stop + 501, 500) AS s1, substr(text, stop + 501, 499) AS s2, substr(text, stop + 2, 999) AS s3 FROM r JOIN d USING (doc_id) WHERE range_no < 0 OR stop < len(text))))"""


@query("x16_chunk_ranges", f"{CUTS} SELECT doc_id, range_no::BIGINT AS range_no, start::BIGINT AS start, stop::BIGINT AS stop FROM r WHERE range_no >= 0")
def _(t):
    return chunk_ranges(t.documents, 1000).select("doc_id", "range_no", "start", "stop")


@query("x17_section_chunks", None)
def _(t):
    return section_chunks(t.documents).select("doc_id", "chunk_no", F.length("chunk").alias("chars"))


@query("x18_pack_ranges", None)
def _(t):
    return pack_ranges(chunk_ranges(t.documents, 1000), 4000)


@query("g04_rollup_hierarchy", f"""{RECORDS}, a AS (SELECT parent_uri AS uri, sha256(string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY uri)) AS summary FROM records GROUP BY parent_uri),
 b AS (SELECT regexp_replace(uri, '/[^/]*$', '') AS uri, sha256(string_agg(summary, chr(10) || chr(10) ORDER BY uri)) AS summary FROM a GROUP BY 1)
 SELECT uri, summary FROM a UNION ALL SELECT uri, summary FROM b""")
def _(t):
    return G.rollup_hierarchy(t.records.select("uri", "content"), 2, sample=1 << 30, summarise=lambda body: F.sha2(body, 256)).select("uri", "summary")


@query("g04_rollup_batches", None)
def _(t):
    return G.rollup_hierarchy(t.records.select("uri", "content"), 3).select("uri", "batches")


@query("g08_field_merge", """SELECT user_id, round(sum(value), 3) AS value, arg_min(event_type, event_id) AS first_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id""")
def _(t):
    return G.field_merge_agg(t.events.select("user_id", F.col("event_id").alias("seq"), "value", F.col("event_type").alias("first_type"), "props"), "user_id", {"value": "sum", "first_type": "immutable", "props": "replace"}).withColumn("value", F.round("value", 3))


@query("u01_union_best", "SELECT qid, id, max(score) AS score FROM (SELECT user_id AS qid, event_id % 100 AS id, value AS score FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id % 100, 2 * value FROM events WHERE event_type <> 'view') GROUP BY ALL")
def _(t):
    side = lambda where, score: t.events.where(where).select(F.col("user_id").alias("qid"), (F.col("event_id") % 100).alias("id"), score.alias("score"))
    return J.union_best(side("event_type = 'view'", F.col("value")), side("event_type <> 'view'", 2 * F.col("value"))).select("qid", "id", "score")


@query("u04_tree_difference", "SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS path, CASE WHEN a.doc_id IS NULL THEN 'delete' WHEN a.x IS NOT DISTINCT FROM b.x THEN 'unchanged' ELSE 'write' END AS change FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE upper(text) END AS x FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, text AS x FROM documents WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id")
def _(t):
    tree = lambda where, text: t.documents.where(where).select(F.col("doc_id").cast("string").alias("path"), F.sha2(text, 256).alias("oid"))
    new = tree("doc_id % 5 <> 0", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.upper("text")))
    return J.snapshot_diff(new, tree("doc_id % 7 <> 0", F.col("text"))).select("path", "change")


@query("s01_read_records", f"{RECORDS} SELECT uri, level, content, active_count FROM records")
def _(t):
    path = fresh_path(t.spark)
    S.write_records(t.records.drop("doc_id", "lang", "source"), path)
    return S.read_records(t.spark, path).select("uri", "level", "content", "active_count")


@query("s08_import_snapshot", f"{RECORDS} SELECT replace(uri, 'ctx://resources/en', 'ctx://resources/copy') AS uri, content FROM records WHERE lang = 'en'")
def _(t):
    path = fresh_path(t.spark)
    records = t.records.where("lang = 'en'").drop("doc_id", "lang", "source").withColumn("vector", F.lit(None).cast("array<float>"))
    S.export_snapshot(records, path)
    return S.import_snapshot(t.spark, path, records.limit(0), "ctx://resources/en", "ctx://resources/copy").select("uri", "content")


@query("s03_stream_turn_logs", "SELECT conv_id::VARCHAR AS session_id, role, text FROM conversations WHERE role IN ('user', 'assistant')")
def _(t):
    """Conversations as JSON lines, read by a stream in several files, written by a sink of ours."""
    from ..streaming import streams as R

    logs, out, check = (fresh_path(t.spark) for _ in range(3))
    t.conversations.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"))).alias("value")).repartition(3).write.text(logs)
    stream = C.stream_turn_logs(t.spark, logs, "flat", files_a_batch=2)
    R.custom_sink(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), check).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("session_id", "role", "text")


@query("t08_dedup_append", "SELECT conv_id, turn, role FROM conversations")
def _(t):
    """Conversations in three overlapping batches, each row once."""
    from ..streaming.tables import Appends

    rows = t.conversations.select("conv_id", "turn", "role")
    log = Appends(t.spark, fresh_path(t.spark), ("conv_id", "turn"))
    for i, where in enumerate(("conv_id % 3 <> 0", "conv_id % 3 <> 1", "conv_id % 3 <> 0")):
        log.append(rows.where(where), f"b{i}")
    return log.read(rows.schema).drop("batch")


@query("t13_stream_ingest", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT conv_id::VARCHAR AS session_id, count(*) AS messages, sum(coalesce(len(text), 0))::BIGINT AS tokens FROM p GROUP BY conv_id HAVING count(*) >= 4""")
def _(t):
    """Records of the conversations that reach four messages, by session."""
    from ..streaming.tables import Ingest, stream_ingest

    turns, path, check = (fresh_path(t.spark) for _ in range(3))
    rows = t.conversations.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("pos"), "role", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("turn")).alias("ts"), F.length("text").cast("long").alias("tokens"))
    rows.coalesce(1).write.parquet(turns)
    stream = t.spark.readStream.schema(rows.schema).parquet(turns)
    stream_ingest(stream, path, check, tokens=1 << 40, messages=4).trigger(availableNow=True).start().awaitTermination()
    return Ingest(t.spark, path).records().groupBy("session_id").agg(F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"))


@query("u03_exclude_uris", f"{RECORDS} SELECT uri FROM records WHERE uri NOT IN ('ctx://resources/en/src1/1.md', 'ctx://resources/en/src2/2.md')")
def _(t):
    return J.exclude_uris(t.records.select("uri"), [" ctx://resources/en/src1/1.md", "ctx://resources/en/src2/2.md "])


def _tools(t):
    """Events as tool messages: an even one calls, the odd one after it has the result."""
    call = F.col("event_id") % 2 == 0
    part = F.struct(
        F.lit("tool").alias("type"), F.floor(F.col("event_id") / 2).cast("string").alias("tool_id"), F.lit("read").alias("tool_name"), F.when(call, F.concat(F.lit('{"uri":"ctx://r/'), (F.col("event_id") % 1000).cast("string"), F.lit('"}'))).alias("tool_input"),
        F.when(~call, F.when(F.col("event_type") == "error", "ERROR").otherwise("text")).alias("tool_output"), F.when(F.col("event_type") == "click", "failed").otherwise("completed").alias("tool_status"),
    )
    return t.events.select((F.floor(F.col("event_id") / 2) % 150).alias("conv_id"), F.col("event_id").alias("pos"), F.array(part).alias("parts"))


@query("j07_tool_calls", """SELECT event_id AS pos, '{"uri":"ctx://r/' || ((event_id - 1) % 1000) || '"}' AS tool_input FROM events WHERE event_id % 2 = 1""")
def _(t):
    return J.tool_calls(_tools(t)).select("pos", "tool_input")


@query("j08_read_lineage", "SELECT event_id // 2 % 150 AS conv_id, 'ctx://r/' || ((event_id - 1) % 1000) AS uri, min(event_id) AS first_pos FROM events WHERE event_id % 2 = 1 AND event_type NOT IN ('error', 'click') GROUP BY ALL")
def _(t):
    return J.read_lineage(_tools(t), "me")


@query("s04_read_turn_table", "SELECT id FROM (SELECT o_orderkey AS id, min((o_orderpriority <> '5-LOW')::INT) OVER (ORDER BY o_custkey, o_orderkey) AS ready FROM (SELECT * FROM orders WHERE (o_custkey, o_orderkey) > (10, 0) ORDER BY o_custkey, o_orderkey LIMIT 100)) WHERE ready = 1")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("time_created"), F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") != "5-LOW").alias("complete"))
    return C.read_turn_table(rows, (10, 0)).select("id")


@query("p05_sanitize_text", "SELECT doc_id, sha256(text || chr(65533)) AS value FROM documents")
def _(t):
    from ..operators.project import sanitize_text

    return t.documents.withColumn("raw", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).select("doc_id", F.sha2(sanitize_text("raw"), 256).alias("value"))


@query("p08_skill_root", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ctx://user/u/skills/s' || user_id ELSE '' END AS root FROM events")
def _(t):
    from ..operators.project import skill_root

    name = F.when(F.col("event_id") % 3 == 0, F.lit("skills/s")).when(F.col("event_id") % 3 == 1, F.lit("skills/.s")).otherwise(F.lit("notes/s"))
    return t.events.select("event_id", skill_root(F.concat(F.lit("ctx://user/u/"), name, F.col("user_id").cast("string"), F.lit("/SKILL.md#a"))).alias("root"))


@query("t06_pending_changes", "SELECT event_type AS parent, count(*) AS pending FROM events GROUP BY 1")
def _(t):
    from ..streaming.streams import pending_changes

    return pending_changes(t.events.select(F.col("event_type").alias("parent")))


@query("t11_stream_enrich", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    from ..streaming.streams import stream_enrich

    return stream_enrich(t.customer.withColumnRenamed("c_nationkey", "uri"), t.nation.select(F.col("n_nationkey").alias("uri"), "n_name")).select("c_custkey", "n_name")


@query("g03_corpus_build", "SELECT doc_id::VARCHAR AS path, sha256(text) AS new_sha, CASE WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'created' END AS action FROM documents")
def _(t):
    import pandas as pd

    def draft(p):
        return pd.DataFrame({"path": p.doc_id.astype(str), "content": [f"{n:09d}{x}" for n, x in zip(p.range_no, p.text)], "source": p.doc_id.astype(str)})

    def merge(p):
        return pd.DataFrame({"path": [p.path.iloc[0]], "content": ["".join(x[9:] for x in sorted(p.content))]})

    target = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    read = t.spark.createDataFrame([], "path string, sha string")
    return G.corpus_build(t.documents.select("doc_id", "text"), draft, merge, target, read)[0]


@query("g06_score", "SELECT doc_id, length(text)::DOUBLE AS new_score FROM documents")
def _(t):
    return G.score(t.documents, ["text"], lambda s: s.str.len().astype(float)).select("doc_id", "new_score")


@query("g07_reduce_groups", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey")
def _(t):
    def part(p):
        return p.groupby("l_suppkey", as_index=False).agg(n=("l_quantity", "size"), quantity=("l_quantity", "sum"))

    def merge(p):
        return p.groupby("l_suppkey", as_index=False).agg(n=("n", "sum"), quantity=("quantity", "sum"))

    columns = "l_suppkey long, n long, quantity double"
    return G.reduce_groups(t.lineitem.select("l_suppkey", "l_quantity"), ["l_suppkey"], merge, columns, part, columns, most_rows=500)[0].withColumn("quantity", F.round("quantity", 2))


@query("g07_failed_groups", "SELECT l_suppkey, 'ValueError: group ' || l_suppkey AS error FROM lineitem WHERE l_suppkey % 10 = 3 GROUP BY l_suppkey")
def _(t):
    def merge(p):
        if p.l_suppkey.iloc[0] % 10 == 3:
            raise ValueError(f"group {p.l_suppkey.iloc[0]}")
        return p.head(1)

    return G.reduce_groups(t.lineitem.select("l_suppkey"), ["l_suppkey"], merge, "l_suppkey long")[1]


@query("g03_source_status", "SELECT doc_id::VARCHAR AS source, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'unreferenced' ELSE 'published' END AS status FROM documents")
def _(t):
    import pandas as pd

    def draft(p):
        if (p.doc_id % 7 == 0).any():
            raise ValueError("a range can't be read")
        p = p[(p.doc_id % 3 != 0) | (p.doc_id % 5 == 0)]
        return pd.DataFrame({"path": p.doc_id.astype(str), "content": p.text, "source": p.doc_id.astype(str)})

    def merge(p):
        if int(p.path.iloc[0]) % 5 == 0:
            raise ValueError("a group can't be merged")
        return pd.DataFrame({"path": [p.path.iloc[0]], "content": [" ".join(p.content)]})

    none = t.spark.createDataFrame([], "path string, content string, sha string")
    return G.corpus_build(t.documents.select("doc_id", "text"), draft, merge, none.select("path", "content"), none.select("path", "sha"))[2]


@query("g09_sql_functions", f"{RECORDS} SELECT doc_id FROM records WHERE lang = 'en'")
def _(t):
    G.register_sql(t.spark, tessera_records=t.records)
    return t.spark.sql("SELECT doc_id FROM tessera_records WHERE in_subtree(uri, 'ctx://resources/en')")
