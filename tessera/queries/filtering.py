"""Queries of filters, projections, orders and maintenance."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import filters as L
from ..operators import maintain as M
from ..operators import project as P
from ..operators import windows as W
from ..operators.joins import set_operation
from . import RECORDS, query

JAN = lambda d, h=0: datetime(2024, 1, d, h, tzinfo=UTC)
NOW = datetime(2024, 2, 1, 12, tzinfo=UTC)


def _ids(name: str, condition, sql: str) -> None:
    """A query for the ids of the records that a filter leaves; the condition is made when the query runs."""
    query(name, f"{RECORDS} SELECT doc_id FROM records WHERE {sql}")(lambda t: t.records.where(condition() if not isinstance(condition, Column) else condition).select("doc_id"))


_ids("f01_all_of", lambda: L.all_of([L.eq("lang", "en"), None, L.in_range("active_count", gte=10)]), "lang = 'en' AND active_count >= 10")
_ids("f02_any_of_nothing", lambda: L.any_of([]), "false")
_ids("f02_any_of", lambda: L.any_of([L.eq("lang", "de"), L.eq("source", "src1")]), "lang = 'de' OR source = 'src1'")
_ids("f03_eq_list", lambda: L.eq("search_tags", "lang=fr", is_list=True), "list_contains(search_tags, 'lang=fr')")
_ids("f04_one_of", lambda: L.one_of("lang", ["fr", "es"]), "lang IN ('fr', 'es')")
_ids("f04_one_of_list", lambda: L.one_of("search_tags", ["src=src2", "lang=es"], is_list=True), "list_has_any(search_tags, ['src=src2', 'lang=es'])")
_ids("f05_none_of", lambda: L.none_of("source", ["src0", "src1"]), "source IS NULL OR source NOT IN ('src0', 'src1')")
_ids("f06_range", lambda: L.in_range("active_count", gt=5, lte=20), "active_count > 5 AND active_count <= 20")
_ids("f07_range_out", lambda: L.out_of_range("active_count", gte=5, lt=45), "active_count < 5 OR active_count >= 45")
_ids("f08_time_range", lambda: L.in_time("updated_at", JAN(3), JAN(20)), "updated_at >= TIMESTAMP '2024-01-03' AND updated_at < TIMESTAMP '2024-01-20'")
_ids("f09_path_scope", lambda: L.path_scope("uri", "ctx://resources/en/", 2), "uri LIKE 'ctx://resources/en/%'")
_ids("f09_uri_scope_depth", lambda: L.uri_scope("uri", "ctx://resources/en/src1", 1), "parent_uri = 'ctx://resources/en/src1'")
_ids("f10_build_scope", lambda: L.build_scope("resource", L.eq("account_id", "acc1"), ["ctx://resources/de", "ctx://resources/fr/"], extra=L.in_range("active_count", lt=30), levels=[2]), "account_id = 'acc1' AND lang IN ('de', 'fr') AND active_count < 30")
_ids("f11_contains", lambda: L.contains("content", "ing th"), "contains(content, 'ing th')")
_ids("f12_prefix", lambda: L.prefix("uri", "ctx://resources/en/src1"), "uri LIKE 'ctx://resources/en/src1%'")
_ids("f13_regex", lambda: L.regex("content", r"token = \"[0-9a-f]+\""), """regexp_matches(content, 'token = "[0-9a-f]+"')""")
_ids("f17_noop", lambda: L.noop(), "true")
_ids("f18_compile_filter", lambda: L.compile_filter({"op": "and", "conds": [{"op": "must", "field": "lang", "conds": ["en", "de"]}, {"op": "or", "conds": [{"op": "range", "field": "active_count", "gte": 40}, {"op": "must_not", "field": "source", "conds": ["src0", "src3", "src5"]}]}, {"op": "contains", "field": "content", "substring": "the"}]}), "lang IN ('en', 'de') AND (active_count >= 40 OR source NOT IN ('src0', 'src3', 'src5')) AND contains(content, 'the')")
_ids("f19_time_bounds", lambda: L.time_bounds("updated_at", "3w", "2024-01-25", NOW), "updated_at >= TIMESTAMP '2024-01-11 12:00:00' AND updated_at <= TIMESTAMP '2024-01-25 23:59:59.999999'")
_ids("f20_type_and_level", lambda: L.context_type_filter("Resource, memory") & L.level_filter("2,7,x"), "context_type IN ('resource', 'memory') AND level = 2")
_ids("f21_tags_all", lambda: L.tags_all(["lang=en", " LANG = de ", "src=src4"]), "list_contains(search_tags, 'lang=de') AND list_contains(search_tags, 'src=src4')")
_ids("f22_glob", lambda: L.glob(F.substring(F.col("uri"), 17, 1000), "en/*/1*.md"), "regexp_matches(uri, '^ctx://resources/en/[^/]+/1[^/]*\\.md$')")
_ids("f23_in_scope", lambda: L.in_scope("acc2", "u1", targets=["ctx://resources/en", "ctx://resources/es/"]), "account_id = 'acc2' AND lang IN ('en', 'es')")
_ids("f25_expired", lambda: L.expired("updated_at", JAN(15)), "updated_at <= TIMESTAMP '2024-01-15'")


@query("f14_geo_range", "SELECT c_custkey FROM (SELECT c_custkey, c_custkey * 37 % 360 - 180.0 AS lon, c_custkey * 17 % 180 - 90.0 AS lat FROM customer) WHERE (lon - 10) * (lon - 10) + (lat - 20) * (lat - 20) <= (2000000 / 111320.0) * (2000000 / 111320.0)")
def _(t):
    at = t.customer.select("c_custkey", (F.col("c_custkey") * 37 % 360 - 180.0).alias("lon"), (F.col("c_custkey") * 17 % 180 - 90.0).alias("lat"))
    return at.where(L.geo_range("lon", "lat", (10.0, 20.0), "2000km")).select("c_custkey")


@query("f15_circle", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity - 20) * (l_quantity - 20) + (l_discount * 100 - 5) * (l_discount * 100 - 5) <= 12.25")
def _(t):
    return t.lineitem.withColumn("d", F.col("l_discount") * 100).where(L.circle("l_quantity", "d", (20, 5), 3.5)).select("l_orderkey", "l_linenumber")


@query("f16_label_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(t):
    return L.label_in(t.orders, t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@query("f24_url_filter", r"SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://[^/?#]+/(en|fr)') AND NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '(?i)\.(png|jpe?g|gif|pdf|zip)$')")
def _(t):
    return t.pages.where(L.url_filter("url", include=["/en", "/fr"])).select("page_id")


@query("p01_project", f"{RECORDS} SELECT uri, level FROM records")
def _(t):
    return P.project(t.records, ["uri", "level", "uri"])


@query("p02_backfill", "SELECT doc_id, coalesce(lang, '') AS lang, 0::BIGINT AS visits, 'new' AS state FROM documents")
def _(t):
    from pyspark.sql.types import LongType, StringType, StructType

    return P.backfill_defaults(t.documents.select("doc_id", "lang"), StructType().add("lang", StringType()).add("visits", LongType()).add("state", StringType()), {"state": "new"})


@query("p03_validated", "SELECT c_custkey, list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'at is missing' END, CASE WHEN c_custkey % 7 = 3 THEN 'at is no time' END, CASE WHEN c_custkey * 37 % 400 - 200 NOT BETWEEN -180 AND 180 THEN 'place is no place' END], lambda x: x IS NOT NULL) AS reasons FROM customer")
def _(t):
    key = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(key % 7 == 0, None).when(key % 7 == 3, "soon").otherwise("2024-01-01T00:00:00Z").alias("at"), F.concat((key * 37 % 400 - 200).cast("string"), F.lit(",10")).alias("place"))
    return P.validated(rows, required=["at"], times=["at"], geos=["place"]).select("c_custkey", "reasons")


@query("p04_index_types", "SELECT o_orderkey, epoch_ms(o_orderdate) AS at, ['a', o_orderstatus] AS tags FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.concat(F.lit("a;"), "o_orderstatus").alias("tags"))
    return P.to_index_types(rows, times=["at"], lists=["tags"])


@query("p06_record_id", f"{RECORDS}, l AS (SELECT doc_id, account_id, uri, doc_id % 3 AS level FROM records) SELECT doc_id, md5(account_id || ':' || uri || CASE level WHEN 0 THEN '/.abstract.md' WHEN 1 THEN '/.overview.md' ELSE '' END) AS id FROM l")
def _(t):
    return t.records.select("doc_id", P.record_id(F.col("account_id"), F.col("uri"), F.col("doc_id") % 3).alias("id"))


@query("p07_rewrite_scope", f"{RECORDS} SELECT doc_id, 'ctx://archive/x' || substr(uri, 24) AS uri, md5(account_id || ':' || 'ctx://archive/x' || substr(uri, 24)) AS id FROM records WHERE uri LIKE 'ctx://resources/en/src1/%'")
def _(t):
    return P.rewrite_scope(t.records, "ctx://resources/en/src1", "ctx://archive/x", move=True).select("doc_id", "uri", "id")


@query("p09_category", "SELECT event_id, CASE event_type WHEN 'view' THEN 'preferences' WHEN 'click' THEN 'events' WHEN 'error' THEN 'cases' END AS category FROM events")
def _(t):
    part = F.when(F.col("event_type") == "view", "preferences").when(F.col("event_type") == "click", "events").when(F.col("event_type") == "error", "cases").otherwise("other")
    return t.events.select("event_id", P.category_of(F.concat(F.lit("ctx://user/u/memories/"), part, F.lit("/1.md"))).alias("category"))


@query("p10_session_key", "SELECT c_custkey, 's__' || lower(c_mktsegment) || '__' || replace(c_name, '#', '-') AS key FROM customer")
def _(t):
    return t.customer.select("c_custkey", P.session_key("s", F.lower("c_mktsegment"), F.col("c_name")).alias("key"))


@query("p11_usage_event_id", """SELECT event_id, 'ue_' || sha256('["' || event_id || '","' || event_type || '"]') AS id FROM events""")
def _(t):
    return t.events.select("event_id", P.usage_event_id(F.col("event_id"), F.col("event_type")).alias("id"))


@query("o01_sort", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey ASC LIMIT 25")
def _(t):
    return W.sort(t.orders, ["o_orderpriority", "o_totalprice", "o_orderkey"], ["asc", "desc", "asc"], 25).select("o_orderkey")


@query("o02_sort_center", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal - 1000), c_custkey LIMIT 20")
def _(t):
    return W.sort_center1d(t.customer, "c_acctbal", 1000, 20, "c_custkey").select("c_custkey")


@query("o03_sort_geo", "SELECT c_custkey FROM customer ORDER BY pow(c_custkey * 37 % 360 - 180.0 - 3, 2) + pow(c_custkey * 17 % 180 - 90.0 - 4, 2), c_custkey LIMIT 20")
def _(t):
    at = t.customer.select("c_custkey", (F.col("c_custkey") * 37 % 360 - 180.0).alias("lon"), (F.col("c_custkey") * 17 % 180 - 90.0).alias("lat"))
    return W.sort_geo(at, "lon", "lat", (3, 4), 20, "c_custkey").select("c_custkey")


@query("o04_path_order", f"{RECORDS} SELECT uri, row_number() OVER (ORDER BY lang, source, doc_id || '.md') AS n FROM records")
def _(t):
    from pyspark.sql.window import Window

    rows = W.path_order(t.records, "uri").select("uri", "parent_uri")
    before = rows.groupBy("parent_uri").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy(F.split("parent_uri", "/")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("parent_uri").orderBy(F.split("uri", "/")))
    return rows.withColumn("own", own).join(before.select("parent_uri", "before"), "parent_uri").select("uri", (F.col("before") + F.col("own")).alias("n"))


@query("o05_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 30")
def _(t):
    return W.limited(t.customer, F.desc("c_acctbal"), "c_custkey", offset=30).select("c_custkey")


@query("u02_set_operations", """SELECT 'intersect' AS how, c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey < 10 UNION ALL SELECT 'exclude', c_custkey FROM customer WHERE c_acctbal > 0 AND NOT c_nationkey < 10
 UNION ALL SELECT 'xor', c_custkey FROM customer WHERE (c_acctbal > 0) <> (c_nationkey < 10) UNION ALL SELECT 'union', c_custkey FROM customer WHERE c_acctbal > 0 OR c_nationkey < 10""")
def _(t):
    a, b = t.customer.where("c_acctbal > 0").select("c_custkey"), t.customer.where("c_nationkey < 10").select("c_custkey")
    parts = [set_operation(a, b, how, "c_custkey").select(F.lit(how).alias("how"), "c_custkey") for how in ("intersect", "exclude", "xor", "union")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s12_fetch_by_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey * 2 FROM lineitem)")
def _(t):
    return M.fetch_by_ids(t.orders, t.lineitem.select((F.col("l_orderkey") * 2).alias("o_orderkey")), "o_orderkey")[0].select("o_orderkey", "o_custkey")


@query("s12_missing_ids", "SELECT DISTINCT l_orderkey * 2 AS o_orderkey FROM lineitem WHERE l_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)")
def _(t):
    return M.fetch_by_ids(t.orders, t.lineitem.select((F.col("l_orderkey") * 2).alias("o_orderkey")), "o_orderkey")[1]


@query("s13_apply_changes", """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 'up' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 1 THEN 1.0 WHEN c_custkey % 5 = 2 THEN NULL ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 5 <> 3
 UNION ALL SELECT c_custkey + 10000000, 'new', 0.0 FROM customer WHERE c_nationkey = 0""")
def _(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    def change(rows, op, seq, names, name=None, balance=None):
        return rows.select("id", F.lit(op).alias("op"), F.lit(seq).alias("seq"), F.array(*map(F.lit, names)).cast("array<string>").alias("set"), F.lit(name).cast("string").alias("name"), F.lit(balance).cast("double").alias("balance"))

    changes = change(base.where("id % 5 = 1"), "upsert", 1, [], "up", 1.0).unionByName(change(base.where("id % 5 = 2"), "update", 2, ["balance"])).unionByName(change(base.where("id % 5 = 3"), "update", 3, ["name"], "gone")).unionByName(change(base.where("id % 5 = 3"), "delete", 4, []))
    new = change(t.customer.where("c_nationkey = 0").select((F.col("c_custkey") + 10000000).alias("id")), "upsert", 5, [], "new", 0.0)
    return M.apply_changes(base, changes.unionByName(new))


@query("s14_delete_scope", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F'")
def _(t):
    return M.delete_scope(t.orders, F.col("o_orderstatus") == "F", "o_orderstatus")[0].select("o_orderkey")


@query("t09_change_feed", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'delete' ELSE 'update' END AS op FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority = '1-URGENT'")
def _(t):
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = t.orders.where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return M.change_feed(old, new, "o_orderkey").select("o_orderkey", "op")


@query("g05_reindex_plan", f"""{RECORDS} SELECT uri, CASE WHEN doc_id % 10 = 0 THEN 'upsert' WHEN doc_id % 10 = 1 THEN 'delete' WHEN doc_id % 10 = 2 THEN 'upsert' WHEN doc_id % 10 = 3 THEN 'merge' WHEN doc_id % 10 = 4 THEN 'update_fields' ELSE 'none' END AS action FROM records""")
def _(t):
    d = F.col("doc_id") % 10
    sha = lambda c: F.md5(c.cast("binary"))
    entries = t.records.where(d != 1).select("uri", "level", sha(F.col("content")).alias("md5"), F.lit("f").alias("fields_md5"))
    records = t.records.where(d != 0).select("uri", "level", sha(F.when(d == 2, F.concat("content", F.lit("x"))).otherwise(F.col("content"))).alias("md5"), F.when(d == 4, "g").otherwise("f").alias("fields_md5"), (d != 3).alias("vector_ok"))
    return M.reindex_plan(entries, records).select("uri", "action")
