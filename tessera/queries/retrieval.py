"""Queries of retrieval joins. Query sets are the rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..operators import retrieve as R
from ..operators.evaluation import recall_at_k
from ..plans import jobs as J
from . import RECORDS, query


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(t):
    return _vectors(t).where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")


def _knn_sql(score: str, k: int = 10) -> str:
    return f"""SELECT qid, id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM
 (SELECT q.vec_id AS qid, c.vec_id AS id, {score} AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) c)) WHERE rank <= {k}"""


def _rounded(df, places: int = 5):
    return df.withColumn("score", F.round("score", places))


@query("r01_knn_cosine", _knn_sql("list_cosine_similarity(q.x, c.x)"))
def _(t):
    return _rounded(R.knn(_vectors(t), _asked(t)))


@query("r01_knn_ip", _knn_sql("list_dot_product(q.x, c.x)"))
def _(t):
    return _rounded(R.knn(_vectors(t), _asked(t), metric="ip"))


@query("r01_knn_l2", _knn_sql("-list_distance(q.x, c.x)"))
def _(t):
    return _rounded(R.knn(_vectors(t), _asked(t), metric="l2"))


@query("r01_knn_l1", _knn_sql("-list_sum(list_transform(range(1, len(q.x) + 1), lambda i: abs(q.x[i] - c.x[i])))"))
def _(t):
    return _rounded(R.knn(_vectors(t), _asked(t), metric="l1"))


@query("r02_filtered_knn", _knn_sql("list_cosine_similarity(q.x, c.x)").replace("FROM embeddings) c", "FROM embeddings WHERE label = 1) c"))
def _(t):
    return _rounded(R.knn(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), _asked(t), where=F.col("label") == 1))


@query("r03_knn_int8", None)
def _(t):
    return _rounded(R.knn_int8(_vectors(t), _asked(t)))


@query("r04_knn_approx", None)
def _(t):
    return _rounded(R.knn_approx(_vectors(t), _asked(t)))


def _signatures(t, **options):
    """An index of all vectors, and what it finds."""
    from ..operators import signatures as I
    from ..staging import fresh_path

    path = fresh_path(t.spark)
    I.build_index(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), path, keep=("label",))
    return I.search_index(t.spark, path, _asked(t), **options)


@query("r04_knn_signatures", None)
def _(t):
    return _rounded(_signatures(t))


def _recall(found, exact):
    """Mean recall at 10 over the queries, and whether it reaches 0.9."""
    ids = lambda df, name: df.groupBy("qid").agg(F.array_agg("id").alias(name))
    each = ids(exact, "expected").join(ids(found, "found"), "qid", "left").select(recall_at_k(F.coalesce("found", F.array().cast("array<long>")), F.col("expected"), 10).alias("r"))
    return each.agg(F.count(F.lit(1)).alias("asked"), (F.avg("r") >= 0.9).alias("enough"))


@query("a12_recall_int8", "SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def _(t):
    return _recall(R.knn_int8(_vectors(t), _asked(t)), R.knn(_vectors(t), _asked(t), metric="ip"))


@query("a12_recall_approx", "SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def _(t):
    return _recall(R.knn_approx(_vectors(t), _asked(t)), R.knn(_vectors(t), _asked(t)))


@query("a12_recall_signatures", "SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def _(t):
    return _recall(_signatures(t), R.knn(_vectors(t), _asked(t)))


@query("a12_recall_signatures_filtered", "SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def _(t):
    exact = R.knn(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), _asked(t), where=F.col("label") == 1)
    return _recall(_signatures(t, where=F.col("label") == 1), exact)


TERMS = r"SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM documents"


def _postings(t):
    """Texts are shuffled once, which is less than their words; the counts by id and term, and rows made of them, stay in place."""
    rows = t.documents.select(F.col("doc_id").alias("id"), "text").repartition("id")
    return rows.select("id", F.explode(R.tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _texts(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def _asked_terms(t):
    return t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("term")).withColumn("w", F.lit(1.0))


SPARSE = f"""WITH p AS (SELECT id, term, count(*)::DOUBLE AS w FROM ({TERMS}) GROUP BY ALL), q AS (SELECT DISTINCT id AS qid, term FROM p WHERE id % 50 = 0),
 s AS (SELECT qid, id, sum(w) AS score FROM p JOIN q USING (term) GROUP BY ALL)"""


@query("r05_sparse_knn", f"{SPARSE} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def _(t):
    return R.sparse_knn(_texts(t), _asked_terms(t))


@query("r06_sparse_l2", f"{SPARSE} SELECT qid, id, a.n + b.n - 2 * score AS distance2 FROM s JOIN (SELECT id, sum(w * w) AS n FROM p GROUP BY id) a USING (id) JOIN (SELECT qid, count(*) AS n FROM q GROUP BY qid) b USING (qid)")
def _(t):
    return R.sparse_l2(_texts(t), _asked_terms(t))


@query("r05_sparse_knn_postings", f"{SPARSE} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3")
def _(t):
    return R.sparse_knn(_postings(t), _asked_terms(t), 3)


@query("r06_sparse_l2_nearest", f"""{SPARSE} SELECT qid, id, distance2, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance2, id) AS rank FROM
 (SELECT qid, id, a.n + b.n - 2 * score AS distance2 FROM s JOIN (SELECT id, sum(w * w) AS n FROM p GROUP BY id) a USING (id) JOIN (SELECT qid, count(*) AS n FROM q GROUP BY qid) b USING (qid))) WHERE rank <= 5""")
def _(t):
    return R.sparse_l2(_texts(t), _asked_terms(t), 5)


HYBRID = f"""{SPARSE}, d AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
 f AS (SELECT qid, id, 0.5 * coalesce(d.score, 0) + 0.5 * coalesce(s.score, 0) AS score FROM d FULL JOIN s USING (qid, id))"""


@query("r07_hybrid", f"{HYBRID} SELECT qid, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 10")
def _(t):
    return _rounded(R.hybrid_knn(_vectors(t), _asked(t), _texts(t), _asked_terms(t)))


@query("a12_recall_hybrid", "SELECT count(*) AS asked, true AS enough FROM (SELECT doc_id AS q FROM documents WHERE doc_id % 50 = 0 UNION SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)")
def _(t):
    bounded = R.hybrid_knn(_vectors(t), _asked(t), _texts(t), _asked_terms(t), candidates=100)
    return _recall(bounded, R.hybrid_knn(_vectors(t), _asked(t), _texts(t), _asked_terms(t)))


@query("r08_knn_by_id", _knn_sql("list_cosine_similarity(q.x, c.x)", 3))
def _(t):
    return _rounded(R.knn_by_id(_vectors(t), _asked(t).select(F.col("qid").alias("id")), k=3))


def _bm25(asked: str) -> str:
    """Scores s (qid, id, score) of documents for the rows (qid, text) of a query."""
    return f"""WITH w AS ({TERMS}), n AS (SELECT doc_id AS id, coalesce(l, 0) AS len FROM documents LEFT JOIN (SELECT id, count(*) AS l FROM w GROUP BY id) x ON x.id = doc_id), p AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL),
 q AS (SELECT DISTINCT qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS term FROM ({asked})),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY term), t AS (SELECT count(*) AS n, avg(len) AS avg_len FROM n),
 s AS (SELECT qid, id, sum(ln(1 + (t.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM q JOIN p USING (term) JOIN df USING (term) JOIN n USING (id), t GROUP BY ALL)"""


BM25 = _bm25("SELECT item_id AS qid, text FROM benchmark")


@query("r09_keyword_search", f"{BM25} SELECT qid, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 10")
def _(t):
    corpus = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return _rounded(R.keyword_search(corpus, t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))))


@query("r10_scalar_search", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5")
def _(t):
    return R.scalar_search(t.orders, "o_totalprice", where=F.col("o_orderstatus") == "F", offset=5, key="o_orderkey").select("o_orderkey", "o_totalprice")


@query("r11_random_search", None)
def _(t):
    return R.random_search(t.customer, 20, 7, F.col("c_acctbal") > 0, "c_custkey")


def _hits(t):
    """Events as hits of users' requests."""
    return t.events.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.col("value").alias("score"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("updated_at"))


@query("r12_rerank", """WITH c AS (SELECT * FROM (SELECT user_id AS qid, event_id AS id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10),
 s AS (SELECT qid, id, (id * 7919 % 1000) / 10.0 AS score FROM c) SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def _(t):
    scores = t.events.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), (F.col("event_id") * 7919 % 1000 / 10.0).alias("new_score"))
    return _rounded(R.rerank(_hits(t), scores, 5), 6).select("qid", "id", "score", "rank")


@query("r13_score_threshold", "SELECT event_id AS id FROM events WHERE CASE WHEN event_type = 'view' THEN value >= 20 ELSE value > 0 END")
def _(t):
    return R.score_threshold(_hits(t).withColumn("reranked", F.col("text") == "view"), model_threshold=20).select("id")


@query("r14_time_decay", """WITH c AS (SELECT * FROM (SELECT user_id AS qid, event_id AS id, value AS s, ts, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 15),
 d AS (SELECT qid, id, s * pow(0.5, greatest((epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts)) / 86400000000.0 - 2, 0) / 7) AS score FROM c)
 SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d) WHERE rank <= 5""")
def _(t):
    return _rounded(R.time_decay(_hits(t), F.lit(datetime(2024, 1, 30, tzinfo=UTC)), 2, limit=5), 6).select("qid", "id", "score", "rank")


ASKED_THRICE = _bm25("""SELECT item_id || '#' || i AS qid, ts[i] AS text FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM
  (SELECT item_id, [text, '? ' || text] || CASE WHEN split_part(text, '.', 1) <> text THEN [split_part(text, '.', 1)] ELSE [] END AS ts FROM benchmark))""")


@query("r15_multi_query", f"""{ASKED_THRICE}, best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS r FROM s),
 one AS (SELECT split_part(qid, '#', 1)::BIGINT AS request, id, max(score) AS score FROM best WHERE r <= 10 GROUP BY ALL)
 SELECT request, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(score, 9) DESC, id) AS rank FROM one) WHERE rank <= 10""")
def _(t):
    corpus = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    plans = t.benchmark.select(F.col("item_id").alias("request"), F.array("text", F.concat(F.lit("? "), "text"), F.split("text", r"\.")[0]).alias("queries"))
    return _rounded(R.multi_query(plans, lambda q: R.keyword_search(corpus, q, 10), 10))


@query("w01_keep_best", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    return R.keep_best(t.orders.withColumn("score", F.col("o_totalprice")), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("g01_find", f"""{RECORDS}, q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0),
 c AS (SELECT uri, updated_at, abstract, embedding::DOUBLE[] AS x FROM records JOIN embeddings ON vec_id = doc_id WHERE uri LIKE 'ctx://resources/en/%' AND updated_at >= TIMESTAMP '2024-01-05')
 SELECT qid, uri, round(score, 5) AS score, rank, abstract FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uri) AS rank FROM (SELECT qid, uri, abstract, list_cosine_similarity(q.x, c.x) AS score FROM q, c)) WHERE rank <= 10""")
def flagship(t):
    from ..functions.filters import build_scope, in_time
    from ..schema import records_from_documents

    records = records_from_documents(t.documents, t.embeddings)
    where = build_scope("resource", targets=["ctx://resources/en"], extra=in_time("updated_at", datetime(2024, 1, 5, tzinfo=UTC)), levels=[2])
    return _rounded(J.find(records, _asked(t), 10, where, ["abstract"]))


@query("g01_find_hybrid", f"""{BM25}, e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), a AS (SELECT item_id AS qid, x FROM benchmark JOIN e ON vec_id = item_id),
 d AS (SELECT qid, vec_id AS id, list_cosine_similarity(a.x, e.x) AS score FROM a, e JOIN documents ON vec_id = doc_id),
 f AS (SELECT qid, id, 0.7 * coalesce(d.score, 0) + 0.3 * coalesce(s.score, 0) AS score FROM d FULL JOIN s USING (qid, id))
 SELECT qid, id AS doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, 'ctx://resources/' || lang || '/' || source || '/' || id || '.md') AS rank FROM f JOIN documents ON doc_id = id) WHERE rank <= 10""")
def _(t):
    from ..schema import records_from_documents

    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query")).join(_vectors(t).withColumnRenamed("id", "qid"), "qid", "left")
    return _rounded(J.find(records_from_documents(t.documents, t.embeddings), asked, 10, fields=["doc_id"])).drop("uri")


@query("g02_assemble_context", None)
def _(t):
    ledger = t.spark.createDataFrame([], "session string, uri string, tier string, turn int")
    requests = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return J.assemble_context(requests, t.records, ledger, 1, 1500, {"resource": 20}, F.lit(datetime(2024, 3, 1, tzinfo=UTC)), k=20)[0]
