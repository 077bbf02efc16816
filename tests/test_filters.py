from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import filters as L
from tessera.operators import aggregates as A
from tessera.operators import project as P
from tessera.operators import retrieve as R

NOW = datetime(2026, 1, 10, 12, tzinfo=UTC)


@pytest.fixture(scope="module")
def records(spark):
    """Four records, one of another account and without a time."""
    day = lambda m: datetime(2026, m, 1, tzinfo=UTC)
    rows = [
        ("a", "ctx://r/docs", 0, [1.0, 0.0, 0.0, 0.0], "", "acc", ["team=x"], day(1)), ("b", "ctx://r/docs/a.md", 2, [0.9, 0.1, 0.0, 0.0], "apple banana", "acc", ["team=y"], day(2)),
        ("c", "ctx://r/docs/sub/b.md", 2, [0.0, 1.0, 0.0, 0.0], "cherry", "acc", None, day(3)), ("d", "ctx://r/other.md", 2, [0.0, 0.0, 1.0, 0.0], "durian apple", "acc2", None, None),
    ]
    return spark.createDataFrame(rows, "id string, uri string, level int, vector array<float>, content string, account_id string, search_tags array<string>, updated_at timestamp")


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(("depth", "expected"), [(0, "a"), (1, "ab"), (-1, "abc")])
def test_path_scope_depth(records, depth, expected):
    for scope in (L.path_scope("uri", "ctx://r/docs/", depth), L.path_scope("uri", "ctx:/r//docs", depth), L.uri_scope("uri", "ctx://r/docs/", depth)):
        assert "".join(sorted(ids(records.where(scope)))) == expected


def test_filters_on_the_fixture(records):
    where = lambda c: "".join(sorted(ids(records.where(c))))
    assert where(L.one_of("search_tags", ["team=y"], is_list=True)) == "b"
    assert where(L.contains("content", "pple")) == "bd"
    assert where(L.in_range("level", gte=1)) == "bcd"
    assert where(L.any_of([])) == "" and where(L.all_of([])) == "abcd"
    assert where(L.none_of("search_tags", ["team=x"], is_list=True)) == "bcd"
    assert where(L.tags_all([" Team = Y ", "bad"])) == "b"
    assert where(L.none_of("account_id", ["acc2"])) == "abc"


def test_prefix_filter_reaches_the_scan(spark, records, tmp_path):
    path = f"{tmp_path}/r"
    records.write.parquet(path)
    plan = spark.read.parquet(path).where(L.uri_scope("uri", "ctx://r/docs")).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(uri,ctx://r/docs/)" in plan and "vector" not in plan.split("ReadSchema")[1]


def test_search_on_the_fixture(spark, records):
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "qid long, vector array<float>")
    hits = R.knn(records, queries, 10, where=F.col("account_id") == "acc").orderBy("rank").collect()
    assert [h.id for h in hits] == ["a", "b", "c"] and hits[0].score == pytest.approx(1) and hits[2].score == pytest.approx(0)
    assert [h.id for h in R.knn(records, queries, 2, where=F.col("account_id") == "acc", offset=1).orderBy("rank").collect()] == ["b", "c"]
    blocks = R.knn(records, queries, 10, where=F.col("account_id") == "acc", most_broadcast=0).orderBy("rank").collect()
    assert [(h.id, round(h.score, 6)) for h in blocks] == [(h.id, round(h.score, 6)) for h in hits]
    assert ids(R.scalar_search(records, "updated_at")) == ["c", "b", "a", "d"]
    words = R.keyword_search(records, spark.createDataFrame([(1, "apple"), (2, "  ")], "qid long, query string")).collect()
    assert {(w.qid, w.id) for w in words} == {(1, "b"), (1, "d")}
    assert {r.account_id: r["count"] for r in A.count_by(records, "account_id").collect()} == {"acc": 3, "acc2": 1}
    with pytest.raises(Exception, match="vectors of 4 numbers"):
        R.knn(records.withColumn("vector", F.array(F.lit(1.0).cast("float"))), queries).collect()


def test_zero_and_null_vectors_are_not_found(spark):
    corpus = spark.createDataFrame([("z", [0.0, 0.0]), ("n", None), ("v", [1.0, 1.0])], "id string, vector array<float>")
    assert ids(R.knn(corpus, spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<float>"))) == ["v"]


def test_sparse_and_hybrid(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0, 0.0]), ("c", [0.0, 1.0, 0.0, 0.0]), ("d", [0.0, 0.0, 1.0, 0.0])], "id string, vector array<float>")
    postings = spark.createDataFrame([("a", "apple", 1.0), ("b", "u.s.", 2.0), ("c", "u.s.", 0.5), ("c", "cherry", 1.0), ("c", "cherry", 2.0)], "id string, term string, w double")
    queries, terms = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "qid long, vector array<float>"), spark.createDataFrame([(1, "u.s.", 1.0)], "qid long, term string, w double")
    hits = R.hybrid_knn(corpus, queries, postings, terms).orderBy("rank").collect()
    assert [h.id for h in hits] == ["b", "a", "c", "d"]
    assert hits[0].score == pytest.approx(0.5 * (0.9 / 0.82**0.5) + 1.0) and hits[2].score == pytest.approx(0.25)
    only = R.sparse_knn(postings, spark.createDataFrame([(1, "cherry", 0.5)], "qid long, term string, w double")).collect()
    assert [(h.id, h.score) for h in only] == [("c", 1.5)]


def test_int8_and_approximate_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    exact = {(h.qid, h.id) for h in R.knn(rows, asked, metric="cosine").collect()}
    near = {(h.qid, h.id) for h in R.knn_approx(rows, asked).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    ip = {(h.qid, h.id) for h in R.knn(rows, asked, metric="ip").collect()}
    assert len(ip & {(h.qid, h.id) for h in R.knn_int8(rows, asked).collect()}) >= 0.9 * len(ip)


def test_other_ways_of_search_find_the_same(spark, sf):
    """Blocks of both sides and joined terms, the ways beyond the sizes that are broadcast; small tiles; missing values."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64)], "id long, vector array<float>")).unionByName(rows.select(F.col("id") + 100_000, "vector").toDF("id", "vector"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    plain = lambda df: sorted((r.qid, r.id, r.rank, round(r.score, 6)) for r in df.collect())
    assert plain(R.knn(rows, asked)) == plain(R.knn(rows, asked, most_broadcast=0))
    assert plain(R.knn_int8(rows, asked)) == plain(R.knn_int8(rows, asked, most_broadcast=0))
    assert plain(R.knn(rows, asked, k=5, offset=5)) == [(q, i, r, s) for q, i, r, s in plain(R.knn(rows, asked)) if r > 5]
    assert {r.id % 2 for r in R.knn_approx(rows, asked, where=F.col("id") % 2 == 0).collect()} == {0}
    assert R.knn(rows.limit(0), asked).isEmpty() and R.knn(rows, asked.limit(0)).isEmpty() and R.knn_approx(rows.limit(0), asked).isEmpty()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "id long, content string"))
    wanted = docs.where("id % 20 = 0").select(F.col("id").alias("qid"), F.substring("content", 1, 200).alias("query"))
    assert plain(R.keyword_search(docs, wanted)) == plain(R.keyword_search(docs, wanted, most_terms=0))
    assert R.keyword_search(docs.limit(0), wanted).isEmpty() and R.keyword_search(docs, wanted.limit(0)).isEmpty()
    terms = wanted.select("qid", F.explode(R.tokens(F.col("query"))).alias("term"), F.lit(0.5).alias("w"))
    postings = docs.select("id", F.explode(R.tokens(F.col("content"))).alias("term"), F.lit(2.0).alias("w"))
    assert plain(R.sparse_knn(postings, terms)) == plain(R.sparse_knn(postings, terms, most_terms=0))


def test_best_in_small_tiles(monkeypatch):
    scores = np.random.default_rng(3).integers(0, 5, (6, 40)).astype(float)
    q, c, s = R._best(scores, 7)
    assert [(a, b) for a, b in zip(q, c, strict=True)] == [(i, j) for i in range(6) for j in sorted(range(40), key=lambda j: (-scores[i, j], j))[:7]]
    asked = R._Asked(pa.table({"qid": [1, 1, 2, 2], "term": ["a", "b", "a", "c"], "w": [1.0, 2.0, 3.0, 1.0]}))
    rng = np.random.default_rng(4)
    row, term = map(np.array, zip(*((r, t) for r in range(50) for t in range(3) if rng.random() < 0.7), strict=True))
    once = lambda: R._best_of(asked.best(pa.array(range(50)), row, term, np.ones(len(row)), 5), 5)
    whole = once()
    monkeypatch.setattr(R, "TILE", 12)
    assert once().equals(whole)


def test_time_decay_on_the_fixture(spark):
    day = lambda d: datetime(2026, 1, d, tzinfo=UTC)
    rows = [(1, str(i), s, t) for i, (s, t) in enumerate([(1.0, day(1)), (0.9, day(1)), (0.8, day(1)), (0.7, day(9)), (0.6, day(9)), (0.5, None)])]
    hits = spark.createDataFrame(rows, "qid long, id string, score double, updated_at timestamp")
    origin = F.lit(day(10))
    top = R.time_decay(hits, origin, 2, limit=2).orderBy("rank").collect()
    assert [h.id for h in top] == ["3", "4"] and top[0].time_score == 1.0
    one = R.time_decay(hits, origin, 2, limit=1).collect()[0]
    assert one.id == "0" and one.score == pytest.approx(0.5) and one.original_score == 1.0
    last = R.time_decay(hits, origin, 2, limit=2, offset=1).orderBy("rank").collect()
    assert [h.id for h in last] == ["4", "5"] and last[1].time_score is None


@pytest.mark.parametrize(
    ("path", "pattern", "matches"),
    [("foo/bar.rs", "*.rs", False), ("a.md", "**/*.md", True), ("x/y/a.md", "**/*.md", True), ("a/./b.md", "a/b.md", True), ("a//b.md", "a/?.md", True), ("a/b/c", "a/**", True), ("a/b", "a", False), ("a+b.md", "a+b.md", True)],
)
def test_glob(spark, path, pattern, matches):
    assert spark.createDataFrame([(path,)], "p string").where(L.glob("p", pattern)).count() == int(matches)


def test_errors():
    with pytest.raises(ValueError):
        L.glob_regex("./")
    with pytest.raises(ValueError):
        L.compile_filter({"op": "near"})
    with pytest.raises(ValueError):
        L._moment("soon", NOW, False)
    with pytest.raises(ValueError):
        L.degrees("0km")
    assert L.degrees("10km") == pytest.approx(10000 / 111320)


def test_time_bounds(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 10, 9, tzinfo=UTC),), (datetime(2026, 1, 8, tzinfo=UTC),), (None,)], "updated_at timestamp")
    assert df.where(L.time_bounds("updated_at", "4h", None, NOW)).count() == 1
    assert df.where(L.time_bounds("updated_at", "2026-01-08", "2026-01-10", NOW)).count() == 2
    with pytest.raises(ValueError):
        L.time_bounds("updated_at", "2026-01-09", "2026-01-08T00:00:00Z", NOW)
    with pytest.raises(ValueError):
        L.time_bounds("seen_at", None, None, NOW)


def test_validation_and_index_types(spark):
    df = spark.createDataFrame([("1", "116.412138,39.914912", "2026-01-01T00:00:00Z"), ("2", "181,0", "soon"), ("3", "0,-90", None), ("4", "x,1", "2026-01-01")], "id string, at string, t string")
    good, bad = P.split_valid(df, geos=["at"], times=["t"])
    assert sorted(ids(good)) == ["1", "3"] and {r.id: len(r.reasons) for r in bad.collect()} == {"2": 2, "4": 1}
    r = P.to_index_types(df, times=["t"], geos=["at"]).where("id = 1").first()
    assert r.at_lon == pytest.approx(116.412138) and r.t == 1767225600000
    broken = spark.createDataFrame([(bytearray(b"ok \xff\xf0\x9f\x98\x80"),)], "b binary").select(P.sanitize_text("b")).first()[0]
    assert broken == "ok �😀"


def test_rewrite_scope_keeps_siblings(spark):
    rows = [("ctx://a/f", 2), ("ctx://a/f/x.md", 2), ("ctx://a/f#1", 2), ("ctx://a/f2", 2)]
    df = spark.createDataFrame([(u, lv, "acc", "", "", 5, NOW) for u, lv in rows], "uri string, level int, account_id string, parent_uri string, id string, active_count long, updated_at timestamp")
    assert sorted(r.uri for r in P.rewrite_scope(df, "ctx://a/f", "ctx://b/g", move=True).collect()) == ["ctx://b/g", "ctx://b/g#1", "ctx://b/g/x.md"]
    assert {r.active_count for r in P.rewrite_scope(df, "ctx://a/f", "ctx://b/g", move=False).collect()} == {0}
    roots = spark.createDataFrame([("ctx://u/skills/a/SKILL.md",), ("ctx://u/skills/.h/x",), ("ctx://u/m",)], "u string").select(P.skill_root(F.col("u")).alias("r")).collect()
    assert [r.r for r in roots] == ["ctx://u/skills/a", "", ""]
