import itertools
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import chunks as C
from tessera.operators import evaluation as E
from tessera.operators import joins as J
from tessera.operators import maintain as M
from tessera.operators import similar as K
from tessera.operators import windows as W
from tessera.plans import jobs as G
from tessera.sources import records as S
from tessera.sources import turns as T

DAY = datetime(2026, 1, 1, tzinfo=UTC)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_changes(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "id string, name string, n int")
    change = "id string, op string, seq int, `set` array<string>, name string, n int"
    new = M.apply_changes(base, spark.createDataFrame([("a", "update", 1, ["n"], None, None), ("b", "delete", 2, [], None, None), ("c", "update", 3, ["name"], "w", None), ("c", "update", 4, ["name"], "", None), ("d", "upsert", 5, [], "new", 9), ("b", "upsert", 6, [], "back", 5)], change))
    assert rows(new, "*") == [("a", "x", None), ("b", "back", 5), ("c", "", 3), ("d", "new", 9)]
    with pytest.raises(ValueError):
        M.apply_changes(base, spark.createDataFrame([("q", "update", 1, ["n"], None, 1)], change))
    assert {r.id: r.op for r in M.change_feed(base, new).collect()} == {"a": "update", "b": "update", "c": "update", "d": "insert"}
    left, gone = M.delete_scope(base, F.col("n") > 1, "name")
    assert rows(left, "id") == [("a",)] and gone.count() == 2 and M.clear(base).count() == 0


def test_snapshots_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ctx://a/1", 2, "resource", "text", [1.0, 2.0], 7, "acc"), ("ctx://a/2", 2, "memory", None, [3.0, 4.0], 1, "acc")], "uri string, level int, context_type string, content string, vector array<float>, active_count long, account_id string")
    head = S.export_snapshot(df, f"{tmp_path}/s", "model-1").first()
    assert head.entries == 2 and head.dim == 2
    target = df.limit(0)
    back = S.import_snapshot(spark, f"{tmp_path}/s", target, "ctx://a", "ctx://b", embedding="model-1")
    assert rows(back, "uri", "active_count", "recompute") == [("ctx://b/1", 0, False), ("ctx://b/2", 0, False)]
    assert S.import_snapshot(spark, f"{tmp_path}/s", target, "ctx://a", "ctx://a", embedding="other").where("vector IS NULL AND recompute").count() == 2
    with pytest.raises(ValueError):
        S.import_snapshot(spark, f"{tmp_path}/s", df, "ctx://a", "ctx://a")
    assert S.import_snapshot(spark, f"{tmp_path}/s", df.limit(1), "ctx://a", "ctx://a", on_conflict="skip").count() == 1
    with pytest.raises(ValueError):
        S.export_snapshot(df.withColumn("vector", F.when(F.col("level") == 2, F.slice("vector", 1, F.when(F.col("context_type") == "memory", 1).otherwise(2)))), f"{tmp_path}/t")
    S.write_records(df, f"{tmp_path}/r")
    assert "id" in spark.read.parquet(f"{tmp_path}/r").columns and S.read_records(spark, f"{tmp_path}/r").count() == 2
    to = S.inventory_export(str(tmp_path), records=df)
    assert spark.read.json(to).where("marker").first().body == '{"rows":2}'


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type":"user","sessionId":"s","message":{"role":"user","content":" hi "},"timestamp":"2026-01-01T00:00:00Z"}\n{"type":"summary"}\n{broken\n{"type":"assistant","sessionId":"s","message":{"role":"Assistant","content":"  "},"timestamp":"2026-01-02T00:00:00Z"}\n')
    good, bad = T.read_turn_logs(spark, f"{tmp_path}/log.jsonl", "typed")
    assert good.count() == 2 and bad.count() == 1
    assert T.normalize_turns(good).first().text == "hi" and T.normalize_turns(good).count() == 1
    assert T.read_turn_logs(spark, f"{tmp_path}/log.jsonl", "typed", datetime(2026, 1, 2, tzinfo=UTC))[0].count() == 1
    df = spark.createDataFrame([(1, "a", True), (2, "b", True), (2, "c", False), (3, "d", True)], "time_created int, id string, complete boolean")
    assert rows(T.read_turn_table(df, (1, "a")), "id") == [("b",)]


def test_units_are_packed(spark):
    units = spark.createDataFrame([("s", i, n, 1) for i, n in enumerate([5, 4, 9, 2, 2, 12, 1])] + [("t", 0, 3, 1)], "session string, pos int, tokens int, messages int")
    packed = [(r.session, r.batch, r.oversized) for r in W.pack_batches(units, 10, 100).orderBy("session", "pos").collect()]
    assert packed == [("s", 0, False), ("s", 0, False), ("s", 1, False), ("s", 2, False), ("s", 2, False), ("s", 3, True), ("s", 4, False), ("t", 0, False)]


def test_chunks(spark):
    for ch in "中a🙂":
        got = C.ranges(ch * 5000, 2000)
        assert [b - a for a, b, *_ in got] == [2000, 2000, 1000] and got[1][2] and got[0][3]
    text = "# A\n" + "line of text\n" * 80 + "\n## B\n" + "more\n" * 100
    parts = C.ranges(text, 500)
    assert "".join(text[a:b] for a, b, *_ in parts) == text and all(b - a <= 500 for a, b, *_ in parts) and C.ranges("", 9) == [(0, 0, False, False, "")]
    tab = "| h | k |\n|---|---|\n" + "| a | b |\n" * 100
    chunks = C.sections(tab, 200)
    assert all(len(c) <= 200 for c in chunks) and sum(c.startswith("| h | k |\n|---|---|\n") for c in chunks) > len(chunks) / 2
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = C.chunk_ranges(docs, 500)
    assert found.where("doc_id = 2").count() == 1 and C.pack_ranges(found, 1500).agg(F.max("batch")).first()[0] >= 1
    assert C.section_chunks(docs, 500).where("length(chunk) > 500").count() == 0


def test_links_and_ledger(spark):
    msgs = spark.createDataFrame([("c", 0, [("tool", "t1", "read", '{"uri":"ctx://r/1"}', None, "running")]), ("c", 1, [("tool", "t1", "read", None, "text", "completed"), ("text", None, None, None, None, None)]), ("c", 2, [("tool", "t2", "read", '{"uris":["ctx://user/me/x","ctx://user/you/y"]}', "ok", "completed"), ("tool", "t3", "read", '{"uri":"ctx://r/2"}', "ERROR no", "completed")])], "conv_id string, pos int, parts array<struct<type:string,tool_id:string,tool_name:string,tool_input:string,tool_output:string,tool_status:string>>")
    assert rows(J.read_lineage(msgs, "me"), "uri", "first_pos") == [("ctx://r/1", 1), ("ctx://user/me/x", 2)]
    ledger = spark.createDataFrame([("s", "u", "full", 1), ("s", "v", "uri", 9), ("s", "w", "full", 8)], "session string, uri string, tier string, turn int")
    cands = spark.createDataFrame([("s", x) for x in "uvwz"], "session string, uri string")
    assert rows(J.exclude_served(cands, ledger, 10, 3), "uri") == [("u",), ("v",), ("z",)]
    assert rows(J.update_ledger(ledger, cands.where("uri = 'u'").withColumn("tier", F.lit("full")), 10, 2), "uri", "turn") == [("u", 10), ("v", 9), ("w", 8)]
    assert {r.node: r.component for r in K.connected(spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 4)], "a int, b int")).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    urls = spark.createDataFrame([(1, "http://h.io/a/b?x#y", '<a href="c.html#z">1</a><A class=q HREF=\'/d\'>2</A><a href="mailto:x@y">3</a><a href="//o.io/e">4</a><a href="#top">5</a><a href="./c.html">6</a>')], "page_id int, url string, html string")
    assert [r.to_url for r in J.link_graph(urls).orderBy("pos").collect()] == ["http://h.io/a/c.html", "http://h.io/d", "http://o.io/e"]


def test_evaluation(spark):
    e = spark.createDataFrame([("c", "f1", "A"), ("c", "f2", "A"), ("c", "f3", "B"), ("c", "f4", "B")], "case_id string, fact string, grp string")
    a = spark.createDataFrame([("c", "f1", "x"), ("c", "f2", "x"), ("c", "f3", "y"), ("c", "f9", "y"), ("c", "f1", "x")], "case_id string, fact string, grp string")
    r = E.partition_grade(e, a).first()
    assert (r.recall, r.duplicates, r.missing, r.unexpected, r.misplaced, r.exact_groups) == (0.75, 1, 1, 1, 0, 0.5)
    rng = np.random.default_rng(1)
    for _ in range(200):
        m = rng.integers(0, 6, (rng.integers(1, 6), rng.integers(1, 7)))
        v = m if m.shape[0] <= m.shape[1] else m.T
        assert E.best_assignment(m) == max(sum(v[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(v.shape[1]), v.shape[0]))
    pairs = spark.createDataFrame([(i, 0, p, ok) for i, (x, y) in enumerate([(1, 0)] * 6 + [(0, 1)] + [(1, 1)] * 3) for p, ok in (("l", x), ("r", y))], "case_id int, repeat int, protocol string, success int")
    p = E.paired_outcomes(pairs, "l", "r").first()
    assert (p.both, p.left_only, p.right_only, p.neither) == (3, 6, 1, 0) and p.p == pytest.approx(0.125)
    runs = spark.createDataFrame([(1, "d", 1.0), (2, "d", 2.0), (3, "d", 9.0)], "run_id int, dataset string, qps double")
    s = E.run_summary(runs, ["qps"]).first()
    assert (s.median, s.mad, s.min, s.max) == (2.0, 1.0, 1.0, 9.0)
    with pytest.raises(ValueError):
        E.run_summary(runs.unionByName(runs), ["qps"])
    msgs = spark.createDataFrame([("c", i, r, DAY + timedelta(minutes=m)) for i, (r, m) in enumerate([("user", 0), ("assistant", 1), ("user", 5), ("assistant", 6), ("user", 60), ("assistant", 61)])], "conv_id string, msg_id int, role string, ts timestamp")
    fb = spark.createDataFrame([(5, DAY, "thumb_up", None), (5, DAY + timedelta(hours=1), "rated", -1)], "msg_id int, ts timestamp, kind string, rating int")
    assert rows(E.response_outcomes(msgs, fb), "msg_id", "outcome") == [(1, "reask"), (3, "followup"), (5, "negative")]


def test_rollups(spark):
    ev = spark.createDataFrame([("hits", "counter", {"a": "1"}, 2.0, 1), ("hits", "counter", {"a": "1"}, -5.0, 2), ("hits", "counter", {"a": "2"}, 1.0, 3), ("lat", "histogram", {}, 0.3, 1)], "name string, kind string, labels map<string,string>, value double, ts int")
    got = {(r.name, r.series): (r.value, r.dropped) for r in A.metric_rollup(ev, 1).collect()}
    assert got[("hits", "a=1")] == (2.0, 0) and got[("hits", None)][1] == 1
    heavy = spark.createDataFrame([("hits", "counter", {"a": str(i % 3 if i % 2 else i)}, 1.0, i) for i in range(400)], "name string, kind string, labels map<string,string>, value double, ts int")
    got = {r.series: (r.value, r.dropped) for r in A.metric_rollup(heavy, 3, approx=True).collect()}
    assert got == {"a=0": (67.0, 0), "a=1": (67.0, 0), "a=2": (67.0, 0), None: (None, 199)} or set(got) == {"a=0", "a=1", "a=2", None}
    assert A.BOUNDS[:4] == [0.01, 0.02, 0.05, 0.1] and A.BOUNDS[-1] == 5e6
    log = spark.createDataFrame([], "context_type string, n_results int, scores array<double>, reranked boolean, latency_ms double")
    assert A.retrieval_stats(log).count() <= 1


def test_latency_sketches_merge(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", DAY + timedelta(minutes=int(m)), 500 if i % 10 == 0 else 200, float(x)) for i, (m, x) in enumerate(zip(rng.integers(0, 7 * 1440, 6000), rng.exponential(50, 6000)))] + [("a", None, 200, 1.0), ("a", DAY, 200, None), ("a", DAY, 200, float("nan")), ("c", DAY, 500, None)]
    df = spark.createDataFrame(rows, "acc string, ts timestamp, status int, latency_ms double")
    hourly = A.latency_sketches(df, ("acc",))
    days = [hourly.where(F.date_trunc("day", "hour") == F.lit(DAY + timedelta(days=d))) for d in range(7)]
    put = days[0]
    for d in days[1:]:
        put = put.unionByName(d)
    got = {(r.acc, r.hours): r for r in A.health_windows(put, F.lit(DAY + timedelta(days=7)), keys=("acc",)).collect()}
    for (acc, hours), r in got.items():
        own = [x for x in rows if x[0] == acc and x[1] is not None and DAY + timedelta(days=7, hours=-hours) <= x[1]]
        assert r.requests == len(own) and r.error_rate == pytest.approx(sum(x[2] >= 500 for x in own) / len(own))
        values = np.sort([x[3] for x in own if x[3] is not None and x[3] == x[3]])
        if not len(values):
            assert r.p50 is None
            continue
        for q, v in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert np.searchsorted(values, v, "left") / len(values) - 0.02 <= q <= np.searchsorted(values, v, "right") / len(values) + 0.02
    assert {h for _, h in got} >= {24, 168} and got["c", 168].requests == 1


def test_jobs(spark):
    recs = spark.createDataFrame([(f"ctx://r/d/{i}.md", f"# T{i}\n\nalpha beta {'gamma ' * i}", f"abstract {i}", DAY, "resource") for i in range(6)], "uri string, content string, abstract string, updated_at timestamp, context_type string")
    req = spark.createDataFrame([(1, "alpha gamma"), (2, "nothing")], "qid long, query string")
    ledger = spark.createDataFrame([("1", "ctx://r/d/5.md", "full", 1)], "session string, uri string, tier string, turn int")
    ctx, after = G.assemble_context(req, recs, ledger, 2, 60, {"resource": 3}, F.lit(DAY))
    out = {r.qid: r for r in ctx.collect()}
    assert set(out) == {1} and out[1].tokens <= 60 and "ctx://r/d/5.md" not in out[1].context and after.count() > 1
    assert G.embed(recs.select("uri"), "uri", lambda s: s.map(lambda x: [1.0, float(len(x))]), 2).count() == 6
    with pytest.raises(Exception, match="finite numbers"):
        G.embed(recs.select("uri"), "uri", lambda s: s.map(lambda x: [1.0]), 2).collect()
    assert G.score(recs, ["uri"], lambda s: s.str.len() * float("nan")).where("new_score IS NULL").count() == 6
    docs = spark.createDataFrame([(1, "# x\nbody"), (2, "# x\nother")], "doc_id long, text string")
    plan, several, status = G.corpus_build(docs, lambda p: pd.DataFrame({"path": ["out.md"] * len(p), "content": p.text, "source": p.doc_id.astype(str)}), lambda p: pd.DataFrame({"path": [p.path.iloc[0]], "content": ["\n".join(sorted(p.content))]}), spark.createDataFrame([], "path string, content string"), spark.createDataFrame([], "path string, sha string"))
    assert rows(status, "source", "status") == [("1", "published"), ("2", "published")]
    assert rows(plan, "path", "action") == [("out.md", "created")] and several.first().sources == ["1", "2"]
    tree = G.rollup_hierarchy(recs.select("uri", "content"), 3)
    assert {r.uri for r in tree.collect()} >= {"ctx://r/d"}
    G.register_sql(spark, recs=recs)
    assert spark.sql("SELECT count(*) AS n FROM recs WHERE in_subtree(uri, 'ctx://r')").first().n == 6
    assert spark.sql("SELECT vec_dot(array(float(1), float(2)), array(float(3), float(4))) AS d").first().d == 11
    fold = G.field_merge_agg(spark.createDataFrame([("a", 1, 1.0, "x", "p"), ("a", 2, 2.0, "y", None), ("a", 3, None, "z", "q")], "k string, seq int, n double, first string, last string"), "k", {"n": "sum", "first": "immutable", "last": "replace"}).first()
    assert (fold.n, fold.first, fold.last) == (3.0, "x", "q")
    ok, bad = W.canonical_records(spark.createDataFrame([("b", "u", 1), ("a", "u", 1)], "id string, uri string, level int"))
    assert ok.first().id == "a" and bad.first().id == "b"


def test_similar_drafts_are_grouped_over_all_pairs(spark, sf, tmp_path, monkeypatch):
    import __spark_entry__

    few = [(7, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (51, [0.0, 0.0, 1.0]), (3, [0.7, 0.7, 0.0]), (52, [0.0, 0.0, 1.0]), (9, None), (8, [0.0, 0.0, 0.0])]
    spark.createDataFrame(few, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    expected = {7: 1, 1: 1, 3: 1, 51: 51, 52: 51, 8: 8, 9: 9}  # ids that 50 doesn't divide
    for block in (2048, 1):
        monkeypatch.setattr(K, "DRAFT_BLOCK", block)
        assert dict(map(tuple, __spark_entry__.queries()["j13_similar_drafts"](spark, str(tmp_path)).collect())) == expected

    d = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v = np.array([*d.embedding], float)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    head = d.vec_id.to_numpy().copy()
    for i, j in zip(*np.nonzero(v @ v.T >= 0.42)):
        if head[i] != head[j]:
            head[np.isin(head, (head[i], head[j]))] = min(head[i], head[j])
    assert len(set(head)) < len(head)
    monkeypatch.setattr(K, "DRAFT_BLOCK", 200)
    drafts = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    assert dict(map(tuple, K.similar_drafts(drafts, 0.42).collect())) == dict(zip(d.vec_id, map(int, head)))


def test_groups_of_any_size_are_reduced(spark):
    df = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(3000)] + [(None, 1), (None, 2)], "k string, v long").repartition(3)
    sizes = []

    def part(p):
        if len(p) > 400:
            raise ValueError("too many rows at once")
        return pd.DataFrame({"k": [p.k.iloc[0]], "n": [len(p)], "total": [p.v.sum()]})

    def merge(p):
        if p.k.iloc[0] == "k1":
            raise KeyError("k1")
        return pd.DataFrame({"k": [p.k.iloc[0]], "n": [p.n.sum()], "total": [p.total.sum()], "parts": [len(p)]})

    done, failed = G.reduce_groups(df, ["k"], merge, "k string, n long, total long, parts long", part, "k string, n long, total long", most_rows=200)
    got = {r.k: (r.n, r.total) for r in done.collect()}
    expected = {r.k: (r.n, r.t) for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("t")).collect()}
    assert got == {k: v for k, v in expected.items() if k != "k1"} and rows(failed, "k", "error") == [("k1", "KeyError: 'k1'")]
    assert done.where("k = 'hot'").first().parts >= 4 and sizes == []
    # a part that fails fails its group, and a function that lacks a column too
    done, failed = G.reduce_groups(df, ["k"], merge, "k string, n long, total long, parts long", part, "k string, n long, total long", most_rows=2000)
    assert failed.where("k = 'hot' AND error LIKE 'ValueError%'").count() == 1 and done.where("k = 'hot'").count() == 0
    done, failed = G.reduce_groups(df.limit(5), ["k"], lambda p: p[["k"]].head(1), "k string, n long")
    assert done.count() == 0 and failed.where("error LIKE 'columns are missing%'").count() > 0


def test_rollup_plans_are_flat_and_take_a_sample(spark):
    files = spark.createDataFrame([(f"ctx://r/a/{i % 3}/{i % 5}/{'x' * (i % 2)}{i}.md", f"# T{i}") for i in range(400)], "uri string, content string")
    size = lambda depth: len(G.rollup_hierarchy(files, depth)._jdf.queryExecution().optimizedPlan().toString())
    assert size(3) < 4 * size(1)
    found = {r.uri: r.summary for r in G.rollup_hierarchy(files, 3, sample=4, summarise=lambda body: F.size(F.split(body, "\n\n")).cast("string")).collect()}
    assert found["ctx://r/a/0/0"] == "4" and found["ctx://r/a/0"] == "4" and found["ctx://r/a"] == "3"


def brute_groups(ids, v, threshold):
    v = v / np.sqrt((v * v).sum(1, keepdims=True))
    head = np.array(ids).copy()
    for i, j in zip(*np.nonzero(v @ v.T >= threshold)):
        if head[i] != head[j]:
            head[np.isin(head, (head[i], head[j]))] = min(head[i], head[j])
    return dict(zip(ids, map(int, head)))


@pytest.mark.parametrize(("threshold", "block"), [(0.95, 2048), (0.95, 30), (0.8, 100), (0.3, 50), (-0.2, 50), (1.0, 2048)])
def test_similar_drafts_prune_and_find_all(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(K, "DRAFT_BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    v = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * rng.choice([0.01, 0.2, 0.5], (300, 1)), np.tile(centres[:1], (150, 1)) + rng.normal(size=(150, 8)) * 0.05, rng.normal(size=(50, 8))])
    v = np.round(v, 3)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(rng.permutation(500), v)], "id long, vector array<double>").repartition(4)
    rows = df.toPandas()
    # cosines next to the threshold would depend on rounding
    unit = np.array([*rows.vector]) / np.linalg.norm(np.array([*rows.vector]), axis=1, keepdims=True)
    edge = threshold if threshold < 1 else 1 - 1e-9
    assert np.abs(unit @ unit.T - edge).min() > 1e-12
    assert dict(map(tuple, K.similar_drafts(df, edge).collect())) == brute_groups(rows.id.tolist(), np.array([*rows.vector]), edge)


def test_clustered_drafts_are_compared_with_few(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.05
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    pivots = v[:54] / np.linalg.norm(v[:54], axis=1, keepdims=True)
    pairs = K.pairs_compared(K.dealt(K.filed(df, pivots), pivots, 0.95))
    assert pairs < 0.15 * 3000 * 2999 / 2


def test_fill_budget_takes_all_candidates(spark):
    columns = "qid long, uri string, score double, start_tier string, body_hash long, full long, overview long, abstract long, uri_cost long"
    copies = [(1, f"a{i:04}", 9.0, "overview", 7, 30, 1, 3, 900) for i in range(1500)]  # one body, before all others
    dear = [(2, f"d{i:04}", 9.0, "overview", i, 900, 900, 900, 900) for i in range(1500)]
    late = [(q, f"z{i}", 1.0 - i, "overview", 5000 + i, 30, 1, 3, 1) for q in (1, 2) for i in range(3)]
    none = [(None, "n1", 1.0, "overview", None, 40, 5, 3, 1), (None, "n2", None, "overview", None, 40, 5, 3, 1)]
    rows = G.fill_budget(spark.createDataFrame(copies + dear + late + none, columns), 100).collect()
    got = {(r.qid, r.uri): (r.tier, r.tokens, r.outcome) for r in rows}
    assert len(rows) == len(got) == 1500 + 1500 + 6 + 2
    assert got[1, "a0000"] == ("full", 30, "placed") and all(got[1, f"a{i:04}"] == (None, 0, "deduped") for i in range(1, 1500))
    assert [got[1, f"z{i}"][0] for i in range(3)] == ["full", "full", "overview"]
    assert all(got[2, f"d{i:04}"] == (None, 0, "dropped") for i in range(1500)) and all(got[2, f"z{i}"][0] for i in range(3))
    assert got[None, "n1"] == got[None, "n2"] == ("full", 40, "placed")


def brute_fill(rows, budget):
    """Placement by the rules, step by step: rows in order, each with costs, texts by tier and limits."""
    rank, placed, state = {"uri": 0, "abstract": 1, "overview": 2, "full": 3}, [], {}
    share, shown = max(1, budget // max(1, len(rows)) * 2), lambda r, t: ("uri", r["uri"]) if t == "uri" else (t, r["body"])
    spent = lambda: sum(r["cost"][t] for r, t in placed) + max(0, len(placed) - 1)
    for r in rows:
        down = [t for t in ("full", "overview", "abstract", "uri") if rank[t] <= rank[r["start"]]]
        if r["start"] == "abstract" and r["whole"]:
            down = ["abstract", "overview", "uri"]
        state[r["uri"]] = "dropped"
        for t in down:
            c = r["cost"][t]
            if c is not None and (t == "uri" or c <= share) and spent() + c + bool(placed) <= budget:
                if shown(r, t) in [shown(*p) for p in placed]:
                    state[r["uri"]] = "deduped"
                else:
                    placed.append((r, t))
                    state[r["uri"]] = "placed"
                break
    for to, capped in (("overview", 1), ("full", 1), ("full", 0), ("abstract", 0), ("overview", 0)):
        for i, (r, t) in enumerate(placed):
            c = r["cost"][to]
            ok = rank[t] < rank[to] <= rank[r["ceiling"]] and c is not None and not (capped and c > share)
            if ok and spent() - r["cost"][t] + c <= budget and shown(r, to) not in [shown(*p) for p in placed]:
                placed[i] = (r, to)
    tiers = {r["uri"]: t for r, t in placed}
    return {u: (s, tiers.get(u)) for u, s in state.items()}


def test_fill_budget_like_brute_force(spark):
    import random

    rng, requests, rows = random.Random(31), {}, []
    for q in range(500):
        own = []
        for i in range(rng.randrange(1, 9)):
            some = lambda a, b: rng.choice([rng.randrange(a, b)] * 5 + [None])
            own.append({"uri": f"u{i}", "body": rng.randrange(6), "start": rng.choice(["full", "overview", "abstract", "uri"]), "ceiling": rng.choice(["full", "full", "overview", "abstract"]), "whole": rng.random() < 0.3, "cost": {"full": some(5, 60), "overview": some(3, 25), "abstract": some(2, 12), "uri": rng.randrange(1, 6)}})
        requests[q] = own
        rows += [(q, r["uri"], -float(i), r["start"], r["body"], r["cost"]["full"], r["cost"]["overview"], r["cost"]["abstract"], r["cost"]["uri"], r["ceiling"], r["whole"]) for i, r in enumerate(own)]
    df = spark.createDataFrame(rows, "qid long, uri string, score double, start_tier string, body_hash long, full long, overview long, abstract long, uri_cost long, ceiling string, whole_abstract boolean").repartition(7)
    filled = G.fill_budget(df, 60).persist()
    got = {(r.qid, r.uri): (r.outcome, r.tier) for r in filled.collect()}
    for q, own in requests.items():
        assert {u: got[q, u] for u in (r["uri"] for r in own)} == brute_fill(own, 60), own
    for r in G.plan_stats(filled, 60).collect():
        state = brute_fill(requests[r.qid], 60)
        of = lambda s, state=state: sum(x == s for x, _ in state.values())
        assert r.overview_upgrades + r.full_upgrades + r.spare_upgrades == r.upgrades and r.floor_tokens <= 60 and (r.upgrades > 0 or r.floor_tokens == r.used_tokens)
        assert (r.returned, r.dropped, r.deduped, r.per_entry_cap) == (of("placed"), of("dropped"), of("deduped"), max(1, 60 // len(state) * 2)) and r.used_tokens <= 60


def test_conversation_language_counts_messages(spark):
    rows = [(1, "assistant", "это русский текст"), (1, "user", "这是一个关于数据的测试"), (2, "user", " "), (2, "assistant", "это русский текст"), (3, None, None)]
    got = dict(map(tuple, W.conversation_language(spark.createDataFrame(rows, "conv_id long, role string, text string")).collect()))
    assert got == {1: "zh-CN", 2: "ru", 3: "en"}


@pytest.mark.parametrize("values", [[], [3.0], [2.0, 1.0], [5.0] * 50, [float(i * i % 997) for i in range(3000)]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(g, v) for g in ("a", "b") for v in values] + [("a", None)], "g string, v double")
    got = {(r.g, r.share): r.value for r in A.quantiles(df, "v", [0.0, 0.5, 0.99, 1.0], ("g",)).collect()}
    assert got == pytest.approx({(g, q): float(np.quantile(values, q)) for g in "ab" for q in (0.0, 0.5, 0.99, 1.0)} if values else {})


def test_small_groups_share_batches_and_keep_their_types(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None if i % 50 == 0 else i % 50, big + i, None if i == 7 else i % 2 == 0, f"x{i}") for i in range(2000)], "k int, n long, b boolean, s string")

    def fn(p):
        if (p.k == 3).any():
            raise ValueError("three")
        assert list(p.columns) == ["k", "n", "b", "s"] and p.n.dtype == "int64" and list(p.index) == list(range(len(p)))
        assert p.b.dtype == ("object" if p.b.isna().any() else "bool") and p.k.dtype == ("float64" if p.k.isna().any() else "int32")
        return pd.DataFrame({"n": [p.n.max()], "c": [len(p)]})

    done, failed = G.reduce_groups(df, ["k"], fn, "n long, c long")
    assert rows(failed, "k", "error") == [(3, "ValueError: three")]
    assert sorted(r.n for r in done.collect()) == sorted(big + 1950 + i for i in range(50) if i != 3) and {r.c for r in done.collect()} == {40}
    frames = list(G._joined((pd.DataFrame({"a": [i]}) if i % 9 else pd.DataFrame({"a": [None], "e": ["x"]}) for i in range(1000)), ["a", "e"]))
    assert len(frames) == 2 and sum(map(len, frames)) == 1000


def test_failing_ranges_are_found_by_halves(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(1, 65)], "doc_id long, text string").coalesce(1)
    none = spark.createDataFrame([], "path string, content string, sha string")
    counted = spark.sparkContext.accumulator(0)

    def draft(p):
        counted.add(1)
        if (p.doc_id == 37).any():
            raise ValueError("unreadable")
        return pd.DataFrame({"path": p.doc_id.astype(str), "content": p.text, "source": p.doc_id.astype(str)})

    status = G.corpus_build(df, draft, lambda p: p[["path", "content"]], none.select("path", "content"), none.select("path", "sha"))[2]
    assert {r.source for r in status.where("status = 'failed'").collect()} == {"37"} and status.where("status = 'published'").count() == 63
    assert counted.value <= 40  # one by one: 64 and more


def test_copies_for_near_cells_are_sent_in_bounded_batches():
    """Without pruning each row goes to half of all blocks; a task holds so many copies only."""
    b = pa.RecordBatch.from_pydict({"id": list(range(20)), "vector": [[float(i)] for i in range(20)]})
    at, to = np.repeat(np.arange(20), 30), np.tile(np.arange(30), 20)
    parts = [*K._copies(b, at, to, to, to > 0, 64)]
    assert max(p.num_rows for p in parts) == 64
    whole = pa.Table.from_batches(parts)
    assert whole["id"].to_pylist() == at.tolist() and whole["cell"].to_pylist() == to.tolist() and whole["vector"].to_pylist() == [[float(i)] for i in at]


def test_ranges_of_few_texts_at_a_time(spark, monkeypatch):
    """Texts of a batch are cut some at a time; none is lost, nulls and long ones included."""
    texts = ["a" * 30, None, "", "# x\n" + "b c\n" * 40, "é" * 7]
    pieces = [t for _, t in C._pieces([pa.record_batch({"k": range(5), "text": texts})])]
    monkeypatch.setattr(C, "MOST_CHARS", 20)
    few = [t for _, t in C._pieces([pa.record_batch({"k": range(5), "text": texts})])]
    assert pieces == [[t or "" for t in texts]] and len(few) > 2 and sum(few, []) == pieces[0]
    found = C.chunk_ranges(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 25)
    assert sorted(map(tuple, found.collect())) == sorted((i, n, *r) for i, t in enumerate(texts) for n, r in enumerate(C.ranges(t or "", 25)))


def test_tokens_of_rows_are_counted_without_a_shuffle(spark, monkeypatch):
    """Rows of their own key aren't shuffled; those that share one are pooled; null and empty texts count nothing."""
    from tessera.operators import evaluation as E

    monkeypatch.setattr(E, "MOST_CHARS", 30)
    rows = [(1, "The cat, the cat sat!", "cat sat sat"), (2, None, "x"), (3, "", ""), (4, "a an", None), (5, "x " * 40, "x y"), (None, "x", "x")]
    once = spark.createDataFrame(rows, "id long, p string, t string")
    expected = {1: 2 * 2 / 6, 2: 0.0, 3: 0.0, 4: 0.0, 5: 2 / 42, None: 0.0}
    found = E.token_f1(once, "id", "p", "t")
    assert dict(map(tuple, found.collect())) == pytest.approx(expected) and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    twice = once.unionByName(spark.createDataFrame([(1, "sat", "dog"), (7, "u v", "v")], once.schema))
    pooled = sorted(map(tuple, E.token_f1(twice, "id", "p", "t").where("id IS NOT NULL").collect()))
    assert pooled == [pytest.approx(x) for x in [(1, 2 * 3 / 8), (1, 2 * 3 / 8), (2, 0.0), (3, 0.0), (4, 0.0), (5, 2 / 42), (7, 2 / 3)]]
