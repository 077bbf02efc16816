"""Hybrid search, sparse rows and the signature index against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve as R
from tessera.operators import signatures as I
from tessera.plans import jobs as G


def vectors(spark, m, **more):
    rows = [(i, [float(x) for x in v], *(c[i] for c in more.values())) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, vector array<float>" + "".join(f", {c} long" for c in more))


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(8)
    m, q = rng.normal(size=(300, 6)), rng.normal(size=(12, 6))
    postings = [(int(i), f"t{t}", float(w)) for i in range(20, 320) for t, w in zip(rng.choice(40, 5, replace=False), rng.integers(1, 5, 5))]
    asked = [(int(i), f"t{t}", float(w)) for i in range(4, 16) for t, w in zip(rng.choice(45, 4, replace=False), rng.integers(1, 4, 4))]
    return m, q, postings, asked


def brute_hybrid(world, k, alpha):
    m, q, postings, asked = world
    dense = unit(q) @ unit(m).T
    sparse = {}
    for i, t, w in postings:
        for qid, u, x in asked:
            if t == u:
                sparse[qid, i] = sparse.get((qid, i), 0) + w * x
    out = {}
    for qid in range(16):
        scores = {i: (1 - alpha) * dense[qid, i] for i in range(300)} if qid < 12 else {}
        for (a, i), s in sparse.items():
            if a == qid:
                scores[i] = scores.get(i, 0) + alpha * s
        out |= {(qid, i): r for r, (i, _) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1)}
    return out


def test_rows_that_cannot_reach_the_best_are_not_scored(monkeypatch):
    """Of 2,000 rows of one word beside 20 of many words, most are never scored, and nothing is lost, ties included."""
    monkeypatch.setattr(R, "TILE", 400)
    rng = np.random.default_rng(3)
    asked = R._Asked(pa.table({"qid": [q for q in range(10) for _ in range(30)], "term": [f"t{t:02}" for _ in range(10) for t in range(30)], "w": [1.0] * 300}))
    n = rng.permutation(np.r_[np.full(20, 25), np.ones(2000, int)])
    row, term = np.repeat(np.arange(2020), n), np.concatenate([rng.choice(30, i, replace=False) for i in n])
    weight, scored, scores = rng.integers(1, 3, len(row)).astype(float), [], R._Asked.scores
    monkeypatch.setattr(R._Asked, "scores", lambda self, *a: scored.append(a[-1]) or scores(self, *a))
    floor = np.full(10, -np.inf)
    found = R._best_of(asked.best(pa.array(range(2020)), row, term, weight, 5, floor), 5, floor)
    total = np.bincount(row, weights=weight)
    best = sorted(range(2020), key=lambda i: (-total[i], i))[:5]
    assert found["id"].to_pylist() == best * 10 and found["score"].to_pylist() == [*total[best]] * 10
    assert sum(scored) < 100


@pytest.mark.parametrize(("most", "form"), [(R.MOST_BROADCAST, "postings"), (20, "postings"), (R.MOST_BROADCAST, "rows"), (20, "rows")])
def test_hybrid_loses_no_row(spark, world, most, form, monkeypatch):
    monkeypatch.setattr(R, "TILE", 500)
    m, q, postings, asked = world
    sparse = spark.createDataFrame(postings, "id long, term string, w double")
    if form == "rows":
        sparse = sparse.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    queries = vectors(spark, q).withColumnRenamed("id", "qid")
    found = R.hybrid_knn(vectors(spark, m).repartition(3), queries, sparse, spark.createDataFrame(asked, "qid long, term string, w double"), 7, 0.4, most_broadcast=most, most_terms=most)
    assert {(r.qid, r.id): r["rank"] for r in found.collect()} == brute_hybrid(world, 7, 0.4)


def test_hybrid_with_odd_rows(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (None, [1.0, 1.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "qid long, vector array<float>")
    postings = spark.createDataFrame([(2, "a", 1.0), (3, "b", 1.0), (9, "a", 5.0), (4, None, 1.0)], "id long, term string, w double")
    asked = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (2, None, 1.0)], "qid long, term string, w double")
    got = {(r.qid, r.id): round(r.score, 6) for r in R.hybrid_knn(corpus, queries, postings, asked, 5, 0.5).collect()}
    assert got == {(1, 9): 2.5, (1, 1): 0.5, (1, 2): 0.5, (1, 4): 0.0, (2, 3): 0.5}
    assert R.hybrid_knn(corpus.limit(0), queries, postings.limit(0), asked, 5).count() == 0
    assert R.hybrid_knn(corpus, queries.limit(0), postings, asked.limit(0), 5).count() == 0


def test_a_row_good_on_both_sides_is_found(spark):
    """Row 500 is 60th by vector and 60th by words, and the best of all by both."""
    n = 400
    angle = np.linspace(0.01, 1.2, n)
    recs = [(f"ctx://r/{i}", f"{'alpha ' * (1 if i == 0 else 0)}filler", [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    recs += [(f"ctx://w/{i}", "alpha " * (40 + i) + "x", [-1.0, 0.0]) for i in range(n)]
    recs += [("ctx://both", "alpha alpha alpha", [float(np.cos(0.4)), float(np.sin(0.4))])]
    records = spark.createDataFrame(recs, "uri string, content string, vector array<float>").repartition(4)
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0])], "qid long, query string, vector array<float>")
    assert G.find(records, queries, 1).first().uri == "ctx://both"


def test_sparse_distances(spark, world):
    _, _, postings, asked = world
    corpus = spark.createDataFrame(postings, "id long, term string, w double")
    queries = spark.createDataFrame(asked, "qid long, term string, w double")
    rows = corpus.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    norm = lambda ps, key: {i: sum(w * w for a, _, w in ps if a == i) for i in {p[0] for p in ps}}
    a, b, both = norm(postings, 0), norm(asked, 0), {}
    for i, t, w in postings:
        for qid, u, x in asked:
            if t == u:
                both[qid, i] = both.get((qid, i), 0) + w * x
    expected = {(q, i): a[i] + b[q] - 2 * s for (q, i), s in both.items()}
    for one in (corpus, rows):
        for most in (R.MOST_TERMS, 3):
            assert {(r.qid, r.id): r.distance2 for r in R.sparse_l2(one, queries, most_terms=most).collect()} == pytest.approx(expected)
        nearest = {(r.qid, r["rank"]): r.id for r in R.sparse_l2(one, queries, 3).collect()}
        for q in b:
            order = sorted((d, i) for (p, i), d in expected.items() if p == q)[:3]
            assert [nearest[q, n + 1] for n in range(len(order))] == [i for _, i in order]


def clustered(n=4000, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    return centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dim)) * 0.25, rng


def test_signature_index_finds_neighbours_in_few_cells(spark, tmp_path):
    m, rng = clustered()
    path = f"{tmp_path}/index"
    I.build_index(vectors(spark, m, label=[int(x) for x in rng.integers(0, 10, len(m))]), path, n_tables=6, n_bits=8, keep=("label",))
    rows, planes, probes = I.open_index(spark, path)
    assert rows.count() == 6 * len(m) and max(r["count"] for r in rows.where("tab = 0").groupBy("bucket").count().collect()) < len(m) / 10
    assert probes[10] <= 40  # of 256
    asked = m[:40] + rng.normal(size=(40, 24)) * 0.05
    queries = vectors(spark, asked).withColumnRenamed("id", "qid")
    best = np.argsort(-(unit(asked) @ unit(m).T), axis=1)[:, :10]
    found = {}
    for r in I.search_index(spark, path, queries).collect():
        found.setdefault(r.qid, []).append(r.id)
    assert all(len(v) == len(set(v)) == 10 for v in found.values())
    assert np.mean([len(set(found[q]) & set(best[q])) / 10 for q in range(40)]) >= 0.9
    one = I._scan(rows, queries.where("qid = 3").toArrow(), planes, 3, 10, "bigint")
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().toString()
    near = planes.nearest(unit(asked[3:4]), 3)
    cells = {int(c) for c in planes.cells(*(x.ravel() for x in (np.indices(near.shape)[1], near)))}
    assert len(cells) <= 18 < rows.select("cell").distinct().count()
    assert {(r.tab, r.bucket) for r in rows.where(F.col("cell").isin(sorted(cells))).select("tab", "bucket").distinct().collect()} >= {(t, int(x)) for t in range(6) for x in near[0, t] if rows.where((F.col("tab") == t) & (F.col("bucket") == int(x))).count()}


def test_signature_index_with_filters_and_odd_rows(spark, tmp_path):
    m, rng = clustered(1500)
    labels = [int(x) for x in rng.integers(0, 30, len(m))]
    odd = spark.createDataFrame([(9001, None, 1), (9002, [0.0] * 24, 1)], "id long, vector array<float>, label long")
    path = f"{tmp_path}/index"
    I.build_index(vectors(spark, m, label=labels).unionByName(odd), path, keep=("label",))
    queries = vectors(spark, m[:20]).withColumnRenamed("id", "qid").unionByName(spark.createDataFrame([(77, None), (78, [0.0] * 24)], "qid long, vector array<float>"))
    found = I.search_index(spark, path, queries, 10, where=F.col("label") == 3).collect()
    assert all(labels[r.id] == 3 for r in found) and {r.qid for r in found} == set(range(20))
    own = np.flatnonzero(np.array(labels) == 3)
    best = own[np.argsort(-(unit(m[:20]) @ unit(m[own]).T), axis=1)[:, :10]]
    assert np.mean([len({r.id for r in found if r.qid == q} & set(best[q])) / 10 for q in range(20)]) >= 0.9
    # fewer rows than k pass: all of them come, from the exact search
    rare = I.search_index(spark, path, queries, 10, where=F.col("id") < 5).collect()
    assert len(rare) == 20 * 5
    assert I.search_index(spark, path, queries.limit(0), 10).count() == 0
    with pytest.raises(ValueError, match="bits"):
        I.build_index(vectors(spark, m), path, n_bits=40)


def test_sparse_queries_beyond_a_broadcast_are_scanned_in_groups(spark, world):
    """No join of terms, whose pairs grow with the product of both sides."""
    _, _, postings, asked = world
    corpus = spark.createDataFrame(postings, "id long, term string, w double")
    queries = spark.createDataFrame(asked, "qid long, term string, w double")
    rows = corpus.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    for found in (R.sparse_knn(rows, queries, 5, most_terms=3), R.sparse_knn(corpus, queries, 5, most_terms=3), R.sparse_l2(rows, queries, most_terms=3), R.sparse_l2(rows, queries, 5, most_terms=3)):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_bound_the_products_of_terms_that_many_queries_ask_for(monkeypatch):
    rng = np.random.default_rng(2)
    n, terms = 400, 30
    entries = [(q, f"t{t:02}", 1.0 + q % 3) for q in range(n) for t in range(terms) if rng.random() < 0.5 or t == q % terms]
    asked = R._Asked(pa.table(dict(zip(("qid", "term", "w"), map(list, zip(*entries)), strict=True))))
    row, term = map(np.array, zip(*((r, t) for r in range(300) for t in range(terms) if rng.random() < 0.6)))
    for weight in (rng.integers(1, 9, len(row)).astype(float), rng.random(len(row))):
        dense, by_row = np.zeros((n, terms)), np.zeros((terms, 300))
        dense[[e[0] for e in entries], [int(e[1][1:]) for e in entries]] = [e[2] for e in entries]
        by_row[term, row] = weight
        dense = dense[asked.qids.to_pylist()]
        assert np.allclose(asked.scores(row, term, weight, 300), dense @ by_row, rtol=1e-12)
        monkeypatch.setattr(R, "TILE", 20_000)
        parts = list(asked.tiles(row, term, weight, 300, n))
        single = np.where(asked.by_matrix(term, weight), 0, np.diff(asked.start)[term])
        assert [lo for lo, _, _ in parts[1:]] == [hi for _, hi, _ in parts[:-1]] and parts[-1][1] == 300
        assert max(single[at].sum() + (hi - lo) * n for lo, hi, at in parts) <= 2 * R.TILE


def test_approximate_search_shuffles_only_the_best_of_a_partition(spark, monkeypatch):
    m, rng = clustered(1500)
    corpus, queries = vectors(spark, m).repartition(3), vectors(spark, m[:60] + rng.normal(size=(60, 24)) * 0.05).withColumnRenamed("id", "qid")
    plain = lambda df: sorted((r.qid, r.id, r["rank"], round(r.score, 9)) for r in df.collect())
    found = R.knn_approx(corpus, queries, 10, n_lists=30, n_probe=30)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert plain(found) == plain(R.knn(corpus, queries, 10))  # all lists
    few = plain(R.knn_approx(corpus, queries, 10, n_lists=30, n_probe=2))
    centroids = R.fit_centroids(R._sample(corpus), 30)
    own, q = (unit(m) @ centroids.T).argmax(1), unit(np.array([r.vector for r in queries.orderBy("qid").collect()]))
    scores = np.where((np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1) < 2)[:, own], q @ unit(m).T, -np.inf)
    assert {(a, b) for a, b, *_ in few} == {(i, int(j)) for i in range(60) for j in np.argsort(-scores[i], kind="stable")[:10] if scores[i, j] > -np.inf}
    monkeypatch.setattr(R, "MOST_BROADCAST", 300)
    assert plain(R.knn_approx(corpus, queries, 10, n_lists=30, n_probe=2)) == few


@pytest.mark.parametrize("most", [R.MOST_KEPT, 2])
def test_texts_are_counted_in_the_worker_that_scores_them(spark, most, monkeypatch):
    """Texts find what their postings find, in one Python step for each group of queries, whose kept rows are bounded."""
    monkeypatch.setattr(R, "MOST_KEPT", most)
    texts = spark.createDataFrame([(1, "a b, B"), (2, None), (3, "c a!"), (4, ""), (5, "d d b"), (6, "z z a b c")], "id long, text string")
    asked = spark.createDataFrame([(8, "a", 1.0), (8, "b", 2.0), (9, "c", 1.0), (7, "d", 0.5), (7, "a", 1.0)], "qid long, term string, w double")
    postings = texts.select("id", F.explode(R.tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    found = R.sparse_knn(texts, asked, 2)
    assert rows(found) == rows(R.sparse_knn(postings, asked, 2)) and len(rows(found)) == 6
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == (1 if most > 2 else 3)
    for k in (None, 2):
        assert rows(R.sparse_l2(texts, asked, k)) == rows(R.sparse_l2(postings, asked, k))
    m = vectors(spark, [[1.0, 0.0], [0.5, 1.0], [0.0, 1.0]])
    assert rows(R.hybrid_knn(m, m.withColumnRenamed("id", "qid"), texts, asked, 2)) == rows(R.hybrid_knn(m, m.withColumnRenamed("id", "qid"), postings, asked, 2))


def test_kept_rows_are_not_sorted_for_a_few_new_ones(monkeypatch):
    """A hundred tables of one row beside 1,000 kept ones are one more merge, and the best are the same."""
    rng, merges, concat = np.random.default_rng(2), [], pa.concat_tables
    tables = [pa.table({"q": pa.array(np.repeat(np.arange(100), n)), "id": pa.array(rng.permutation(100 * n) + 10_000 * i), "score": pa.array(rng.random(100 * n))}) if n > 1 else pa.table({"q": [i], "id": [i], "score": [0.99]}) for i, n in enumerate([10] + [1] * 99)]
    monkeypatch.setattr(pa, "concat_tables", lambda ts: merges.append(len(ts)) or concat(ts))
    found = R._best_of(iter(tables), 10).to_pylist()
    every = sorted((r for t in tables for r in t.to_pylist()), key=lambda r: (r["q"], -r["score"], r["id"]))
    assert found == [r for q in range(100) for r in [x for x in every if x["q"] == q][:10]] and len(merges) == 2


def test_scores_of_a_slice_take_bounded_memory():
    """500 queries against 4,000 rows whose words many of them ask for: the arrays of a tile stay under 50 MB."""
    import tracemalloc

    rng = np.random.default_rng(4)
    asked = R._Asked(pa.table({"qid": np.repeat(np.arange(500), 40), "term": [f"t{t:03}" for _ in range(500) for t in rng.choice(400, 40, replace=False)], "w": rng.random(20_000)}))
    row, term = np.repeat(np.arange(4000), 50), np.concatenate([rng.choice(400, 50, replace=False) for _ in range(4000)])
    weight, floor = rng.random(len(row)), np.full(500, -np.inf)
    tracemalloc.start()
    found = R._best_of(asked.best(pa.array(np.arange(4000)), row, term, weight, 10, floor), 10, floor)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 5000 and peak < 50e6


@pytest.mark.parametrize("most", [R.MOST_TERMS, 3])
def test_pairs_of_sparse_distances_are_neither_shuffled_nor_staged(spark, most):
    """Texts are read, scored and sent on, also for several groups of queries, so that disk doesn't grow with the pairs."""
    texts = spark.createDataFrame([(1, "a b, B"), (2, None), (3, "c a!"), (5, "d d b")], "id long, text string")
    asked = spark.createDataFrame([(8, "a", 1.0), (8, "b", 2.0), (9, "c", 1.0), (7, "d", 0.5), (7, "a", 1.0)], "qid long, term string, w double")
    found = R.sparse_l2(texts, asked, most_terms=most)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "parquet" not in plan and plan.count("MapInArrow") == (1 if most > 3 else 2)
    assert sorted((r.qid, r.id, r.distance2) for r in found.collect()) == [(7, 1, 4.25), (7, 3, 1.25), (7, 5, 4.25), (8, 1, 0.0), (8, 3, 5.0), (8, 5, 6.0), (9, 3, 1.0)]


@pytest.mark.parametrize("whole", [True, False])
def test_nearest_rows_are_found_without_scoring_all(monkeypatch, whole):
    """Long rows that repeat words are far from every query: they are hardly scored, and the nearest are those of all pairs."""
    rng = np.random.default_rng(6)
    n, q, terms = 3000, 200, 300
    a = np.zeros((n, terms))
    for i in range(n):
        at = rng.choice(terms, rng.integers(1, 12) if i % 10 == 0 else 150, replace=False)
        a[i, at] = rng.integers(1, 9, len(at)) if whole else rng.normal(size=len(at)) * 4
    b = np.where(rng.random((q, terms)) < 0.05, 1.0 if whole else rng.normal(size=(q, terms)), 0.0)
    b[:, 0] = 1.0
    of_query, of_term = np.nonzero(b)
    asked = R._Asked(pa.table({"qid": of_query, "term": of_term, "w": b[of_query, of_term]}))
    row, term = np.nonzero(a)
    code = np.searchsorted(asked.terms.to_numpy(), term)
    scored, scores = [], R._Asked.scores
    monkeypatch.setattr(R._Asked, "scores", lambda self, *args: scored.append(len(self.qids) * args[-1]) or scores(self, *args))
    monkeypatch.setattr(R, "TILE", 20_000)
    floor, b2, a2 = np.full(q, -np.inf), (b * b).sum(1), (a * a).sum(1)
    cuts = np.searchsorted(row, [0, 1000, 2000, 3000])
    slices = (t for s in range(3) for t in asked.nearest(pa.array(np.arange(1000 * s, 1000 * s + 1000)), row[cuts[s] : cuts[s + 1]] - 1000 * s, code[cuts[s] : cuts[s + 1]], a[row, term][cuts[s] : cuts[s + 1]], a2[1000 * s : 1000 * s + 1000], b2, 5, floor))
    found = R._best_of(slices, 5, floor)
    far = np.where(b @ a.T > 0, a2[None] + b2[:, None] - 2 * (b @ a.T), np.inf)
    expected = np.sort(far, axis=1)[:, :5].ravel()
    assert -found["score"].to_numpy() == pytest.approx(expected)
    if whole:
        assert found["id"].to_pylist() == [int(j) for i in range(q) for j in np.argsort(far[i], kind="stable")[:5]]
    assert sum(scored) < 0.5 * n * q
