"""Vector operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import pigeonhole, vptree

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, score int"


def table(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((240, 24)).astype(np.float32)
    x[100:140] = x[0] + 0.02 * r.standard_normal((40, 24))  # a dense group
    x[200:210] = x[5]  # equal vectors
    rows = [(i, v.tolist(), 1, "x", 0) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [float("inf")] * 24), (905, [None] + [1.0] * 23), (906, [1.0, 2.0])]
    return spark.createDataFrame(rows + [(i, v, None, None, None) for i, v in odd] + [(None, x[3].tolist(), 1, "x", 0)], SCHEMA), x.astype(float)


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def test_exact_search(spark):
    df, x = table(spark)
    got = vptree.nearest(df, df.where("vec_id % 50 = 0"), k=5, shard_rows=60, query_rows=2, leaf=8).toPandas()
    c = cosines(x)
    for q in range(0, 240, 50):
        s = np.round(c[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(240), -s))[:5]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["vec_id"]) == list(want) and list(mine["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(mine["score"], c[q][want], atol=1e-12)
    assert set(got["query_id"]) == {0, 50, 100, 150, 200}


def test_relaxed_search_prunes_more():
    x = np.random.default_rng(1).standard_normal((2000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, ids, seen, recall = x[:50], np.arange(2000), [], []
    best = np.argsort(-(q @ x.T), axis=1)[:, 1:6]
    for factor in (1.0, 0.6):
        s = vptree.Searcher(x, ids, 5, factor, 32)
        found = s.search(q, ids[:50])[:, :5]
        seen.append(s.compared)
        recall.append(np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, best, strict=True)]))
    assert recall[0] == 1.0 and recall[1] > 0.5 and seen[1] < seen[0] < 2000 * 50


def test_pigeonhole_is_exact(spark):
    df, x = table(spark)
    got = pigeonhole.near_duplicates(df, block_dims=8, chunk_rows=50).where("vec_id is not null").toPandas().set_index("vec_id")
    linked = cosines(x) >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(240)
    for _ in range(240):
        label = np.array([min(label[i], label[linked[i]].min(initial=label[i])) for i in range(240)])
    # Row 3 appears once more without an id; it links with nothing.
    assert list(got.loc[range(240), "n_links"]) == list(linked.sum(axis=1))
    assert list(got.loc[range(240), "component_id"]) == list(label)
    odd = got.loc[range(900, 907)]
    assert not odd["n_links"].any() and odd["kept"].all() and list(odd["component_id"]) == list(range(900, 907))


def test_empty(spark):
    df = table(spark)[0].where(F.lit(False))
    assert pigeonhole.near_duplicates(df).count() == 0
    assert vptree.nearest(df, df).count() == 0


def test_regions_route_queries(spark):
    """Many regions, some with several shards, on clustered vectors of two lengths."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 16)) * 3
    x = (centres[r.integers(0, 12, 900)] + 0.2 * r.standard_normal((900, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2010 + i, v.tolist()) for i, v in enumerate(r.standard_normal((7, 3)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vptree.nearest(df, df.where("vec_id % 30 = 0"), shard_rows=40, query_rows=3, leaf=8, sample_rows=300, max_regions=16).toPandas()
    c = cosines(x.astype(float))
    for q in range(0, 900, 30):
        s = c[q].copy()
        s[q] = -9
        assert list(got[got["query_id"] == q].sort_values("rank")["vec_id"]) == list(np.lexsort((np.arange(900), -np.round(s, 12)))[:5])
    assert set(got[got["query_id"] == 2010]["vec_id"]) <= set(range(2011, 2017)) and len(got[got["query_id"] == 2010]) == 5
    tree = vptree.top_tree(x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True), 16)
    row, _ = vptree.regions_near(tree, x[:50].astype(float) / np.linalg.norm(x[:50], axis=1, keepdims=True), np.full(50, 0.1))
    assert 50 <= len(row) < 50 * 16 * 0.6  # regions are ruled out


def test_recall_by_factor_on_the_table(sf):
    """On the unstructured 64-dimension table pruning starts where recall falls."""
    import duckdb

    x = np.array([list(v) for (v,) in duckdb.sql(f"select embedding from '{sf}/embeddings.parquet' where embedding is not null order by vec_id").fetchall() if len(v) == 64], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, q = np.arange(len(x)), x[::5]
    s = q @ x.T
    s[np.arange(len(q)), ids[::5]] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    for factor, least in ((1.0, 1.0), (0.2, 0.9)):
        found = vptree.Searcher(x, ids, 5, factor, 32).search(q, ids[::5])[:, :5]
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, best, strict=True)]) >= least


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e300, 2e300, 0.0]), (2, [1e-300, 2e-300, 0.0]), (3, [1.0, 2.0, 0.0]), (4, [0.0, 0.0, 5e-324]), (5, [0.0, 0.0, 1e308]), (5, [0.0, 1.0, 1e308]), (6, [1.0, -2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.n_links, r.component_id) for r in pigeonhole.near_duplicates(df).collect()}
    assert {(1, 2, 1), (2, 2, 1), (3, 2, 1), (6, 0, 6)} <= got and {c for v, _, c in got if v in (4, 5)} == {4}
