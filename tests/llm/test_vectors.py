"""Top-k and links of vectors against brute force, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm.embedding_links import embedding_links
from newsloom.llm.topk import top_k

NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, [1.0, None, 0.5]), (902, [NAN, 1.0, 0.0]), (903, [INF, 1.0, 0.0]), (904, [0.0, 0.0, 0.0]), (905, []), (None, [1.0, 0.0, 0.0]), (906, [1.0, 2.0])]


def clustered(seed, n, dim=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(scale=0.15, size=dim)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[i % 5][1]) for i in range(40)]  # copies


def brute_links(rows, cosine):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = v @ v.T >= cosine
    np.fill_diagonal(links, False)
    low = np.array(ids)
    while True:
        new = np.array([min([low[i], *low[links[i]]]) for i in range(len(ids))])
        if (new == low).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, links.sum(axis=1), low, strict=True)}
        low = new


@pytest.mark.parametrize("seed, tile_rows, pivots", [(1, 30, 1024), (2, 8, 5), (3, 4096, 9)])
def test_links_equal_brute_force(spark, seed, tile_rows, pivots):
    rows = clustered(seed, 260)
    df = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "'x' as cell")
    got = {r.vec_id: r for r in embedding_links(df, 0.95, tile_rows=tile_rows, max_pivots=pivots).collect()}
    expected = brute_links(rows, 0.95)
    assert {k: (got[k].n_links, got[k].component_id) for k in expected} == expected
    assert all(got[k].kept == (got[k].component_id == k) for k in expected)
    for i, _ in ODD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows) + len(ODD)


def test_links_of_nothing(spark):
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_huge_and_tiny_vectors(spark):
    df = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [-1.0, -1.0])], "vec_id long, embedding array<double>")
    assert [(r.n_links, r.component_id) for r in embedding_links(df).orderBy("vec_id").collect()] == [(1, 1), (1, 1), (0, 3)]


@pytest.mark.parametrize("tile_rows, fan_in", [(8, 2), (4096, 16)])
def test_top_k_equals_brute_force(spark, tile_rows, fan_in):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.normal(size=3), 1).tolist()) for i in range(150)]  # many ties
    df = spark.createDataFrame(rows + rows[:3] + ODD, "vec_id long, embedding array<double>").selectExpr("*", "1 as tile", "'x' as rank")
    got = {}
    for r in top_k(df, F.col("vec_id") % 10 == 0, 7, tile_rows=tile_rows, fan_in=fan_in).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(64 * np.array(v)) for i, v in rows + [ODD[4]]}
    for q in [i for i in whole if i % 10 == 0]:
        best = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:7]
        assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not got


def test_top_k_beyond_doubles(spark):
    rows = [(0, [float(2**40), 1.0]), (1, [float(2**8), 0.0]), (2, [float(2**8), 1 / 64])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()] == [(2, 2**60 + 64), (1, 2**60)]


def test_top_k_of_nothing(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True), 3).count() == 0
