"""Whitening against a dense decomposition, and odd rows."""

import math

import numpy as np
import pytest

from newsloom.llm import queries, whitening

NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, [1.0, None, 0.5]), (902, [NAN, 1.0, 0.0]), (903, [INF, 1.0, 0.0]), (905, []), (906, [1.0, 2.0])]
SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as id", "'x' as x", "0 as ids").repartition(3)


def whole(v):
    return np.floor(1024 * np.array(v, float)).astype(np.int64) + 100_000


def dense(rows, components=8):
    x = np.array([whole(v) for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    at = np.argsort(-values)[:components]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, values[at], values.sum(), centred @ vectors[:, at] / np.sqrt(values[at])


@pytest.mark.parametrize("seed, dim, n", [(1, 3, 40), (2, 24, 400), (3, 70, 300)])
def test_equals_dense_decomposition(spark, seed, dim, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.geomspace(1, 0.02, dim) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    tiles = whitening.pack(frame(spark, rows + [o for o in ODD if o[1] is None or len(o[1] or []) != dim or dim == 3]))
    model = whitening.fit(tiles)
    count, deviation, values, trace, z = dense(rows)
    assert model.n == count and model.dim == dim
    np.testing.assert_allclose(model.variances, values, rtol=1e-11)
    assert math.isclose(model.trace, trace, rel_tol=1e-12)
    assert model.identity_error(tiles) < 1e-9
    got = {r.vec_id: (r.deviation, r.whitened) for r in model.whiten(tiles).collect()}
    assert len(got) == n
    mine = np.array([got[i][1] for i, _ in rows])
    signs = np.sign((mine * z).sum(axis=0))
    np.testing.assert_allclose(mine * signs, z, atol=1e-8)
    assert [got[i][0] for i, _ in rows] == deviation


def test_fewer_steps_than_dimensions(spark):
    """A steep spectrum is found without stepping through all dimensions; the second start finds no more."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 120)) * np.r_[np.geomspace(1, 0.1, 8), np.full(112, 0.004)]
    model = whitening.fit(whitening.pack(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    assert len(model.steps) == 2 and model.steps[0] < 40
    _, _, values, _, _ = dense([(i, v) for i, v in enumerate(x)])
    np.testing.assert_allclose(model.variances, values, rtol=1e-11)


def test_equal_variances(spark):
    """All directions alike: every start finds one, and all are found."""
    rows = [(2 * i + s, [float(s * 2 - 1) if d == i else 0.0 for d in range(6)]) for i in range(6) for s in (0, 1)]
    tiles = whitening.pack(frame(spark, rows))
    model = whitening.fit(tiles)
    assert len(model.variances) == 6 and len(model.steps) > 1
    np.testing.assert_allclose(model.variances, model.variances[0], rtol=1e-12)
    np.testing.assert_allclose(model.vectors.T @ model.vectors, np.eye(6), atol=1e-10)
    assert model.identity_error(tiles) < 1e-10


def test_flat_directions_give_no_component(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)] + [(0, [0.0, 0.0, 5.0]), (None, [1.0, 2.0, 5.0])]
    tiles = whitening.pack(frame(spark, rows))
    model = whitening.fit(tiles)
    assert len(model.variances) == 1 and model.n == 22
    got = model.whiten(tiles).collect()
    assert len(got) == 22 and sum(r.vec_id is None for r in got) == 1 and sum(r.vec_id == 0 for r in got) == 2


def test_one_vector_and_none(spark):
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert len(whitening.fit(whitening.pack(frame(spark, rows))).variances) == 0
    assert whitening.fit(whitening.pack(frame(spark, []))) is None
    assert whitening.fit(whitening.pack(frame(spark, [(1, None), (2, [])]))) is None


def test_commonest_length(spark):
    tiles = whitening.pack(frame(spark, [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 1.0]), (5, [1.0, 2.0, 3.0])]))
    assert tiles.dim == 2 and whitening.fit(tiles).n == 2


def test_huge_components(spark):
    """Beyond a long: defined, without a deviation."""
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e9, 2.0])]
    tiles = whitening.pack(frame(spark, rows))
    model = whitening.fit(tiles)
    got = {r.vec_id: r for r in model.whiten(tiles).collect()}
    assert got[1].deviation is None and all(np.isfinite(r.whitened).all() for r in got.values())
    small = [(1, [1e9, 0.0]), (2, [3.0, 1.0])]
    tiles = whitening.pack(frame(spark, small))
    model = whitening.fit(tiles)
    want = dense(small)[1]
    assert {r.vec_id: r.deviation for r in model.whiten(tiles).collect()} == {i + 1: (d if d < 2**63 else None) for i, d in enumerate(want)}


def test_query(spark, sf_dir):
    got = queries.op12_embedding_whitening(spark, sf_dir).toPandas()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in vectors]
    n, deviation, values, trace, z = dense(rows)
    assert len(got) == 8 * n and (got["n"] == n).all() and (got["identity_error"] < 1e-6).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    np.testing.assert_allclose(wide * np.sign((wide * z).sum(axis=0)), z, atol=1e-7)
    np.testing.assert_allclose(got.groupby("component")["explained"].first(), values / trace, rtol=1e-9)
    first = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert [first[i] for i, _ in rows] == deviation
