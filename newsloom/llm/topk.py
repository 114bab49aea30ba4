"""Exact top-k by inner product: tiled matrix products, partial selection, tree merge.

Vectors are dealt by a hash of their id into tiles of about ``tile_rows`` rows. Each tile of
queries meets each tile of candidates once, as a matrix product; the task keeps the k best of
every query in it. These short lists are merged by fan-in, level by level, so that no task
ever sees more than ``fan_in`` lists of a query.

Edge cases: vectors that are null or hold null or non-finite components take no part, neither
do rows without an id. Rows that share an id count once (the smallest vector of them, in
order). Only vectors of one length are compared with each other. Ties go to the smaller id. A
query with fewer than k candidates returns all it has. Vectors with a component so large that
its multiple is not finite take no part. A score beyond the range of a long is given as the
end of the range, and ranked as that between tiles. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = float(1 << 53)  # doubles hold all integers below
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )


def _pack(rows: DataFrame, n_tiles: int, scale: int) -> DataFrame:
    """Tiles: (dim, tile, ids, values), the vectors as integers floor(scale * x) in row order."""

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = np.array(frame["vector"].tolist(), dtype=np.float64).reshape(len(frame), int(key[0]))
        values = np.floor(values * scale)
        ids = frame["id"].to_numpy(np.int64)
        order = np.lexsort([*values.T[::-1], ids]) if values.shape[1] else np.argsort(ids)
        ids, values = ids[order], values[order]
        first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
        return pd.DataFrame({
            "dim": [int(key[0])], "tile": [int(key[1])], "ids": [ids[first].tobytes()], "values": [values[first].tobytes()],
        })

    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(n_tiles)).cast("int"))
    return dealt.groupBy(F.size("vector").alias("dim"), "tile").applyInPandas(pack, "dim int, tile int, ids binary, values binary")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond 2**53 in Python integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= EXACT:
        whole = np.vectorize(int, otypes=[object])
        return whole(a) @ whole(b).T
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best columns of one row, ties to the smaller id (ids ascend)."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    bound = np.partition(scores, len(scores) - k)[len(scores) - k]
    more = np.flatnonzero(scores > bound)
    level = np.flatnonzero(scores == bound)[: k - len(more)]
    at = np.concatenate([more, level])
    return at[np.lexsort([ids[at], -scores[at]])]


def top_k(
    vectors: DataFrame, queries: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 64, tile_rows: int = 8192, fan_in: int = 16,
) -> DataFrame:
    """The k best candidates of every query: (query_id, rank, vec_id, score).

    ``queries`` is a condition on ``vectors``; every other row of the same length is a candidate.
    The score is the inner product of floor(scale * x).
    """
    fits = usable(F.transform(vector_col, lambda x: x.cast("double") * scale))
    rows = vectors.filter(fits & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks"),
    )
    n, asking = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, query_tiles = -(-n // tile_rows) or 1, -(-asking // tile_rows) or 1
    held = _pack(rows.drop("asks"), shards, scale)
    asked = _pack(rows.filter("asks").drop("asks"), query_tiles, scale).select(
        "dim", F.col("tile").alias("query_tile"), F.col("ids").alias("query_ids"), F.col("values").alias("query_values"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("tile"),
    )
    tiles = asked.join(held, ["dim", "tile"])

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q_ids, ids = np.frombuffer(row.query_ids, np.int64), np.frombuffer(row.ids, np.int64)
                q = np.frombuffer(row.query_values, np.float64).reshape(len(q_ids), row.dim)
                v = np.frombuffer(row.values, np.float64).reshape(len(ids), row.dim)
                out: list[tuple[np.ndarray, ...]] = []
                for start in range(0, len(q_ids), 256):
                    scores = _products(q[start : start + 256], v)
                    for one, own in zip(scores, q_ids[start : start + 256], strict=True):
                        at = _best(one, ids, k + 1)
                        at = at[ids[at] != own][:k]
                        score = np.clip(one[at], -LONG - 1, LONG) if one.dtype == object else one[at]
                        out.append((np.full(len(at), own), ids[at], score.astype(np.int64)))
                if out:
                    asker, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pd.DataFrame({"query_id": asker, "vec_id": found, "score": score, "node": row.tile})

    best = tiles.mapInPandas(select, "query_id long, vec_id long, score long, node int")
    order = [F.desc("score"), F.asc("vec_id")]
    nodes = shards
    while nodes > fan_in:
        nodes = -(-nodes // fan_in)
        best = best.withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "node").orderBy(*order)))
        best = best.filter(F.col("rank") <= k).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
