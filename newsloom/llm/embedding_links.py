"""Near-duplicate vectors by an exact metric range join.

On the unit sphere a cosine of c is a distance of sqrt(2 - 2c), the range. Pivots part the
sphere into cells, each vector living in the cell of its nearest pivot p. It may have a
neighbour in the cell of q only if it lies within the range of the plane between p and q, which
follows from the triangle inequality: (d(v,q)^2 - d(v,p)^2) / (2 d(p,q)) <= range. So a vector
is copied to those cells only, of each two cells to the first one, and the cells join by
themselves. Cells are stored in tiles of about ``tile_rows`` vectors, so a crowded cell is
many tiles; a task sees two tiles at a time and returns, for each vector, the number of its
links and the smallest id it is connected to there, never the pairs.

Equal vectors are one vector with a weight. Products are made in single precision; those near
the bound are decided in double precision.

Edge cases: vectors that are null, all zero, or hold null or non-finite components link with
nothing, neither do rows without an id; these rows come back with no links. Vectors of
different lengths never link. Rows that share an id are vectors of their own in the counts and
come back each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.topk import usable
from newsloom.operators.density import components
from newsloom.session import cut_lineage

SLACK = 1e-4  # more than the error of a single precision product of unit vectors


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each as far as can be from those before it."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        far = int(nearest.argmin())
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


def _cells(rows: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """Rows with their cell and the earlier cells that they are copied to."""
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-18))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            squares = 2 - 2 * unit(np.array(frame["vector"].tolist())) @ pivots.T
            home = squares.argmin(axis=1)
            bound = (squares - squares[np.arange(len(home)), home][:, None]) / (2 * between[home])
            near = (bound <= reach + SLACK) & (np.arange(len(pivots)) < home[:, None])
            yield frame.assign(cell=home.astype(np.int32), copies=[np.flatnonzero(x).tolist() for x in near])

    return rows.mapInPandas(place, "id long, weight long, vector array<double>, cell int, copies array<int>")


def _tiles(placed: DataFrame, tile_rows: int) -> DataFrame:
    """(cell, tile, ids, weights, vectors, copies, member): a tile's rows packed together."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        copies = np.unique(np.concatenate([np.asarray(c, np.int64) for c in frame["copies"]] + [np.zeros(0, np.int64)]))
        member = np.array([np.isin(copies, c) for c in frame["copies"]], np.uint8).reshape(len(frame), len(copies))
        return pd.DataFrame({
            "cell": [int(key[0])], "tile": [int(key[1])], "ids": [frame["id"].to_numpy(np.int64).tobytes()],
            "weights": [frame["weight"].to_numpy(np.int64).tobytes()],
            "vectors": [unit(np.array(frame["vector"].tolist())).tobytes()],
            "copies": [copies.tolist()], "member": [member.tobytes()],
        })

    return dealt.groupBy("cell", "tile").applyInPandas(
        pack, "cell int, tile int, ids binary, weights binary, vectors binary, copies array<int>, member binary"
    )


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``a`` link with which rows of ``b``."""
    products = a.astype(np.float32) @ b.astype(np.float32).T
    out = products >= cosine + SLACK
    rows, columns = np.nonzero((products >= cosine - SLACK) & ~out)
    for start in range(0, len(rows), 100_000):
        i, j = rows[start : start + 100_000], columns[start : start + 100_000]
        out[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
    return out


def lowest(links: np.ndarray, row_ids: np.ndarray, column_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column is connected to within these links."""
    rows, columns = row_ids.copy(), column_ids.copy()
    open_rows, open_columns = links.any(axis=1), links.any(axis=0)
    while open_rows.any():
        row_part, column_part = np.zeros(len(rows), bool), np.zeros(len(columns), bool)
        new_rows = np.array([open_rows.argmax()])
        while len(new_rows):
            row_part[new_rows] = True
            open_rows[new_rows] = False
            new_columns = np.flatnonzero(links[new_rows].any(axis=0) & open_columns)
            column_part[new_columns] = True
            open_columns[new_columns] = False
            new_rows = np.flatnonzero(links[:, new_columns].any(axis=1) & open_rows)
        low = min(row_ids[row_part].min(), column_ids[column_part].min())
        rows[row_part], columns[column_part] = low, low
    return rows, columns


def _joined(tiles: DataFrame, dim: int, cosine: float) -> DataFrame:
    """Per tile pair and vector: (id, n, low)."""
    one = tiles.select("ids", "weights", "vectors", "copies", "member", "cell", "tile")
    other = tiles.select(F.col("cell").alias("with_cell"), F.col("tile").alias("with_tile"),
                         *[F.col(c).alias(f"with_{c}") for c in ("ids", "weights", "vectors")])
    pairs = one.withColumn("with_cell", F.explode(F.concat("copies", F.array("cell")))).join(other, "with_cell")
    pairs = pairs.filter("with_cell < cell or with_tile <= tile")

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                same = (row.cell, row.tile) == (row.with_cell, row.with_tile)
                ids, with_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.with_ids, np.int64)
                weights, with_weights = np.frombuffer(row.weights, np.int64), np.frombuffer(row.with_weights, np.int64)
                a = np.frombuffer(row.vectors, np.float64).reshape(len(ids), dim)
                b = np.frombuffer(row.with_vectors, np.float64).reshape(len(with_ids), dim)
                if row.cell != row.with_cell:
                    at = list(row.copies).index(row.with_cell)
                    here = np.frombuffer(row.member, np.uint8).reshape(len(ids), -1)[:, at].astype(bool)
                    ids, weights, a = ids[here], weights[here], a[here]
                links = linked(a, b, cosine)
                if same:
                    np.fill_diagonal(links, False)
                low, with_low = lowest(links, ids, with_ids)
                out = [pd.DataFrame({"id": ids, "n": links @ with_weights, "low": low})]
                if not same:
                    out.append(pd.DataFrame({"id": with_ids, "n": weights @ links, "low": with_low}))
                else:
                    out[0]["low"] = np.minimum(low, with_low)
                yield from (x[x["n"] > 0] for x in out)

    return pairs.mapInPandas(join, "id long, n long, low long")


def embedding_links(
    vectors: DataFrame, cosine: float = 0.9, *, id_col: str = "vec_id", vector_col: str = "embedding",
    tile_rows: int = 4096, max_pivots: int = 1024,
) -> DataFrame:
    """Links of every row: (vec_id, n_links, component_id, kept).

    Pivots come from at most 32 x ``max_pivots`` vectors; they only steer the work.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    fit = rows.filter(usable(F.col("vector")) & F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0))
    keyed = fit.withColumn("key", F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")))
    groups = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    groups = cut_lineage(groups, "vectors")
    found = None
    for dim, n in groups.groupBy(F.size("vector")).count().collect():
        own = groups.filter(F.size("vector") == dim).select(F.col("rep").alias("id"), "weight", "vector")
        wanted = min(max_pivots, -(-n // tile_rows))
        sample = own.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(32 * wanted).select("vector").collect()
        pivots = spread(unit(np.array([r.vector for r in sample], np.float64)), wanted)
        tiles = _tiles(cut_lineage(_cells(own, pivots, float(np.sqrt(2 - 2 * cosine))), "cells"), tile_rows)
        links = _joined(cut_lineage(tiles, "tiles"), dim, cosine)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, n long, low long")
    found = cut_lineage(found, "links")
    edges = found.select(F.col("id").alias("a"), F.col("low").alias("b")).filter("a <> b")
    roots = components(edges)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    members = (
        groups.select("key", F.col("rep").alias("id"), "weight").join(counts, "id", "left").join(roots, "id", "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    joined = keyed.select("id", "key").join(members, "key")
    rest = rows.filter(~(F.coalesce(usable(F.col("vector")), F.lit(False)) & F.col("id").isNotNull() & F.exists(
        F.coalesce("vector", F.array().cast("array<double>")), lambda x: F.coalesce(x != 0, F.lit(False))
    ))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = joined.select("id", "n_links", "component_id").unionByName(rest)
    return result.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
