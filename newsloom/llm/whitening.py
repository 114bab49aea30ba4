"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Every step has one job, which goes once over the rows X (centred by their mean): a left vector
``X v`` and the product ``X' u`` of it are formed tile by tile and summed up. Left vectors are as
long as the table, so they are not kept: each is ``X w`` for a short ``w`` that the driver knows,
and the job forms the earlier ones again to orthogonalise the new one against all of them. Right
vectors are short and orthogonalised on the driver, twice. The steps make a bidiagonal matrix as
wide as their number, whose singular values and vectors give the components; they stop when the
residual bound of every wanted component is at rounding level. One start vector meets only
one vector of an eigenspace, so a second start, orthogonal to all found, looks for what the
first could not see, until none is left above the last component wanted.

Only sums as long as the dimension reach the driver. Each step may run again on its own.

Components are integers ``floor(scale * c) + offset``; their sums are exact, and rows are centred in
integers before they become doubles.

Edge cases: vectors that are null, empty, or hold null or non-finite entries take no part, nor do
those of another length than the commonest (of equally common ones, the longest). Entries beyond
2**62 in size count as that. Rows without an id, or with one that others have, take part on their own. At most
as many components are given as the rows have directions with a variance above rounding level:
none for a table that is empty or has one vector only, in however many rows. A deviation beyond the
range of a long is null. Of the two signs, the one is taken by which the largest entry of a component is positive.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import pieces
from newsloom.llm.topk import usable
from newsloom.session import cut_lineage

LARGEST = float(1 << 62)
CONVERGED = 1e-14  # residual of a component, in parts of the largest singular value
VANISHED = 1e-12  # length of a new direction, in parts of the norm of all rows
TILE_VALUES = 1 << 20


@dataclass
class Tiles:
    """Integer vectors in tiles: (ids array<long>, x binary), x as int64 row by row."""

    rows: DataFrame
    dim: int


def pack(vectors: DataFrame, *, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> Tiles:
    rows = vectors.select(pieces.filled(F.col(id_col)).alias("id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().filter("dim > 0")
    common = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    rows = rows.filter((F.size("vector") == dim) & F.lit(dim > 0)).select("id", F.col("vector").cast("array<double>").alias("vector"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE_VALUES // max(1, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype(np.int64) + offset
            cuts = range(0, len(ids), step)
            columns = [pa.array([ids[a : a + step] for a in cuts], pa.list_(pa.int64())), pa.array([x[a : a + step].tobytes() for a in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "x"])

    return Tiles(cut_lineage(rows.mapInArrow(tile, "ids array<long>, x binary"), "tiles"), dim)


def _sums(tiles: Tiles, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """Sum over all tiles of the numbers that ``of`` makes of a tile's rows."""
    dim = tiles.dim

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for raw in frame["x"]:
                own = of(np.frombuffer(raw, np.int64).reshape(-1, dim))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"sums": [total]})

    parts = tiles.rows.select("x").mapInPandas(add, f"sums array<{'double' if kind == 'double' else 'long'}>")
    added = parts.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast(kind)).alias("s"))
    return [r["s"] for r in added.orderBy("at").collect()]


def _halves(x: np.ndarray) -> np.ndarray:
    return np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), [len(x)]])


def _matrix(alphas: list[float], betas: list[float], columns: int) -> np.ndarray:
    b = np.zeros((len(alphas), columns))
    for i, a in enumerate(alphas):
        b[i, i] = a
    for i, a in enumerate(betas[: columns - 1]):
        b[i, i + 1] = a
    return b


@dataclass
class Whitening:
    """A fit: integer sums, and per component the unit vector and the variance along it."""

    n: int
    dim: int
    sums: list[int]
    trace: float
    vectors: np.ndarray  # dim x components
    variances: np.ndarray
    steps: list[int] = field(default_factory=list)  # of every start

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return lambda x: (x - whole).astype(np.float64) - rest

    def deviations(self) -> Callable[[np.ndarray], list[int | None]]:
        """Sum over dimensions of (n x - sum)**2 of each row, in integers."""
        n, whole, rest = self.n, np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

        def of(x: np.ndarray) -> list[int | None]:
            off = x - whole
            most = float(np.abs(off).max(initial=0)) * n + n
            if most * most * self.dim >= 2.0**63:
                off, own = off.astype(object), rest.astype(object)
                return [int(d) if d < 1 << 63 else None for d in ((off * n - own) ** 2).sum(axis=1)]
            return ((off * n - rest) ** 2).sum(axis=1).tolist()

        return of

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.variances)

    def identity_error(self, tiles: Tiles) -> float:
        """Largest entry of the whitened rows' covariance minus the identity."""
        centred, by, k = self.centred(), self.scaled, len(self.variances)

        def moments(x: np.ndarray) -> np.ndarray:
            z = centred(x) @ by
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        sums = np.array(_sums(tiles, moments)) / self.n
        cov = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
        return float(np.abs(cov - np.eye(k)).max())

    def whiten(self, tiles: Tiles) -> DataFrame:
        """(vec_id, deviation, whitened array<double>) of every row."""
        centred, deviations, by, dim = self.centred(), self.deviations(), self.scaled, self.dim

        def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for ids, raw in zip(frame["ids"], frame["x"], strict=True):
                    x = np.frombuffer(raw, np.int64).reshape(-1, dim)
                    deviation = pd.array(deviations(x), "Int64")
                    yield pd.DataFrame({"vec_id": np.asarray(ids), "deviation": deviation, "whitened": list(centred(x) @ by)})

        out = tiles.rows.mapInPandas(apply, "vec_id long, deviation long, whitened array<double>")
        return out.withColumn("vec_id", pieces.unfilled("vec_id"))


def fit(tiles: Tiles, components: int = 8, seed: int = 7) -> Whitening | None:
    """Mean and leading components of all rows; None if there are no rows."""
    dim = tiles.dim
    totals = [int(s) for s in _sums(tiles, _halves, "decimal(38,0)")]
    if not totals or not totals[-1]:
        return None
    n, sums = totals[-1], [(high << 32) + low for high, low in zip(totals[:dim], totals[dim : 2 * dim], strict=True)]
    model = Whitening(n, dim, sums, 0.0, np.zeros((dim, 0)), np.zeros(0))
    centred = model.centred()
    norm2 = _sums(tiles, lambda x: np.array([np.square(centred(x)).sum()]))[0]
    model.trace = norm2 / n
    found, values, random = np.zeros((dim, 0)), np.zeros(0), np.random.default_rng(seed)
    while norm2 > 0 and found.shape[1] < dim:
        bound = np.sort(values)[-components] if len(values) >= components else 0.0
        sigmas, vectors, steps = _one_start(tiles, centred, found, random.normal(size=dim), bound, components, np.sqrt(norm2))
        model.steps.append(steps)
        better = bool((sigmas > bound).any())
        found, values = np.hstack([found, vectors]), np.concatenate([values, sigmas])
        if not better or found.shape[1] + steps - len(sigmas) >= dim:
            break
    best = np.argsort(-values)[:components]
    model.variances = values[best] ** 2 / n
    model.vectors = found[:, best]
    largest = np.abs(model.vectors).argmax(axis=0) if len(best) else []
    model.vectors = model.vectors * np.where(model.vectors[largest, range(len(best))] < 0, -1.0, 1.0) if len(best) else model.vectors
    return model


def _one_start(
    tiles: Tiles, centred: Callable, found: np.ndarray, start: np.ndarray, bound: float, components: int, norm: float
) -> tuple[np.ndarray, np.ndarray, int]:
    """Converged singular values and right vectors from one start orthogonal to ``found``, and its steps."""
    dim = tiles.dim

    def orthogonal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found @ (found.T @ v)
            v = v - against @ (against.T @ v)
        return v

    none = np.zeros((dim, 0))
    right, left, images = none, none, none  # v, w with u = X w, X'u
    alphas: list[float] = []
    betas: list[float] = []
    v = orthogonal(start, none)
    v, beta = v / np.linalg.norm(v), 0.0
    while True:
        omega = v - beta * left[:, -1] if alphas else v

        def products(x: np.ndarray, omega: np.ndarray = omega, left: np.ndarray = left) -> np.ndarray:
            rows = centred(x)
            p = rows @ omega
            return np.concatenate([[p @ p], (rows @ left).T @ p, rows.T @ p])

        got = np.array(_sums(tiles, products))
        length2, along, image = got[0], got[1 : 1 + len(alphas)], got[1 + len(alphas) :]
        omega, image = omega - left @ along, image - images @ along
        alpha = np.sqrt(max(length2 - along @ along, 0.0))
        right = np.column_stack([right, v])
        if alpha <= VANISHED * norm:  # the rows have nothing along v but what u's before it hold
            beta = 0.0
        else:
            alphas.append(alpha)
            left, images = np.column_stack([left, omega / alpha]), np.column_stack([images, image / alpha])
            step = orthogonal(images[:, -1] - alpha * v, right)
            beta = float(np.linalg.norm(step))
            if beta <= VANISHED * norm or found.shape[1] + right.shape[1] == dim:
                beta = 0.0
        if not alphas:
            return np.zeros(0), none, right.shape[1]
        small_left, sigmas, small_right = np.linalg.svd(_matrix(alphas, betas, right.shape[1]), full_matrices=False)
        residuals = beta * np.abs(small_left[-1])
        done = residuals <= CONVERGED * max(sigmas[0], bound)
        below = (sigmas < bound) & (residuals <= 0.01 * (bound - sigmas))
        wanted = done[:components]
        if np.any(below):
            wanted = wanted[: int(np.argmax(below))]
        enough = np.any(below) or len(sigmas) >= components
        if beta == 0.0 or (enough and wanted.all()):
            keep = np.flatnonzero(done & (sigmas > VANISHED * norm))
            return sigmas[keep], right @ small_right[keep].T, right.shape[1]
        betas.append(beta)
        v = step / beta
