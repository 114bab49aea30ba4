"""Spanning forests of the edges that a task has at hand, so that only as many edges go on as there are nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

HELD = 1 << 20  # edges that a task gathers before it thins them


def forest_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges of the spanning forest that prefers earlier edges (Boruvka rounds on whole arrays)."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    u, v, edge = ends[: len(a)], ends[len(a) :], np.arange(len(a))
    apart = u != v
    u, v, edge = u[apart], v[apart], edge[apart]
    taken = []
    while len(edge):
        best = np.full(len(nodes), len(a), np.int64)
        np.minimum.at(best, u, edge)
        np.minimum.at(best, v, edge)
        at = np.searchsorted(edge, best)  # edges stay in order
        own = best < len(a)
        up = np.arange(len(nodes))
        other = u[at[own]] + v[at[own]] - up[own]
        up[own] = other
        # Two that choose the same edge point at each other: the lower one stays.
        mutual = (up[up] == np.arange(len(nodes))) & (np.arange(len(nodes)) < up)
        up[mutual] = np.flatnonzero(mutual)
        taken.append(np.unique(best[own]))
        while not np.array_equal(up, up[up]):
            up = up[up]
        u, v = up[u], up[v]
        apart = u != v
        u, v, edge = u[apart], v[apart], edge[apart]
    return np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)


def _thin(frame: pd.DataFrame) -> pd.DataFrame:
    order = [c for c in ("w", "a", "b") if c in frame]
    frame = frame.sort_values(order, ignore_index=True) if "w" in frame else frame
    return frame.iloc[forest_of(frame["a"].to_numpy(), frame["b"].to_numpy())]


def thinned(frames: Iterator[pd.DataFrame], held: int = HELD) -> Iterator[pd.DataFrame]:
    """Edges (a, b) or (a, b, w) whose minimum spanning forest, by (w, a, b), is that of all given ones."""
    have: list[pd.DataFrame] = []
    size = kept = 0
    for frame in frames:
        have.append(frame)
        size += len(frame)
        if size >= held + 2 * kept:
            have = [_thin(pd.concat(have, ignore_index=True))]
            size = kept = len(have[0])
    if have:
        yield _thin(pd.concat(have, ignore_index=True))


def local_forests(edges: DataFrame, held: int = HELD) -> DataFrame:
    """The forests of the tasks' own edges (a, b[, w]): what connects, and the minimum forest, stay the same."""
    schema = "a bigint, b bigint" + (", w double" if "w" in edges.columns else "")
    columns = ["a", "b", "w"] if "w" in edges.columns else ["a", "b"]
    return edges.select(*columns).mapInPandas(lambda frames: thinned(frames, held), schema)
