"""Exact nearest neighbours in many dimensions: tiles of queries against tiles of points.

Beyond a dozen dimensions no cell lies out of reach of a query, so all distances have to be computed; what can be kept
small is what is moved. Queries and points are dealt into tiles by a hash, each pair of tiles is one task, and k
neighbours per query leave it. Inside, a matrix product gives squared distances up to a rounding error that is bounded;
only points that could be among the k nearest within that error are computed exactly. Absolute differences are added up in
single precision first, with a bounded error again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of coordinates in a tile of points, and queries in a tile of queries.
TILE_BYTES = 16 << 20
TILE_QUERIES = 8192
#: Distances computed at a time; a few arrays of this size are held at once.
BLOCK_PAIRS = 1 << 20
#: Of these, so many at a time where they are added up feature by feature.
CACHED_PAIRS = 1 << 16
#: Coordinates below this are compared in single precision first.
SINGLE_UP_TO = 1e30
#: With more than so many times k candidates for a row, double precision tells them apart.
LOOSE = 16


def minkowski(gap: np.ndarray, p: int) -> np.ndarray:
    """Sum over features in order, of squares (p=2, not rooted) or absolute values."""
    total = np.zeros(gap.shape[:-1])
    for i in range(gap.shape[-1]):
        total += gap[..., i] * gap[..., i] if p == 2 else np.abs(gap[..., i])
    return total


def _absolute(part: np.ndarray, columns: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of absolute differences between rows and points given by ``columns``, in their precision, a cache's worth at a
    time; and what rounding can make of a comparison. ``longest``: the largest sum of a point's absolute values."""
    d, n = columns.shape
    rows = part.astype(columns.dtype)
    near = np.zeros((len(part), n), columns.dtype)
    width = max(1, CACHED_PAIRS // max(1, len(part)))
    gap = np.empty((len(part), min(width, n)), columns.dtype)
    for a in range(0, n, width):
        out = near[:, a:a + width]
        own = gap[:, :out.shape[1]]
        for i in range(d):
            np.subtract(rows[:, i, None], columns[i, a:a + width], out=own)
            np.abs(own, out=own)
            out += own
    info = np.finfo(columns.dtype)
    return near, 8 * (d + 4) * (float(info.eps) * (np.abs(part).sum(axis=1) + longest) + float(info.tiny))


def _within(near: np.ndarray, slack: np.ndarray, banned: np.ndarray | None, k: int) -> np.ndarray:
    """Which points may be among the k nearest of each row."""
    if banned is not None:
        near[banned] = np.inf
    reach = np.partition(near, k - 1, axis=1)[:, k - 1] + slack if near.shape[1] > k else np.full(len(near), np.inf)
    return (near <= reach[:, None]) & np.isfinite(near)


def nearest(x: np.ndarray, y: np.ndarray, k: int, p: int, x_ban: np.ndarray | None = None,
            y_ban: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, raw distance) of the k nearest points of each query; equal distances in the order of the points.
    Pairs with equal bans are none."""
    d, found = x.shape[1], []
    if p == 1:
        most = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
        kinds = [np.float32, float] if most < SINGLE_UP_TO else [float]
        columns = [np.ascontiguousarray(y.T, kind) for kind in kinds]
        longest = np.abs(y).sum(axis=1).max(initial=0.0)
    yy = np.einsum("ij,ij->i", y, y)
    size = max(1, BLOCK_PAIRS // max(1, len(y) * (1 if p == 2 else 2)))
    for start in range(0, len(x), size):
        part = x[start:start + size]
        if p == 2:
            xx = np.einsum("ij,ij->i", part, part)
            near = part @ y.T
            near *= -2.0
            near += yy
            near += xx[:, None]
            # rounding of the three sums of d products each, on both sides of a comparison
            slack = 8 * (d + 4) * np.finfo(float).eps * (xx + yy.max(initial=0.0))
        else:
            near, slack = _absolute(part, columns[0], longest)
        banned = x_ban[start:start + size, None] == y_ban if x_ban is not None else None
        able = _within(near, slack, banned, k)
        if p == 1 and len(columns) > 1 and np.count_nonzero(able) > LOOSE * k * len(part):
            able = _within(*_absolute(part, columns[1], longest), banned, k)  # too close together for single precision
        row, col = np.nonzero(able)
        raw = minkowski(part[row] - y[col], p)
        order = np.lexsort((col, raw, row))
        row, col, raw = row[order], col[order], raw[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        found.append((row[keep] + start, col[keep], raw[keep]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in range(3))


def search_tiles(asked: DataFrame, points: DataFrame, n_asked: int, n_points: int, d: int, k: int, p: int, key: str,
                 payload: Sequence[str], tile_points: int | None = None, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """(key, neighbor, raw, payload) of the k nearest of every pair of tiles. Both sides hold ``_x`` and ``_ban``."""
    tile_points = tile_points or max(1, TILE_BYTES // (8 * d))
    across, down = max(1, -(-n_points // tile_points)), max(1, -(-n_asked // tile_queries))

    def dealt(df: DataFrame, by: str, own: str, mine: int, other: str, all_: int) -> DataFrame:
        """A row goes to its own tile, against every tile of the other side."""
        return (df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(mine)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(all_ - 1)))))

    schema = T.StructType([T.StructField(key, asked.schema[key].dataType), T.StructField("neighbor", points.schema["neighbor"].dataType),
                           T.StructField("raw", T.DoubleType()), *(points.schema[c] for c in payload)])

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=schema.names)
        c = c.sort_values("neighbor", kind="stable", ignore_index=True)
        x, y = np.stack(q.pop("_x").to_numpy()), np.stack(c.pop("_x").to_numpy())
        bans = None, None
        if c["_ban"].notna().any():
            codes, _ = pd.factorize(pd.concat([q["_ban"], c["_ban"]]))  # missing values are -1 and ban nothing
            bans = np.where(codes[:len(q)] < 0, -2, codes[:len(q)]), codes[len(q):]
        row, col, raw = nearest(x, y, k, p, *bans)
        out = {key: q[key].to_numpy()[row], "neighbor": c["neighbor"].to_numpy()[col], "raw": raw}
        return pd.DataFrame(out | {n: c[n].to_numpy()[col] for n in payload})[schema.names]

    left = dealt(asked.select(key, "_x", "_ban"), key, "_down", down, "_across", across)
    right = dealt(points, "neighbor", "_across", across, "_down", down)
    return left.groupBy("_down", "_across").cogroup(right.groupBy("_down", "_across")).applyInPandas(pair, schema)
