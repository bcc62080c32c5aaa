"""Exact k-nearest-neighbour join, and the neighbour vote.

In many dimensions the join runs over tiles (``operators.tiles``), else by cells. Points are then partitioned into the leaves of a k-d tree whose splits come from a bounded sample.
A query first searches its own cell; the k-th distance found there bounds the true one, so
only cells whose bounding box lies within that bound are searched as well. Pairs are compared
inside a task (one cell, one chunk of queries) and only k per query leave it.

Skew: of identical points only the first few in key order can ever be among the k nearest, so
the others are dropped before the shuffle (this loses nothing); queries of a busy cell are cut
into chunks by a hash of their key.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.ranking import hash_order
from cohortlens.operators.tiles import TILE_QUERIES, minkowski, search_tiles
from cohortlens.session import stage

CELL_ROWS = 4096
CHUNK_ROWS = 16384
MAX_CELLS = 65536
SAMPLE_PER_CELL = 8
#: Up to so many features a bounding box can still rule out cells; beyond, tiles move less.
CELL_FEATURES = 12
BLOCK_PAIRS = 4_000_000


@dataclass(frozen=True)
class CellTree:
    """Median splits, stored by node: (feature, value) of inner nodes, cell number of leaves."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray  # left child; the right one follows it
    cell: np.ndarray

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        inner = self.cell[node] < 0
        while inner.any():
            at = node[inner]
            right = x[inner, self.feature[at]] > self.value[at]
            node[inner] = self.child[at] + right
            inner = self.cell[node] < 0
        return self.cell[node]


def grow_cells(sample: np.ndarray, cells: int) -> CellTree:
    """Split the largest cell at the median of its widest feature until there are enough cells."""
    feature, value, child, members = [0], [0.0], [-1], {0: np.arange(len(sample))}
    queue = [(-len(sample), 0)]  # cells that can still be split, largest first
    leaves = 1
    while queue and leaves < cells:
        _, node = heapq.heappop(queue)
        rows = sample[members[node]]
        widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if len(rows) > 1 else 0
        cut = float(np.median(rows[:, widest])) if len(rows) > 1 else 0.0
        right = rows[:, widest] > cut
        if not right.any():  # more than half share the largest value: cut just below it
            cut = float(np.max(rows[:, widest][rows[:, widest] < cut], initial=-np.inf))
            right = rows[:, widest] > cut
        if right.all() or not right.any():
            continue
        feature[node], value[node], child[node] = widest, cut, len(feature)
        for part in (~right, right):
            members[len(feature)] = members[node][part]
            heapq.heappush(queue, (-int(part.sum()), len(feature)))
            feature.append(0), value.append(0.0), child.append(-1)
        del members[node]
        leaves += 1
    cell, order, seen = np.full(len(feature), -1), [0], 0
    while order:  # number the leaves depth first, so that neighbours in number are close in space
        node = order.pop()
        if child[node] < 0:
            cell[node], seen = seen, seen + 1
        else:
            order += [child[node] + 1, child[node]]
    return CellTree(np.array(feature), np.array(value), np.array(child), cell)


def knn_join(
    queries: DataFrame, points: DataFrame, features: Sequence[str], k: int, key: str = "entity_id",
    exclude: str | None = None, p: int = 2, payload: Sequence[str] = (), cell_rows: int = CELL_ROWS,
    chunk_rows: int = CHUNK_ROWS, method: str | None = None,
) -> DataFrame:
    """The k nearest points of every query: (key, rank, neighbor, distance, payload of the point).

    Distances are Minkowski with p of 1 or 2; equal distances are ordered by the point's key.
    ``exclude`` names a column of both sides: pairs that agree in it are not neighbours (the
    key itself to leave a row out, the fold to search other folds only). A row with a missing or
    infinite feature has no distance to any other: it raises a ValueError; impute first. ``method`` ("cells" or
    "tiles", by the number of features if not given) makes no difference to the result.
    """
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    method = method or ("cells" if len(features) <= CELL_FEATURES else "tiles")
    payload = [c for c in payload if c != key]
    vector = F.array(*[F.col(f).cast("double") for f in features]).alias("_x")
    ban = F.col(exclude).cast("string") if exclude else F.lit(None).cast("string")
    kept = stage(_first_copies(points, features, k, key, exclude).select(
        F.col(key).alias("neighbor"), vector, ban.alias("_ban"), *payload))
    total = _refuse_missing(kept, features, "points")
    if method == "tiles":
        asked = stage(queries.select(F.col(key), vector, ban.alias("_ban")))
        n_asked = _refuse_missing(asked, features, "queries")
        hits = search_tiles(asked, kept, n_asked, total, len(features), k, p, key, payload, tile_points=cell_rows if cell_rows != CELL_ROWS else None,
                            tile_queries=min(chunk_rows, TILE_QUERIES))
        return _nearest_first(hits, k, p, key, payload)
    cells = max(1, min(MAX_CELLS, -(-total // cell_rows)))
    sample = kept.select("_x").orderBy(hash_order("neighbor")).limit(cells * SAMPLE_PER_CELL)
    drawn = np.array([r["_x"] for r in sample.collect()]).reshape(-1, len(features))
    tree = grow_cells(drawn, cells)
    located = kept.withColumn("_cell", _cell_of(tree)("_x"))
    asked = stage(queries.select(F.col(key), vector, ban.alias("_ban")).withColumn("_cell", _cell_of(tree)("_x")))
    _refuse_missing(asked, features, "queries")
    boxes = _boxes(located, len(features)) if cells > 1 else None

    types = {f.name: f.dataType for f in kept.schema.fields}
    found = T.StructType([
        T.StructField(key, queries.schema[key].dataType),
        T.StructField("neighbor", T.ArrayType(types["neighbor"])),
        T.StructField("raw", T.ArrayType(T.DoubleType())),
        *[T.StructField(c, T.ArrayType(types[c])) for c in payload],
    ])
    extra = T.StructType([*found.fields, *[asked.schema[c] for c in ("_x", "_ban", "_cell")]])
    home = _search(asked, located, k, p, key, payload, chunk_rows, extra, carry=True)
    if boxes is None or len(boxes) < 2:
        lists = home
    else:
        home = stage(home)
        visits = home.withColumn("_cell", F.explode(_cells_within(boxes, k, p)("_x", "_cell", "raw")))
        away = _search(visits.select(key, "_x", "_ban", "_cell"), located, k, p, key, payload, chunk_rows, found)
        lists = home.select(*found.names).unionByName(away)
    hits = lists.select(key, F.explode(F.arrays_zip("neighbor", "raw", *payload)).alias("h")).select(key, "h.*")
    return _nearest_first(hits, k, p, key, payload)


def _nearest_first(hits: DataFrame, k: int, p: int, key: str, payload: Sequence[str]) -> DataFrame:
    """The first k of all hits of a query, ranked."""
    best = Window.partitionBy(key).orderBy("raw", "neighbor")  # at most k rows per searched cell or tile
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    distance = F.sqrt("raw") if p == 2 else F.col("raw")
    return ranked.select(key, "rank", "neighbor", distance.alias("distance"), *payload)


def neighbor_vote(neighbors: DataFrame, k: int, weights: str = "uniform", key: str = "entity_id",
                  label: str = "label") -> DataFrame:
    """Share of positive neighbours among the first k, plain or by inverse distance.

    With distance weights, neighbours at distance 0 outvote all others.
    """
    near = neighbors.where(F.col("rank") <= k)
    y = F.col(label).cast("double")
    if weights == "uniform":
        return near.groupBy(key).agg(F.avg(y).alias("p"))
    inverse = F.when(F.col("distance") > 0, 1.0 / F.col("distance"))
    exact = F.when(F.col("distance") == 0, y)
    return near.groupBy(key).agg(
        F.coalesce(F.avg(exact), F.sum(inverse * y) / F.sum(inverse)).alias("p"))


def knn_candidates(df: DataFrame, features: Sequence[str], candidates: Mapping[int, tuple[int, str, int]],
                   fold: str = "fold", key: str = "entity_id", label: str = "label") -> DataFrame:
    """Out-of-fold scores of KNN candidates (k, weights, p): one join per metric, at the largest k."""
    votes = []
    for p in sorted({c[2] for c in candidates.values()}):
        mine = {t: c for t, c in candidates.items() if c[2] == p}
        near = stage(knn_join(df, df, features, max(c[0] for c in mine.values()), key, fold, p, [label]))
        votes += [neighbor_vote(near, k, w, key, label).withColumn("trial_id", F.lit(t))
                  for t, (k, w, _) in mine.items()]
    out = votes[0]
    for v in votes[1:]:
        out = out.unionByName(v)
    return out.join(df.select(key, fold, label), key)


def _refuse_missing(rows: DataFrame, features: Sequence[str], what: str) -> int:
    """The number of rows; a ValueError where a feature of one has no finite value."""
    gap = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.exists("_x", gap)).alias("bad")).first()
    if got["bad"]:
        raise ValueError(f"{got['bad']} {what} miss a finite value of {', '.join(features)}; impute them first")
    return got["n"]


def _first_copies(points: DataFrame, features: Sequence[str], k: int, key: str, exclude: str | None) -> DataFrame:
    """Of identical points, those that can be among k nearest: the first k by key, per excluded value."""
    by_value = [c for c in [exclude] if c and c != key]
    same = Window.partitionBy(*features, *by_value).orderBy(key)
    return points.withColumn("_copy", F.row_number().over(same)).where(
        F.col("_copy") <= k + (exclude == key)).drop("_copy")


def _cell_of(tree: CellTree):
    @F.pandas_udf("int")
    def locate(x: pd.Series) -> pd.Series:
        return pd.Series(tree.locate(np.stack(x.to_numpy())).astype("int32"))
    return locate


def _boxes(located: DataFrame, d: int) -> list:
    """Tight bounding box per non-empty cell; at most MAX_CELLS rows."""
    edges = [f(F.col("_x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]
    return [
        (r["_cell"], [r[f"lo{i}"] for i in range(d)], [r[f"hi{i}"] for i in range(d)])
        for r in located.groupBy("_cell").agg(*edges).collect()
    ]


def _cells_within(boxes: list, k: int, p: int):
    """Other cells that may hold a point at most as far away as the k-th found so far.

    Cells next to each other in number share an outer box, which is tested first.
    """
    boxes = sorted(boxes)
    cell = np.array([b[0] for b in boxes])
    low, high = (np.array([b[i] for b in boxes]) for i in (1, 2))
    width = max(1, int(len(boxes) ** 0.5))
    starts = np.arange(0, len(boxes), width)
    outer_low, outer_high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)

    def gap_to(point, lo, hi):
        return minkowski(np.maximum(np.maximum(lo - point, point - hi), 0.0), p)

    @F.pandas_udf("array<int>")
    def within(x: pd.Series, home: pd.Series, raw: pd.Series) -> pd.Series:
        out = []
        for point, own, found in zip(x, home, raw):
            bound = found[k - 1] if len(found) >= k else np.inf
            groups = starts[gap_to(point, outer_low, outer_high) <= bound]
            some = np.concatenate([np.arange(g, min(g + width, len(cell))) for g in groups]) if len(groups) else []
            near = [i for i in some if cell[i] != own]
            if near:
                near = np.array(near)
                near = near[gap_to(point, low[near], high[near]) <= bound]
            out.append([int(cell[i]) for i in near])
        return pd.Series(out)
    return within


def _search(asked: DataFrame, located: DataFrame, k: int, p: int, key: str, payload: Sequence[str],
            chunk_rows: int, schema: T.StructType, carry: bool = False) -> DataFrame:
    """Nearest k within the cell each query asks for, chunk by chunk."""
    sizes = {r["_cell"]: r["count"] for r in asked.groupBy("_cell").count().collect()}  # one row per cell
    chunks = {c: -(-n // chunk_rows) for c, n in sizes.items()}
    parts = _chunks_of(chunks)
    chunked = asked.withColumn("_part", F.pmod(F.xxhash64(key), parts).cast("int"))
    repeated = located.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty:
            return pd.DataFrame(columns=schema.names)
        c = c.sort_values("neighbor", kind="stable")
        lists = {n: [] for n in ("neighbor", "raw", *payload)}
        if len(c):
            x, y = np.stack(q["_x"].to_numpy()), np.stack(c["_x"].to_numpy())
            columns = {n: c[n].to_numpy() for n in ("neighbor", *payload)}
            bans = (q["_ban"].to_numpy(), c["_ban"].to_numpy()) if c["_ban"].notna().any() else None
            block = max(1, BLOCK_PAIRS // (len(y) * x.shape[1]))
            for start in range(0, len(x), block):
                raw = minkowski(x[start:start + block, None, :] - y[None, :, :], p)
                if bans is not None:
                    raw[bans[0][start:start + block, None] == bans[1][None, :]] = np.inf
                order = np.argsort(raw, axis=1, kind="stable")[:, :k]  # equal distances stay in key order
                for row, chosen in zip(raw, order):
                    chosen = chosen[np.isfinite(row[chosen])]
                    lists["raw"].append(row[chosen])
                    for n, values in columns.items():
                        lists[n].append(values[chosen])
        else:
            for n in lists:
                lists[n] = [[] for _ in range(len(q))]
        out = pd.DataFrame({key: q[key].to_numpy(), **lists})
        if carry:
            out = out.assign(**{n: q[n].to_numpy() for n in ("_x", "_ban", "_cell")})
        return out[schema.names]

    return (
        chunked.groupBy("_cell", "_part").cogroup(repeated.groupBy("_cell", "_part"))
        .applyInPandas(nearest, schema)
    )


def _chunks_of(chunks: Mapping[int, int]) -> Column:
    """Number of query chunks of a cell; 1 unless listed."""
    many = {c: n for c, n in chunks.items() if n > 1}
    if not many:
        return F.lit(1)
    pairs = ",".join(f"{c},{n}" for c, n in many.items())
    return F.coalesce(F.expr(f"try_element_at(map({pairs}), _cell)"), F.lit(1))
