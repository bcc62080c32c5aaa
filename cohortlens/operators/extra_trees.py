"""Forests: extremely randomised trees (one random cut per node and drawn feature) and random forests (the best cut).

All trees grow level by level at the same time. A first pass over the rows finds the range of each drawn feature in
every open node, from which the cuts are drawn by hashes of seed, tree, node and feature; a second pass counts both
sides of every cut. A random forest bins its features once and counts each class per drawn feature and bin in one pass;
its draws of features are hashes too, and leaves that predict the same class are merged as MLlib does. What reaches the
driver has the size of nodes x drawn features (x bins). Weights are rounded to multiples
of a step so small that sums are exact, so a forest does not depend on partitions or repeated tasks. As in
``histogram_trees``, passes run over the staged blocks' RDD. Missing values go right; a drawn feature that is constant
in a node counts as drawn.

Rows that agree in all features, label and weight are one row that counts several times; a bootstrap draws for n such rows
what n rows would draw in all, Poisson(n). Up to ``TASK_BYTES`` of such rows are sent to a few tasks, each of which grows
its share of the trees one by one and keeps the node of each row; more rows are passed over by all tasks for all trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cohortlens.operators.histogram_trees import Tree, node_table, require_features
from cohortlens.operators.splits import share_cuts
from cohortlens.session import stage, unstage

#: Nodes x drawn features that one pass deals with.
PASS_CELLS = 1 << 19
#: Rows of up to this size are sent to the tasks that grow whole trees.
TASK_BYTES = 96 << 20
#: Cuts of a random forest's features, plus one.
BINS = 32
#: Decreases of impurity below this share of a node's weight are rounding.
LEAST_GAIN = 1e-12
_BLOCKS = StructType([StructField(c, BinaryType()) for c in ("x", "y", "w", "u", "n")])


@dataclass(frozen=True)
class Forest:
    """Trees whose leaf values are shares of positives; the score is their mean."""

    trees: tuple[Tree, ...]
    features: tuple[str, ...]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        require_features(df, self.features)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def mean(columns: pd.DataFrame) -> pd.Series:
            x = columns.to_numpy(float)
            missing, total = ~np.isfinite(x), np.zeros(len(x))
            for tree in shared.value.trees:
                total += tree.value[tree.leaf(x, tree.cut, missing)]
            return pd.Series(total / len(shared.value.trees))

        return df.withColumn(out, mean(F.struct(*(F.col(f"`{f}`").cast("double").alias(f) for f in self.features))))

    def importances(self) -> dict[str, float]:
        """Mean over the trees of each feature's share of the decrease of impurity."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            own = np.zeros(len(self.features))
            np.add.at(own, tree.feature, tree.gain)
            total += own / own.sum() if own.sum() else 0
        whole = total.sum()
        return {f: float(v / whole) if whole else 0.0 for f, v in zip(self.features, total)}

    def paths(self) -> list[tuple]:
        return [(value / len(self.trees), path) for tree in self.trees for value, path in tree.paths()]

    def nodes(self, spark: SparkSession) -> DataFrame:
        return node_table(spark, self.trees, self.features)


def _uniform(*parts) -> float:
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


@dataclass
class _Node:
    path: str
    sums: np.ndarray | None = None  # weight, weight of positives, rows
    split: tuple | None = None  # (feature, cut, gain, cut as a bin)
    children: tuple[int, int] | None = None
    done: bool = False


def _tree(nodes: Sequence[_Node]) -> Tree:
    n, own = len(nodes), np.arange(len(nodes))
    sums = np.array([node.sums if node.sums is not None else (0, 0, 0) for node in nodes], float)
    tree = Tree(np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool), own.copy(), own.copy(),
                sums[:, 1] / np.maximum(sums[:, 0], 1e-300), np.zeros(n), sums[:, 0], sums[:, 2].astype(np.int64),
                max((len(node.path) + 1 for node in nodes if node.children), default=0))
    for i, node in enumerate(nodes):
        if node.children:
            tree.feature[i], tree.cut[i], tree.gain[i], tree.low[i] = node.split
            tree.left[i], tree.right[i] = node.children
    return tree


def _pruned(nodes: Sequence[_Node]) -> list[_Node]:
    """Without splits into two leaves that predict the same class."""
    ends = [0.0] * len(nodes)  # the class a leaf predicts, None for other nodes
    for i in reversed(range(len(nodes))):  # children follow their parents
        node = nodes[i]
        if node.children:
            left, right = (ends[c] for c in node.children)
            if left is None or left != right:
                ends[i] = None
                continue
            node.children = node.split = None
        ends[i] = float(2 * node.sums[1] > node.sums[0])
    kept, todo = [], [0]
    place = {0: 0}
    while todo:
        i = todo.pop(0)
        kept.append(nodes[i])
        if nodes[i].children:
            for c in nodes[i].children:
                place[c] = len(place)
                todo.append(c)
            nodes[i].children = tuple(place[c] for c in nodes[i].children)
    return kept


@dataclass(frozen=True)
class _Rule:
    """How a forest's trees grow. ``cuts`` of the binned features are a random forest's; without them cuts are drawn."""

    features: tuple[str, ...]
    k: int
    seed: int
    max_depth: int | None
    min_leaf: int
    min_split: int
    bootstrap: bool
    step: float
    kind: type
    cuts: tuple[np.ndarray, ...] | None = None

    @property
    def width(self) -> int:
        """Numbers that a pass counts for a node."""
        return self.k * (1 if self.cuts is None else max(len(c) + 1 for c in self.cuts))

    def arrays(self, block) -> tuple[np.ndarray, ...]:
        return (np.frombuffer(block[0], self.kind).reshape(-1, len(self.features)),
                *(np.frombuffer(b, t) for b, t in zip(block[1:], (float, float, np.int64, np.int64))))

    def place(self, tree: Tree, x: np.ndarray, missing: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        return tree.leaf(x, tree.cut if self.cuts is None else tree.low, missing, at)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        return ~np.isfinite(x) if self.cuts is None else np.zeros(x.shape, bool)

    def weighed(self, t: int, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and number that rows which count ``n`` times have in tree ``t``; a bootstrap draws for single rows."""
        if not self.bootstrap:
            return w * n, n
        v = ((u ^ (t + 1) * 0x9E3779B1) * 0x5851F42D4C957F2D >> 11 & (1 << 52) - 1) / 2.0**52
        times = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(j) for j in range(8)]), v)
        return w * times, np.where(times > 0, n if self.cuts is None else times, 0)


class _Passes:
    """Work done by a pass over the blocks by all tasks."""

    def __init__(self, rule: _Rule, table: DataFrame):
        self.rule, self.blocks = rule, table.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def over_rows(self, trees: dict[int, Tree], places: dict[int, dict[int, int]], work: Callable, combine: Callable, empty: Callable):
        """``work`` on (x, y, weight, number, slot of each row) for every tree of the slots and every block."""
        rule = self.rule

        def run(parts):
            out = empty()
            for block in parts:
                x, y, w, u, n = rule.arrays(block)
                missing = rule.gaps(x)
                for t, own in places.items():
                    slot_of = np.full(len(trees[t].value), -1)
                    slot_of[list(own)] = list(own.values())
                    slot = slot_of[rule.place(trees[t], x, missing)]
                    at = np.flatnonzero(slot >= 0)
                    weight, number = rule.weighed(t, u[at], w[at], n[at])
                    at, weight, number = at[number > 0], weight[number > 0], number[number > 0]
                    if len(at):
                        work(out, x[at], y[at], weight, number, slot[at])
            yield out

        parts = self.blocks.mapPartitions(run)
        return parts.treeReduce(combine) if self.blocks.getNumPartitions() > 8 else _fold(parts.collect(), combine)


class _Held:
    """Work on rows that this task holds, for one tree."""

    def __init__(self, rule: _Rule, arrays: Sequence[np.ndarray], tree_no: int, merged: bool):
        x, y, w, u, n = arrays
        if rule.bootstrap and merged:
            n = np.random.default_rng([rule.seed, tree_no]).poisson(n)  # equal rows draw together
            w = w * n
        else:
            w, n = rule.weighed(tree_no, u, w, n)
        drawn = n > 0
        self.rule, self.x, self.y, self.w, self.n = rule, x[drawn], y[drawn], w[drawn], n[drawn]
        self.gaps, self.at = rule.gaps(self.x), np.zeros(len(self.y), np.int64)

    def over_rows(self, trees, places, work, combine, empty):
        (t, own), = places.items()
        self.at = self.rule.place(trees[t], self.x, self.gaps, self.at)
        slot_of = np.full(len(trees[t].value), -1)
        slot_of[list(own)] = list(own.values())
        slot = slot_of[self.at]
        at, out = np.flatnonzero(slot >= 0), empty()
        if len(at):
            work(out, self.x[at], self.y[at], self.w[at], self.n[at], slot[at])
        return out


def _share(max_features: str | float | None, d: int) -> int:
    share = {"sqrt": math.sqrt(d) / d, "log2": math.log2(d) / d if d > 1 else 1.0, None: 1.0}.get(max_features, max_features)
    return max(1, min(d, int(float(share) * d + 1e-9)))


def _rounded_up(max_features: str | float | None, d: int) -> int:
    """As MLlib counts a forest's features: shares are rounded up, whole numbers are numbers of features."""
    named = {"auto": math.sqrt(d), "sqrt": math.sqrt(d), "log2": math.log2(d), "onethird": d / 3, "all": d, None: d}
    if max_features in named:
        n = named[max_features]
    else:
        n = int(max_features) if str(max_features).isdigit() else float(max_features) * d
    return max(1, min(d, math.ceil(n)))


def fit_extra_trees(train: DataFrame, features: Sequence[str], label: str = "label", key: str = "entity_id", n_trees: int = 100,
                    max_depth: int | None = None, min_leaf: int = 1, min_split: int = 2, max_features: str | float | None = "sqrt",
                    bootstrap: bool = False, weight: str | None = None, seed: int = 42) -> Forest:
    """Grow the forest. With ``bootstrap`` every tree weighs each row by a Poisson draw, by hash."""
    return _fit(train, list(features), label, key, n_trees, weight, lambda step: _Rule(
        tuple(features), _share(max_features, len(features)), seed, max_depth, min_leaf, min_split, bootstrap, step, np.float64))


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str = "label", key: str = "entity_id", n_trees: int = 100,
                      max_depth: int | None = None, min_leaf: int = 1, max_features: str | float | None = "sqrt",
                      bootstrap: bool = True, weight: str | None = None, seed: int = 42) -> Forest:
    """Trees whose nodes take the best cut of some features, each on a bootstrap of the rows. A missing value is an error."""
    cuts = tuple(share_cuts(train, features, BINS, weight))
    return _fit(train, list(features), label, key, n_trees, weight, lambda step: _Rule(
        tuple(features), _rounded_up(max_features, len(features)), seed, max_depth, min_leaf, 2, bootstrap, step, np.uint8, cuts))


def _fit(train: DataFrame, features: list[str], label: str, key: str, n_trees: int, weight: str | None,
         rule_of: Callable[[float], _Rule]) -> Forest:
    rows = train.select(*(F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)),
                        F.col(f"`{label}`").cast("double").alias("y"),
                        (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"),
                        F.xxhash64(F.lit(rule_of(1.0).seed), F.col(f"`{key}`")).alias("u"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("w")).first()
    if not n:
        raise ValueError("no training rows")
    rule = rule_of(2.0 ** (math.ceil(math.log2(8 * total)) - 51))  # a row counts a few times over in a bootstrap
    table, merged = _staged(rows, rule, n)
    size = table.agg(F.sum(sum(F.length(c) for c in _BLOCKS.names))).first()[0]
    if size <= TASK_BYTES:
        trees = _grown_in_tasks(table, rule, n_trees, merged)
    else:
        source = _Passes(rule, table)
        trees = _grow(list(range(n_trees)), rule, source)
        source.blocks.unpersist()
    unstage(table)
    return Forest(tuple(trees), tuple(features))


def _staged(rows: DataFrame, rule: _Rule, n: int) -> tuple[DataFrame, bool]:
    """The rows in blocks, and whether equal ones are one row. Those that draw for themselves stay single, unless that many
    rows fall into few combinations of bins."""
    d, step = len(rule.features), rule.step
    names = [f"f{i}" for i in range(d)]
    if rule.cuts is not None:
        cuts = rule.cuts

        @F.pandas_udf("double")
        def bin_of(v: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts[int(i.iloc[0])], v.to_numpy(), "left").astype(float)) if len(v) else pd.Series([], dtype=float)

        rows = rows.withColumns({c: bin_of(F.col(c), F.lit(i)) for i, c in enumerate(names)})

    def pack(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)])
            y, w, u, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "u", "n"))
            block = (np.ascontiguousarray(x, rule.kind), y, np.rint(w / step), u, times)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in block], _BLOCKS.names)

    single = rows.withColumn("n", F.lit(1).cast("long"))
    few = rule.cuts is not None and math.prod(len(c) + 1 for c in rule.cuts) * d < TASK_BYTES / 256
    if few or not rule.bootstrap:
        equal = rows.groupBy(*names, "y", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("u", F.lit(0).cast("long"))
        return stage(equal.mapInArrow(pack, _BLOCKS)), True
    return stage(single.mapInArrow(pack, _BLOCKS)), False


def _grown_in_tasks(table: DataFrame, rule: _Rule, n_trees: int, merged: bool) -> list[Tree]:
    """Each of a few tasks receives all rows and grows its share of the trees."""
    parts = min(n_trees, 2 * table.sparkSession.sparkContext.defaultParallelism)

    def grown(groups):
        for part, blocks in groups:
            arrays = [np.concatenate(some) for some in zip(*map(rule.arrays, blocks))]
            order = np.lexsort((arrays[3], arrays[2], arrays[1], *arrays[0].T))  # draws must not hang on the order of blocks
            arrays = [a[order] for a in arrays]
            for t in range(part, n_trees, parts):
                yield t, _grow([t], rule, _Held(rule, arrays, t, merged))[0]

    sent = table.rdd.map(tuple).flatMap(lambda block: [(part, block) for part in range(parts)]).groupByKey(parts)
    return [tree for _, tree in sorted(sent.mapPartitions(grown).collect(), key=lambda found: found[0])]


def _fold(parts: list, combine):
    out = parts[0]
    for part in parts[1:]:
        out = combine(out, part)
    return out


def _grow(numbers: Sequence[int], rule: _Rule, source: _Passes | _Held) -> list[Tree]:
    """The trees of these numbers, level by level."""
    forest = {t: [_Node("")] for t in numbers}
    split, size = (_split_drawn if rule.cuts is None else _split_best), max(1, PASS_CELLS // rule.width)
    while opened := [(t, i) for t, nodes in forest.items() for i, node in enumerate(nodes) if not node.done]:
        for begin in range(0, len(opened), size):
            slots = opened[begin:begin + size]
            places: dict[int, dict[int, int]] = {}
            for s, (t, i) in enumerate(slots):
                places.setdefault(t, {})[i] = s
            trees = {t: _tree(forest[t]) for t in places}
            split(slots, forest, rule, lambda work, combine, empty: source.over_rows(trees, places, work, combine, empty))
    return [_tree(nodes if rule.cuts is None else _pruned(nodes)) for nodes in forest.values()]


def _drawn(slots, forest, rule: _Rule) -> np.ndarray:
    """The features that each node tries."""
    if rule.k == len(rule.features):
        return np.tile(np.arange(rule.k), (len(slots), 1))
    return np.array([sorted(sorted(range(len(rule.features)), key=lambda f: md5(
        f"{rule.seed}:pick:{t}:{forest[t][i].path}:{rule.features[f]}".encode()).digest())[:rule.k]) for t, i in slots])


def _purity(w, p):
    return np.where(w > 0, (p**2 + (w - p) ** 2) / np.where(w > 0, w, 1.0), 0.0)


def _able(slots, forest, rule: _Rule, sums: np.ndarray) -> np.ndarray:
    """Which nodes may be split."""
    depth = np.array([len(forest[t][i].path) for t, i in slots])
    deepest = rule.max_depth if rule.max_depth is not None else 1 << 30
    return (depth < deepest) & (sums[2] >= max(rule.min_split, 2 * rule.min_leaf)) & (0 < sums[1]) & (sums[1] < sums[0])


def _split_at(nodes: list[_Node], node: _Node, split: tuple) -> None:
    node.split, node.children = split, (len(nodes), len(nodes) + 1)
    nodes += [_Node(node.path + "L"), _Node(node.path + "R")]


def _split_drawn(slots, forest, rule: _Rule, over_rows) -> None:
    """Split (or close) these nodes of the forest at random cuts, with two passes."""
    drawn, n, k, features, seed, step = _drawn(slots, forest, rule), len(slots), rule.k, rule.features, rule.seed, rule.step

    def ranges(out, x, y, w, number, slot):
        low, sums = out
        for c, v in enumerate((w, w * y, number)):
            sums[c] += np.bincount(slot, v, n)
        order = np.argsort(slot.astype(np.uint16) if n <= 1 << 16 else slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        for j in range(k):
            v = x[order, drawn[slot, j]]
            for side, sign in ((0, 1.0), (1, -1.0)):
                filled = np.where(np.isfinite(v), sign * v, np.inf)
                low[side, slot[first], j] = np.minimum(low[side, slot[first], j], np.minimum.reduceat(filled, first))

    low, sums = over_rows(ranges, lambda a, b: (np.minimum(a[0], b[0]), a[1] + b[1]), lambda: (np.full((2, n, k), np.inf), np.zeros((3, n))))
    least, most = low[0], -low[1]
    u = np.array([[_uniform(seed, t, forest[t][i].path, features[f]) for f in drawn[s]] for s, (t, i) in enumerate(slots)])
    with np.errstate(invalid="ignore"):
        cuts = np.where(least < most, least + u * (most - least), np.nan)

    def sides(out, x, y, w, number, slot):
        for j in range(k):
            left = x[np.arange(len(x)), drawn[slot, j]] <= cuts[slot, j]
            for c, v in enumerate((w, w * y, number)):
                out[c, :, j] += np.bincount(slot[left], v[left], n)

    able = _able(slots, forest, rule, sums)
    left = over_rows(sides, np.add, lambda: np.zeros((3, n, k))) if able.any() else np.zeros((3, n, k))
    right = sums[:, :, None] - left
    gain = _purity(left[0], left[1]) + _purity(right[0], right[1]) - _purity(sums[0], sums[1])[:, None]
    gain = np.where((np.minimum(left[2], right[2]) >= rule.min_leaf) & np.isfinite(cuts), gain, -np.inf)
    for s, (t, i) in enumerate(slots):
        nodes, node = forest[t], forest[t][i]
        node.sums, node.done = sums[:, s], True
        j = int(np.argmax(gain[s]))
        if able[s] and np.isfinite(gain[s, j]):
            _split_at(nodes, node, (int(drawn[s, j]), float(cuts[s, j]), float(gain[s, j] * step), 0))


def _split_best(slots, forest, rule: _Rule, over_rows) -> None:
    """Split (or close) these nodes of the forest at the best cuts of the features they draw, with one pass."""
    drawn, n, k = _drawn(slots, forest, rule), len(slots), rule.k
    bins = max(len(c) + 1 for c in rule.cuts)

    def counts(out, x, y, w, number, slot):
        rows = np.arange(len(x))
        for j in range(k):
            cell = slot * bins + x[rows, drawn[slot, j]]
            for c, v in enumerate((w, w * y, number)):
                out[c, :, j] += np.bincount(cell, v, n * bins).reshape(n, bins)

    found = over_rows(counts, np.add, lambda: np.zeros((3, n, k, bins)))
    sums = found[:, :, 0].sum(axis=-1)
    able = _able(slots, forest, rule, sums)
    left = np.cumsum(found, axis=-1)[..., :-1]
    right = sums[:, :, None, None] - left
    gain = _purity(left[0], left[1]) + _purity(right[0], right[1]) - _purity(sums[0], sums[1])[:, None, None]
    gain = np.where(np.minimum(left[2], right[2]) >= max(1, rule.min_leaf), gain, -np.inf).reshape(n, -1)
    best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(n, int)
    for s, (t, i) in enumerate(slots):
        nodes, node = forest[t], forest[t][i]
        node.sums, node.done = sums[:, s], True
        if able[s] and gain.shape[1] and gain[s, best[s]] > LEAST_GAIN * sums[0, s]:
            j, low = divmod(int(best[s]), bins - 1)
            f = int(drawn[s, j])
            _split_at(nodes, node, (f, float(rule.cuts[f][low]), float(gain[s, best[s]] * rule.step), low))
