"""Second-order gradient boosting for binary labels over histograms: level-wise, leaf-wise or symmetric trees.

Rows are binned once, at quantiles of all rows, and written as a table of blocks of bytes. A pass over it scores the
rows with the trees of the last rounds, sorts them into the nodes that are asked for and adds up gradients and hessians
per (node, feature, bin); partial sums are combined in a tree of tasks, and what reaches the driver has the size of
nodes x features x bins, whatever the number of rows. A fit takes hundreds of passes over the same blocks, each of
them arithmetic on whole partitions without anything to plan, so they run over the table's RDD, kept in memory or on
disk and read again from the table where an executor is lost. The driver picks the splits and asks for the next nodes. A
leaf-wise tree takes about as many passes as it is deep, not one per leaf: all nodes that might be split next are
counted ahead, and the splits kept are exactly those of best-first growth.

Gradients and hessians are rounded to multiples of a step so small that all sums are exact in double precision. A
tree therefore does not depend on partitions, task order or repeated tasks.

Where the bins of all features have fewer combinations than there are rows, and no rows are drawn, rows that agree in
bins, label, weight and being held out are one row that counts several times: no split can tell them apart, and sums
are exact, so the trees are the same.

A pass over few rows is all scheduling. Up to ``ONE_TASK_BYTES`` of binned rows the whole fit is therefore one task that
holds them, asks itself the same questions and returns the trees; since sums are exact, they are the same trees. It keeps
the node of each row, so that a question moves rows down by the newest level only.

With ``newton`` off, trees are those of plain gradient boosting: a node's hessian is its weight, so that splits are those of the
largest decrease of variance and leaves the mean gradient.

With ``patience``, a share of the rows, by a hash of their key, is kept out of the histograms; their loss is summed in
the first pass of each round, and rounds behind the best one are dropped once the loss has not improved for so long.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cohortlens.session import stage, unstage

#: Rounds after which the rows' scores are written anew, so that a pass never evaluates more trees than this.
STAGE_EVERY = 25
#: Numbers (nodes x features x bins) that one pass adds up; more nodes are dealt with in several passes.
PASS_CELLS = 1 << 21
#: Share of the rows that decides when to stop.
VALIDATION_SHARE = 0.1
#: Partial sums (partitions x nodes x features x bins) that the driver adds up itself.
DIRECT_CELLS = 1 << 18
#: Binned rows of up to this size are boosted by one task, more by a pass over all tasks for each set of nodes.
ONE_TASK_BYTES = 64 << 20
#: A tree with up to so many different splits is a table of its leaves by their outcomes.
FEW_SPLITS = 8
#: Rows scored at a time, so that they stay in the cache from tree to tree.
SCORED_ROWS = 8192


@dataclass(frozen=True)
class Growth:
    """How an ensemble grows. ``shape``: "level" (all nodes), "leaf" (best first, up to ``max_leaves``) or
    "symmetric" (one split for all nodes of a level)."""

    rounds: int = 100
    learning_rate: float = 0.1
    shape: str = "level"
    max_depth: int | None = 6
    max_leaves: int | None = None
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_gain: float = 0.0
    min_hessian: float = 0.0
    min_rows: int = 1
    row_share: float = 1.0
    feature_share: float = 1.0
    bins: int = 255
    base_score: float | None = None  # None: the weighted share of positives
    patience: int | None = None
    tolerance: float = 0.0
    seed: int = 42
    newton: bool = True
    first_rate: float | None = None  # of the first round, if not learning_rate
    link: float = 1.0  # the log odds are so many times the sum of the trees


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays. A row goes left if its value is at most ``cut``, or missing and ``missing_left``; leaves lead to
    themselves. ``low`` is the cut as a bin."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    hessian: np.ndarray
    rows: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray, cuts: np.ndarray, missing: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Node of each row of ``x``; ``cuts`` are of the same kind as ``x`` (values or bins). ``at``: nodes of this tree that
        the rows have reached already."""
        if at is None and self.outcomes is not None:
            splits, leaves = self.outcomes
            code = np.zeros(len(x), np.uint8)
            for bit, node in enumerate(splits):
                code |= self._goes_left(x, cuts, missing, node).view(np.uint8) << bit
            return leaves[code]
        if at is not None:
            at = at.copy()
            while len(rows := np.flatnonzero(self.left[at] != at)):
                node = at[rows]
                f = self.feature[node]
                left = np.where(missing[rows, f], self.missing_left[node], x[rows, f] <= cuts[node])
                at[rows] = np.where(left, self.left[node], self.right[node])
            return at
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[at]
            left = np.where(missing[rows, f], self.missing_left[at], x[rows, f] <= cuts[at])
            at = np.where(left, self.left[at], self.right[at])
        return at

    def _goes_left(self, x: np.ndarray, cuts: np.ndarray, missing: np.ndarray, node: int) -> np.ndarray:
        f = self.feature[node]
        left, gap = x[:, f] <= cuts[node], missing[:, f]
        return left | gap if self.missing_left[node] else left & ~gap

    @cached_property
    def outcomes(self) -> tuple[np.ndarray, np.ndarray] | None:
        """A node for each different split, and the leaf by the bits of their outcomes (1: left); None for many splits."""
        inner = np.flatnonzero(self.left != np.arange(len(self.left)))
        kinds = {(int(self.feature[i]), float(self.cut[i]), bool(self.missing_left[i])): int(i) for i in inner}
        if not kinds or len(kinds) > FEW_SPLITS:
            return None
        bit, number = np.zeros(len(self.left), np.int64), {kind: b for b, kind in enumerate(kinds)}
        for i in inner:
            bit[i] = number[(int(self.feature[i]), float(self.cut[i]), bool(self.missing_left[i]))]
        codes = np.arange(1 << len(kinds))
        at = np.zeros(len(codes), np.int64)
        for _ in range(self.depth):
            at = np.where(codes >> bit[at] & 1, self.left[at], self.right[at])
        return np.array(list(kinds.values())), at

    def paths(self) -> list[tuple[float, list[tuple[int, float, float, float, bool]]]]:
        """Every leaf as (value, [(feature, low, high, share of the hessian that follows, whether missing follows)])."""
        out, todo = [], [(0, {})]
        while todo:
            at, path = todo.pop()
            if self.left[at] == at:
                out.append((float(self.value[at]), [(f, *r) for f, r in path.items()]))
                continue
            f, cut = int(self.feature[at]), float(self.cut[at])
            low, high, share, gap = path.get(f, (-np.inf, np.inf, 1.0, True))
            for side, lo, hi, takes in ((self.left[at], low, min(high, cut), bool(self.missing_left[at])),
                                        (self.right[at], max(low, cut), high, not self.missing_left[at])):
                part = float(self.hessian[side] / self.hessian[at])
                todo.append((int(side), {**path, f: (lo, hi, share * part, gap and takes)}))
        return out


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted ensemble: ``base`` (log odds) and trees whose values add up to the log odds."""

    trees: tuple[Tree, ...]
    features: tuple[str, ...]
    base: float
    losses: tuple[float, ...] = ()  # of the validation rows before each round, and after the last one
    link: float = 1.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for start in range(0, len(x), SCORED_ROWS):
            part, own = np.asfortranarray(x[start:start + SCORED_ROWS]), total[start:start + SCORED_ROWS]
            missing = ~np.isfinite(part)
            for tree in self.trees:
                own += tree.value[tree.leaf(part, tree.cut, missing)]
        return total

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        require_features(df, self.features)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(_probability(shared.value.link * shared.value.margins(columns.to_numpy(float))))

        return df.withColumn(out, probability(F.struct(*(F.col(f"`{f}`").cast("double").alias(f) for f in self.features))))

    def importances(self) -> dict[str, float]:
        """Share of the total gain of each feature."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            np.add.at(total, tree.feature[tree.left != np.arange(len(tree.left))], tree.gain[tree.left != np.arange(len(tree.left))])
        whole = total.sum()
        return {f: float(v / whole) if whole else 0.0 for f, v in zip(self.features, total)}

    def paths(self) -> list[tuple]:
        return [p for tree in self.trees for p in tree.paths()]

    def nodes(self, spark: SparkSession) -> DataFrame:
        return node_table(spark, self.trees, self.features)


def node_table(spark: SparkSession, trees: Sequence[Tree], features: Sequence[str]) -> DataFrame:
    """One row per node: tree, path from the root (L and R), split, gain, training rows and value."""
    rows = []
    for number, tree in enumerate(trees):
        todo = [(0, "")]
        while todo:
            at, path = todo.pop()
            inner = tree.left[at] != at
            rows.append((number, path, features[tree.feature[at]] if inner else None, float(tree.cut[at]) if inner else None,
                         float(tree.gain[at]) if inner else None, int(tree.rows[at]), float(tree.value[at])))
            if inner:
                todo += [(int(tree.left[at]), path + "L"), (int(tree.right[at]), path + "R")]
    return spark.createDataFrame(rows, "tree int, path string, feature string, cut double, gain double, n_rows long, value double")


def require_features(df: DataFrame, features: Sequence[str]) -> None:
    """The feature contract of a fitted model: every feature by name, as a number."""
    kinds = dict(df.dtypes)
    absent = [f for f in features if f not in kinds]
    odd = [f for f in features if f in kinds and kinds[f].split("(")[0] not in
           ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal", "boolean")]
    if absent or odd:
        raise ValueError(f"the model needs features that are absent {absent} or no numbers {odd}")


# --- the binned table ---------------------------------------------------------------------

def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 cuts per feature, values of the feature itself; only they reach the driver."""
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    finite = [F.when(~F.isnan(F.col(f"`{f}`").cast("double")) & (F.abs(F.col(f"`{f}`").cast("double")) < float("inf")),
                     F.col(f"`{f}`").cast("double")) for f in features]
    found = df.select(*(F.percentile_approx(c, at, 100 * bins).alias(f"q{i}") for i, c in enumerate(finite))).first()
    return [np.unique(np.array(q or (), float)) for q in found]


@dataclass
class _Rows:
    """The binned rows in blocks, staged: ``x`` (a byte or two per feature), ``y``, ``w``, ``u`` (hash of the key), ``held``
    (out of the histograms), ``n`` (how often the row counts) and ``m`` (log odds by the trees up to the last staging), each
    the bytes of an array."""

    table: DataFrame | None
    blocks: RDD | None
    cuts: list[np.ndarray]
    kind: type
    missing: int  # the bin of missing values, beyond all others
    step: float
    base: float
    n_rows: int
    link: float = 1.0

    @property
    def size(self) -> int:
        return self.n_rows * (len(self.cuts) * np.dtype(self.kind).itemsize + sum(np.dtype(k).itemsize for k in _KINDS))

    def arrays(self, block) -> tuple[np.ndarray, ...]:
        return (np.frombuffer(block[0], self.kind).reshape(-1, len(self.cuts)), *(np.frombuffer(b, k) for b, k in zip(block[1:], _KINDS)))


_KINDS = (np.float64, np.float64, np.int64, np.bool_, np.int64, np.float64)
_BLOCKS = StructType([StructField(c, BinaryType()) for c in ("x", "y", "w", "u", "held", "n", "m")])


def _kept(table: DataFrame) -> RDD:
    return table.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _bin_rows(train: DataFrame, features: Sequence[str], label: str, key: str, weight: str | None,
              cuts: list[np.ndarray], growth: Growth) -> _Rows:
    kind = np.uint8 if max(map(len, cuts)) + 2 <= 256 else np.uint16
    missing = max(map(len, cuts)) + 1
    share = int(VALIDATION_SHARE * 2**32) if growth.patience is not None else 0
    # of the two halves of the hash one holds rows out, the other draws the rows of a round
    rows = train.select(*(F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)),
                        F.col(f"`{label}`").cast("double").alias("y"),
                        (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"),
                        F.xxhash64(F.lit(growth.seed), F.col(f"`{key}`")).alias("u"))
    n, total, positive = rows.agg(F.count(F.lit(1)), F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    if not n:
        raise ValueError("no training rows")
    if not 0 < positive < total:
        raise ValueError("training rows hold one class only")
    p = positive / total if growth.base_score is None else growth.base_score
    base = math.log(p / (1 - p)) / growth.link

    def binned(batch):
        x = np.empty((batch.num_rows, len(cuts)), kind)
        for i, c in enumerate(cuts):
            v = batch.column(i).to_numpy(zero_copy_only=False)
            x[:, i] = np.where(np.isfinite(v), np.searchsorted(c, v, "left"), missing)
        y, w, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "u"))
        return x, y, w, u, (u >> 32) + 2**31 < share

    def block(x, y, w, u, held, times):
        arrays = (x, y, w, u, held, times, np.full(len(y), base))
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in arrays], _BLOCKS.names)

    def run(batches):
        for batch in batches:
            yield block(*binned(batch), np.ones(batch.num_rows, np.int64))

    def single(batches):
        for batch in batches:
            x, y, w, _, held = binned(batch)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *map(pa.array, (y, w, held))], ["x", "y", "w", "held"])

    def pack(batches):
        for batch in batches:
            y, w, held, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "held", "n"))
            yield block(np.frombuffer(b"".join(batch.column("x").to_pylist()), kind), y, w, np.zeros(len(y), np.int64), held, times)

    if growth.row_share >= 1 and math.prod(len(c) + 2 for c in cuts) < n:
        merged = (rows.mapInArrow(single, "x binary, y double, w double, held boolean")
                  .groupBy("x", "y", "w", "held").agg(F.count(F.lit(1)).alias("n")))
        table = stage(merged.mapInArrow(pack, _BLOCKS))
        n = table.agg(F.sum(F.length("held"))).first()[0]
    else:
        table = stage(rows.mapInArrow(run, _BLOCKS))
    # |gradient| and hessian are at most the weight: all sums stay below 2 ** 52 steps
    step = 2.0 ** (math.ceil(math.log2(total)) - 51)
    return _Rows(table, None, cuts, kind, missing, step, base, n, growth.link)


def _margin(x: np.ndarray, start: np.ndarray, trees: Sequence[Tree], missing: int) -> np.ndarray:
    total, gaps = start.copy(), x == missing
    for tree in trees:
        total += tree.value[tree.leaf(x, tree.low, gaps)]
    return total


@dataclass(frozen=True)
class _Question:
    """What to count: gradient, hessian and rows by (column, bin) in each of ``nodes`` of the tree that grows; with ``loss``
    also loss, weight and number of the held-out rows."""

    growing: Tree
    nodes: tuple[int, ...]
    columns: np.ndarray
    seed: int
    row_share: float
    loss: bool
    newton: bool = True

    def answer(self, rows: _Rows, arrays: Sequence[np.ndarray], p: np.ndarray) -> np.ndarray:
        """The numbers for one block, flat, those of the held-out rows last."""
        x, y, w, u, held, times, _ = arrays
        at = self.growing.leaf(x, self.growing.low, x == rows.missing)
        keep = ~held
        sums = self.tally(rows, x[keep], u[keep], at[keep], *_slopes(y[keep], w[keep], times[keep], p[keep], rows.step, self.newton))
        return np.append(sums, _loss(y[held], w[held], times[held], p[held], rows.step) if self.loss else np.zeros(3))

    def tally(self, rows: _Rows, x: np.ndarray, u: np.ndarray, at: np.ndarray, *values: np.ndarray) -> np.ndarray:
        """Gradient, hessian and number (``values`` of each row) by (column, what, node and bin), flat. ``at``: the rows' nodes."""
        bins = rows.missing + 1
        cells, limit = len(self.nodes) * bins, int(self.row_share * 2**31)
        first_cell = np.full(len(self.growing.value), -1)
        first_cell[list(self.nodes)] = np.arange(len(self.nodes)) * bins
        first = first_cell[at]
        if limit < 2**31:  # the low half of the hash, scattered anew each round
            first[((u ^ (self.seed * 0x9E3779B1)) * 0x5851F42D & 0xFFFFFFFF) >> 1 >= limit] = -1
        keep = slice(None)
        if len(first) and first.min() < 0:
            keep = np.flatnonzero(first >= 0)
            first, values = first[keep], [v[keep] for v in values]
        total = np.zeros((len(self.columns), 3, cells))
        for j, f in enumerate(self.columns):
            cell = first + x[:, f][keep]
            total[j] = [np.bincount(cell, v, cells) for v in values]
        return total.ravel()

    def shaped(self, rows: _Rows, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums by (slot, feature, bin), and those of the held-out rows."""
        return found[:-3].reshape(len(self.columns), 3, len(self.nodes), rows.missing + 1).transpose(1, 2, 0, 3), found[-3:]


def _slopes(y: np.ndarray, w: np.ndarray, times: np.ndarray, p: np.ndarray, step: float, newton: bool) -> tuple[np.ndarray, ...]:
    """Gradient, hessian (both in steps) and number of each row."""
    g = np.rint(w * (p - y) / step) * times
    return g, np.rint((w * p * (1 - p) if newton else w) / step) * times, times.astype(float)


def _loss(y: np.ndarray, w: np.ndarray, times: np.ndarray, p: np.ndarray, step: float) -> np.ndarray:
    """Loss, weight and number of the rows."""
    each = -w * np.where(y > 0.5, np.log(np.maximum(p, 1e-15)), np.log(np.maximum(1 - p, 1e-15)))
    return np.array([(np.rint(each / (64 * step)) * times).sum(), (np.rint(w / step) * times).sum(), times.sum()], float)


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


class _Passes:
    """Questions answered by a pass over the table each; trees since the last staging travel with the pass."""

    def __init__(self, rows: _Rows):
        self.rows, self.recent = rows, []
        rows.blocks = _kept(rows.table)

    def ask(self, question: _Question) -> tuple[np.ndarray, np.ndarray]:
        rows, recent = replace(self.rows, table=None, blocks=None), self.recent

        def run(blocks):
            total = None
            for block in blocks:
                arrays = rows.arrays(block)
                part = question.answer(rows, arrays, _probability(rows.link * _margin(arrays[0], arrays[-1], recent, rows.missing)))
                total = part if total is None else total + part
            return [] if total is None else [total]

        parts, cells = self.rows.blocks.mapPartitions(run), len(question.columns) * len(question.nodes) * (rows.missing + 1)
        # sums are exact: in which order they are added up makes no difference
        spread = self.rows.blocks.getNumPartitions() * cells > DIRECT_CELLS
        return question.shaped(rows, parts.treeReduce(np.add) if spread else sum(parts.collect()))

    def add(self, tree: Tree, last: bool) -> None:
        self.recent = [*self.recent, tree]
        if len(self.recent) == STAGE_EVERY and not last:
            _write_margins(self.rows, self.recent)
            self.recent = []


class _Held:
    """Questions answered from rows that this task holds, those held out apart from the others."""

    def __init__(self, rows: _Rows, blocks):
        self.rows = rows
        x, y, w, u, held, times, start = (np.concatenate(parts) for parts in zip(*map(rows.arrays, blocks)))
        self.train, self.out = (_Part(rows, *(a[own] for a in (x, y, w, u, times, start))) for own in (~held, held))

    def ask(self, question: _Question) -> tuple[np.ndarray, np.ndarray]:
        self.train.move(question.growing)
        found = question.tally(self.rows, self.train.x, self.train.u, self.train.at, *self.train.slopes(question.newton))
        return question.shaped(self.rows, np.append(found, self.out.loss() if question.loss else np.zeros(3)))

    def add(self, tree: Tree, last: bool) -> None:
        self.train.add(tree)
        self.out.add(tree)


class _Part:
    """Rows by columns, their log odds so far and their nodes in the tree that grows."""

    def __init__(self, rows: _Rows, x, y, w, u, times, margin):
        self.rows, self.x, self.y, self.w, self.u, self.times, self.margin = rows, np.asfortranarray(x), y, w, u, times, margin
        self.gaps = self.x == rows.missing
        self.p = _probability(rows.link * margin)
        self.at, self.left_behind = np.zeros(len(y), np.int64), np.zeros(1, bool)
        self.known: tuple[np.ndarray, ...] | None = None

    def slopes(self, newton: bool) -> tuple[np.ndarray, ...]:
        """They change with the log odds only."""
        if self.known is None:
            self.known = _slopes(self.y, self.w, self.times, self.p, self.rows.step, newton)
        return self.known

    def loss(self) -> np.ndarray:
        return _loss(self.y, self.w, self.times, self.p, self.rows.step)

    def move(self, tree: Tree) -> None:
        """To the leaves of a tree that has only grown since the last call, or is a new one (a root)."""
        n = len(tree.value)
        if n == 1:
            self.at, self.left_behind = np.zeros(len(self.y), np.int64), np.zeros(1, bool)
        inner = tree.left != np.arange(n)
        new = np.flatnonzero(inner & ~np.append(self.left_behind, np.zeros(n - len(self.left_behind), bool)))
        if len({(tree.feature[i], tree.low[i], tree.missing_left[i]) for i in new}) == 1 and not inner[[tree.left[new], tree.right[new]]].any():
            goes = tree._goes_left(self.x, tree.low, self.gaps, new[0])  # one split for all of them
            self.at = np.append(tree.right, tree.left)[self.at + n * goes]
        elif len(new):
            self.at = tree.leaf(self.x, tree.low, self.gaps, self.at)
        self.left_behind = inner

    def add(self, tree: Tree) -> None:
        self.margin = self.margin + tree.value[tree.leaf(self.x, tree.low, self.gaps)]
        self.p, self.known = _probability(self.rows.link * self.margin), None


# --- splits -------------------------------------------------------------------------------

def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _worth(g, h, growth: Growth):
    total = h + growth.reg_lambda
    return np.where(total > 0, _shrunk(g, growth.reg_alpha) ** 2 / np.where(total > 0, total, 1.0), 0.0)


def _gains(sums: np.ndarray, n_cuts: np.ndarray, growth: Growth):
    """Gain of every (slot, feature, cut, side of missing values), and the left sums; impossible splits are -inf."""
    cumulated = np.cumsum(sums[..., :-1], axis=-1)[..., :-1]
    whole = sums.sum(axis=-1)
    left = np.stack([cumulated, cumulated + sums[..., -1:]], axis=-1)  # (3, slots, features, cuts, side)
    right = whole[..., None, None] - left
    gain = _worth(left[0], left[1], growth) + _worth(right[0], right[1], growth) - _worth(whole[0], whole[1], growth)[..., None, None]
    least_rows = max(growth.min_rows, 1)
    fits = ((left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= growth.min_hessian) & (right[1] >= growth.min_hessian)
            & (np.arange(left.shape[-2])[:, None] < n_cuts[:, None, None]))
    return np.where(fits, gain, -np.inf), left


@dataclass
class _Node:
    sums: np.ndarray  # gradient, hessian, rows
    depth: int
    split: tuple | None = None  # (gain, column, bin, missing left, sums of the left child)
    children: tuple[int, int] | None = None
    counted: bool = False


class _Grower:
    """One tree on the driver: the nodes that exist so far, and which are worth counting next."""

    def __init__(self, rows: _Rows, growth: Growth, columns: np.ndarray):
        self.rows, self.growth, self.columns = rows, growth, columns
        self.n_cuts = np.array([len(rows.cuts[f]) for f in columns])
        self.nodes = [_Node(np.zeros(3), 0)]

    def wanted(self) -> list[int]:
        """Nodes to count in the next pass; none when the tree is complete."""
        g = self.growth
        if g.shape != "leaf":
            pending = [i for i, n in enumerate(self.nodes) if not n.counted]
        else:
            pending = self._kept()[1]
        deepest = g.max_depth if g.max_depth is not None else 1 << 30
        ready = [i for i in pending if self.nodes[i].depth < deepest and (i == 0 or self.nodes[i].sums[2] >= 2 * max(g.min_rows, 1))]
        for i in set(pending) - set(ready):
            self.nodes[i].counted = True  # too deep or too small to be split
        return ready if ready or not pending or g.shape != "leaf" else self.wanted()

    def _kept(self) -> tuple[set[int], list[int]]:
        """Best-first growth over what is known: the nodes split, and those to be counted before it is certain."""
        limit = self.growth.max_leaves if self.growth.max_leaves is not None else 1 << 30
        kept, pending, heap = set(), [], []

        def offer(i: int) -> None:
            node = self.nodes[i]
            if not node.counted:
                pending.append(i)
            elif node.split is not None:
                heapq.heappush(heap, (-node.split[0], i))

        offer(0)
        while heap and len(kept) + 1 < limit:
            _, i = heapq.heappop(heap)
            kept.add(i)
            for child in self.nodes[i].children:
                offer(child)
        return kept, pending

    def take(self, asked: Sequence[int], sums: np.ndarray) -> None:
        """Enter the sums of the nodes asked for and split them."""
        gain, left = _gains(sums, self.n_cuts, self.growth)
        if self.growth.shape == "symmetric":
            shared = np.where(np.isfinite(gain), gain, 0.0).sum(axis=0)
            shared[~np.isfinite(gain).any(axis=0)] = -np.inf
            best = [np.unravel_index(np.argmax(shared), shared.shape)] * len(asked)
            if not shared.max() > self.growth.min_gain:
                best = []
        else:
            best = [np.unravel_index(np.argmax(gain[s]), gain[s].shape) for s in range(len(asked))]
        for s, i in enumerate(asked):
            node = self.nodes[i]
            node.counted = True
            if i == 0:
                node.sums = sums[:, s, 0].sum(axis=-1)
            if not best:
                continue
            worth = float(gain[(s, *best[s])])
            if self.growth.shape == "symmetric" and not np.isfinite(worth):
                node.depth, node.counted = node.depth + 1, False  # all rows on one side: whole into the next level
                continue
            if self.growth.shape != "symmetric" and not worth > self.growth.min_gain:
                continue
            column, cut, side = map(int, best[s])
            part = left[:, s, column, cut, side].copy()
            node.split = (worth, column, cut, bool(side), part)
            node.children = (len(self.nodes), len(self.nodes) + 1)
            self.nodes += [_Node(part, node.depth + 1), _Node(node.sums - part, node.depth + 1)]

    def tree(self, final: bool = True) -> Tree:
        """As arrays; ``final`` leaves out what best-first growth did not keep."""
        kept = self._kept()[0] if final and self.growth.shape == "leaf" else {i for i, n in enumerate(self.nodes) if n.children}
        n, g, step = len(self.nodes), self.growth, self.rows.step
        sums = np.array([node.sums for node in self.nodes])
        hessian = sums[:, 1] * step + g.reg_lambda
        value = -_shrunk(sums[:, 0] * step, g.reg_alpha) / np.where(hessian > 0, hessian, np.inf) * g.learning_rate
        own = np.arange(n)
        tree = Tree(np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, 1 << 30), np.zeros(n, bool), own.copy(), own.copy(), value,
                    np.zeros(n), sums[:, 1] * step, sums[:, 2].astype(np.int64), max((self.nodes[i].depth + 1 for i in kept), default=0))
        for i in kept:
            worth, column, cut, missing_left, _ = self.nodes[i].split
            feature = self.columns[column]
            tree.feature[i], tree.low[i], tree.cut[i] = feature, cut, self.rows.cuts[feature][cut]
            tree.missing_left[i], tree.gain[i] = missing_left, worth * step
            tree.left[i], tree.right[i] = self.nodes[i].children
        return tree


def _features_of(round_no: int, n: int, growth: Growth) -> np.ndarray:
    if growth.feature_share >= 1:
        return np.arange(n)
    rng = np.random.default_rng([growth.seed, round_no])
    return np.sort(rng.permutation(n)[:max(1, round(growth.feature_share * n))])


def fit_boosted(train: DataFrame, features: Sequence[str], label: str = "label", key: str = "entity_id",
                growth: Growth = Growth(), weight: str | None = None,
                cuts: Mapping[str, Sequence[float]] | None = None) -> BoostedTrees:
    """Boost trees on ``train``; ``cuts`` replaces the quantiles of the features it names."""
    features = list(features)
    missing_cuts = [f for f in features if f not in (cuts or {})]
    found = dict(zip(missing_cuts, quantile_cuts(train, missing_cuts, growth.bins))) if missing_cuts else {}
    table = [np.asarray(found[f] if f in found else sorted(set(cuts[f])), float) for f in features]
    rows = _bin_rows(train, features, label, key, weight, table, growth)
    if rows.size <= ONE_TASK_BYTES:
        held = replace(rows, table=None)
        blocks = rows.table.rdd.map(tuple).coalesce(1)
        trees, losses = blocks.mapPartitions(lambda some: [_boost(held, growth, _Held(held, some))]).collect()[0]
    else:
        trees, losses = _boost(rows, growth, _Passes(rows))
        rows.blocks.unpersist()
    unstage(rows.table)
    return BoostedTrees(tuple(trees), tuple(features), rows.base, tuple(losses), growth.link)


def _boost(rows: _Rows, growth: Growth, source: _Passes | _Held) -> tuple[list[Tree], list[float]]:
    """The trees that stay, and the losses of the held-out rows."""
    # the regularisers are stated for sums, so they are counted in steps
    scaled = replace(growth, reg_lambda=growth.reg_lambda / rows.step, reg_alpha=growth.reg_alpha / rows.step,
                     min_gain=growth.min_gain / rows.step, min_hessian=growth.min_hessian / rows.step)
    trees: list[Tree] = []
    losses: list[float] = []
    best = 0

    def worse(held: np.ndarray) -> bool:
        """After a new loss: whether the best round lies ``patience`` rounds behind."""
        nonlocal best
        losses.append(64 * held[0] / held[1] if held[1] else 0.0)
        if losses[-1] < losses[best] - growth.tolerance or len(losses) == 1:
            best = len(losses) - 1
        return len(losses) - 1 - best >= growth.patience

    every = growth
    for round_no in range(growth.rounds):
        growth = replace(every, learning_rate=every.first_rate) if round_no == 0 and every.first_rate is not None else every
        columns = _features_of(round_no, len(rows.cuts), growth)
        grower = _Grower(rows, scaled, columns)
        per_pass = max(1, PASS_CELLS // (len(columns) * (rows.missing + 1)))
        stopped = False
        while asked := grower.wanted():
            for i in range(0, len(asked), per_pass) if growth.shape != "symmetric" else [0]:
                part = asked[i:i + per_pass] if growth.shape != "symmetric" else asked
                loss = growth.patience is not None and part[0] == 0
                sums, held = source.ask(_Question(_unscaled(grower, growth).tree(False), tuple(part), columns,
                                                  growth.seed + round_no, growth.row_share, loss, growth.newton))
                if loss:
                    stopped = worse(held)
                grower.take(part, sums)
            if stopped:
                break
        if stopped:
            break
        tree = _unscaled(grower, growth).tree()
        trees.append(tree)
        if tree.depth == 0 and growth.row_share >= 1 and growth.feature_share >= 1 and growth.newton:
            break  # no split is worth it, nor will it be in later rounds
        source.add(tree, round_no + 1 == growth.rounds)
    else:
        if growth.patience is not None:
            empty = _Grower(rows, scaled, np.arange(1))
            worse(source.ask(_Question(_unscaled(empty, growth).tree(False), (0,), np.arange(1), growth.seed, growth.row_share, True))[1])
    return trees[:best] if growth.patience is not None else trees, losses


def _unscaled(grower: _Grower, growth: Growth) -> _Grower:
    """The same nodes, valued with the regularisers as they were given."""
    other = _Grower(grower.rows, growth, grower.columns)
    other.nodes = grower.nodes
    return other


def _write_margins(rows: _Rows, recent: Sequence[Tree]) -> None:
    arrays, missing, trees = replace(rows, table=None, blocks=None).arrays, rows.missing, list(recent)

    def run(batches):
        for batch in batches:
            out = []
            for block in zip(*(c.to_pylist() for c in batch.columns)):
                x, *_, start = arrays(block)
                out.append(_margin(x, start, trees, missing).tobytes())
            yield batch.set_column(6, "m", pa.array(out, pa.binary()))

    table = stage(rows.table.mapInArrow(run, _BLOCKS))
    rows.blocks.unpersist()
    unstage(rows.table)
    rows.table, rows.blocks = table, _kept(table)
