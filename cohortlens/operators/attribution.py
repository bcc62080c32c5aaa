"""Attribution of a score to its features, one row per (entity, feature): linear, tree, any model."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators.linear import LinearScore
from cohortlens.operators.ranking import hash_uniform
from cohortlens.session import stage_dir


def linear_attribution(df: DataFrame, model: LinearScore, key: str = "entity_id",
                       model_id: str = "linear") -> DataFrame:
    """phi = coefficient x (value - mean): adds up to the margin minus the mean margin."""
    features = list(model.coefficients)
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    phi = [
        (F.lit(float(model.coefficients[f])) * (F.col(f) - F.lit(float(means[f])))).alias(f) for f in features
    ]
    return df.select(key, *phi).unpivot([key], features, "feature", "phi").withColumn("model_id", F.lit(model_id))


# --- trees ------------------------------------------------------------------------------

def tree_paths(model, spark) -> list[tuple]:
    """Every leaf of a fitted MLlib tree model as its path: (value, [(feature, low, high, share)]).

    ``share`` is the part of the training weight that follows the path at that feature's
    splits; ranges of a feature met twice are intersected and its shares multiplied. The node
    table comes from the saved model. Values are on the scale that adds up to the score:
    margin for boosting, probability of the positive class for trees and forests.
    """
    path = f"{stage_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "treeID" not in table.columns:
        table = table.select(F.lit(0).alias("treeID"), F.struct(*table.columns).alias("nodeData"))
    trees: dict[int, dict] = {}
    for r in table.collect():  # the size of the model, not of the data
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    boosted = "GBT" in type(model).__name__
    weights = model.treeWeights if hasattr(model, "treeWeights") else [1.0]
    total = 1.0 if boosted else float(sum(weights))
    leaves = []
    for tree, nodes in trees.items():
        _walk(nodes, 0, {}, leaves, float(weights[tree]) / total, boosted)
    return leaves


def _walk(nodes: dict, at: int, path: dict, leaves: list, weight: float, boosted: bool) -> None:
    node = nodes[at]
    if node["leftChild"] < 0:
        stats = node["impurityStats"]
        value = node["prediction"] if boosted else stats[1] / sum(stats)
        leaves.append((weight * value, [(f, *r) for f, r in path.items()]))
        return
    f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
    cover = {side: _cover(nodes[node[side]], boosted) for side in ("leftChild", "rightChild")}
    everything = sum(cover.values())
    for side, lo, hi in (("leftChild", low, min(high, cut)), ("rightChild", max(low, cut), high)):
        _walk(nodes, node[side], {**path, f: (lo, hi, share * cover[side] / everything)}, leaves, weight, boosted)


def _cover(node, boosted: bool) -> float:
    """Training weight that reached a node."""
    return node["impurityStats"][0] if boosted else sum(node["impurityStats"])


#: Paths up to this length have a table of attributions by which of their ranges a row is inside of.
TABLE_LENGTH = 8
_CELLS = 1 << 21


@dataclass(frozen=True)
class PathGroup:
    """Leaves whose paths use the same number of features, one row per leaf."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    gap: np.ndarray  # whether a missing value follows the path
    value: np.ndarray
    table: np.ndarray | None  # (leaf, pattern of ranges that hold the row, feature of the path)


def flat_paths(leaves: Sequence[tuple]) -> list[PathGroup]:
    """Leaves (value, [(feature, low, high, share[, gap])]) as arrays, grouped by the length of their path."""
    by_length: dict[int, list] = {}
    for value, ranges in leaves:
        by_length.setdefault(len(ranges), []).append((value, [(*r, False)[:5] for r in ranges]))
    out = []
    for m, some in sorted(by_length.items()):
        f, low, high, share, gap = (np.array([[r[k] for r in ranges] for _, ranges in some]).reshape(len(some), m) for k in range(5))
        value = np.array([v for v, _ in some], float)
        table = None
        if 0 < m <= TABLE_LENGTH:
            inside = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
            table = _shapley(np.broadcast_to(inside, (len(some), 1 << m, m)), share[:, None, :]) * value[:, None, None]
        out.append(PathGroup(f.astype(int), low.astype(float), high.astype(float), share.astype(float), gap.astype(bool), value, table))
    return out


def _shapley(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the product over the last axis of (1 if inside, else share).

    The value of a feature is the mean over subset sizes of the other features' products, which are the
    coefficients of a polynomial.
    """
    m = inside.shape[-1]
    share = np.broadcast_to(share, inside.shape)
    # weight of a subset of size s out of the m - 1 other features: s! (m - 1 - s)! / m!
    size_weight = np.array([1.0 / (m * math.comb(m - 1, s)) for s in range(m)])
    phi = np.empty(inside.shape)
    for i in range(m):
        poly = np.zeros((m, *inside.shape[:-1]))
        poly[0] = 1.0
        for j in range(m):
            if j != i:
                poly[1:] = poly[1:] * share[..., j] + poly[:-1] * inside[..., j]
                poly[0] = poly[0] * share[..., j]
        phi[..., i] = (inside[..., i] - share[..., i]) * np.tensordot(size_weight, poly, 1)
    return phi


def expected_value(leaves: Sequence[tuple]) -> float:
    """What a row with nothing known about it scores."""
    return sum(value * float(np.prod([r[3] for r in ranges])) for value, ranges in leaves)


def path_shapley(x: np.ndarray, groups: Sequence[PathGroup]) -> np.ndarray:
    """Path-dependent Shapley values of additive trees for a block of rows, many leaves at a time."""
    phi, missing = np.zeros_like(x, dtype=float), ~np.isfinite(x)
    for group in groups:
        m = group.feature.shape[1]
        if not m:
            continue
        size = max(1, _CELLS // (max(len(x), 1) * m))
        for at in range(0, len(group.value), size):
            part = slice(at, at + size)
            f = group.feature[part]
            v = x[:, f]
            inside = np.where(missing[:, f], group.gap[part], (v > group.low[part]) & (v <= group.high[part]))  # (row, leaf, i)
            if group.table is None:
                found = _shapley(inside.astype(float), group.share[part]) * group.value[part][:, None]
            else:
                pattern = (inside << np.arange(m)).sum(axis=2)
                found = group.table[part][np.arange(len(f)), pattern]
            for i in np.unique(f):
                phi[:, i] += found[:, f == i].sum(axis=1)
    return phi


#: Rows whose attributions a task keeps, for those that fall between the same cuts.
KEPT_ROWS = 1 << 18


class RangeCache:
    """Shapley values by the ranges between cuts that a row's values fall into: all rows in the same ranges follow the same
    paths, so a task works each combination out once, as long as it keeps no more than ``KEPT_ROWS`` of them."""

    def __init__(self, groups: Sequence[PathGroup], d: int):
        self.groups, self.known = groups, {}
        self.edges = []
        for i in range(d):
            ends = [e[g.feature == i] for g in groups for e in (g.low, g.high)]
            self.edges.append(np.unique(np.concatenate([np.zeros(0), *(e[np.isfinite(e)] for e in ends)])))

    def phi(self, x: np.ndarray) -> np.ndarray:
        at = np.empty(x.shape, np.int32)
        for i, edges in enumerate(self.edges):
            at[:, i] = np.where(np.isfinite(x[:, i]), np.searchsorted(edges, x[:, i], "left"), -1)
        if not at.size:
            return np.zeros(x.shape)
        ranges = at.view(np.dtype((np.void, at.itemsize * at.shape[1]))).ravel().tolist()
        first = {r: i for i, r in reversed(list(enumerate(ranges)))}
        fresh = [r for r in first if r not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > KEPT_ROWS:
                self.known, fresh = {}, list(first)
            self.known.update(zip(fresh, path_shapley(x[[first[r] for r in fresh]], self.groups)))
        return np.array([self.known[r] for r in ranges])


def tree_attribution(df: DataFrame, model, features: Sequence[str], key: str = "entity_id",
                     model_id: str = "tree") -> DataFrame:
    """Exact path-dependent Shapley values of a tree model (MLlib's or one with ``paths``) for every row of ``df``."""
    features = list(features)
    leaves = model.paths() if hasattr(model, "paths") else tree_paths(model, df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(flat_paths(leaves))  # the size of the model
    rows = df.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    schema = f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`{f}` double" for f in features)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = RangeCache(shared.value, len(features))
        for batch in batches:
            phi = kept.phi(batch[features].to_numpy())
            yield pd.DataFrame({key: batch[key].to_numpy(), **{f: phi[:, i] for i, f in enumerate(features)}})

    wide = rows.mapInPandas(explain, schema)
    return wide.unpivot([key], features, "feature", "phi").withColumn("model_id", F.lit(model_id))


# --- any model --------------------------------------------------------------------------

def background(df: DataFrame, features: Sequence[str], k: int = K.BACKGROUND_CENTRES,
               seed: int = K.SEED) -> list[tuple[float, dict[str, float]]]:
    """k-means summary of the rows: (share of rows, centre) per cluster. k rows reach the driver."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.select(*features))
    model = KMeans(k=k, seed=seed, featuresCol="_x").fit(vectors)
    sizes = {r["prediction"]: r["count"] for r in model.transform(vectors).groupBy("prediction").count().collect()}
    total = sum(sizes.values())
    return [
        (sizes.get(i, 0) / total, dict(zip(features, map(float, c)))) for i, c in enumerate(model.clusterCenters())
    ]


def sampled_attribution(df: DataFrame, score, features: Sequence[str],
                        centres: Sequence[tuple[float, dict[str, float]]], permutations: int = 8,
                        key: str = "entity_id", model_id: str = "model", seed: int = K.SEED) -> DataFrame:
    """Shapley values of any scorer by permutation sampling.

    Per row and permutation, features switch from a background centre to the row's value one
    after another; each switch's change of score goes to that feature. Every permutation is
    used with its reverse. Centres are drawn in proportion to their share; all draws are
    hashes. Rows x permutations x (features + 1) scores are computed, none is shuffled
    before its change is summed per (row, feature). A scorer with ``in_arrays`` (a function from
    an array of rows to scores) is asked in the task that holds the row; others score a table of all variants.
    """
    features = list(features)
    d = len(features)
    rng = np.random.default_rng(seed)
    half = [rng.permutation(d).tolist() for _ in range(max(1, permutations // 2))]
    orders = [o for p in half for o in (p, p[::-1])]
    edges = np.cumsum([share for share, _ in centres])
    rule = score.in_arrays() if hasattr(score, "in_arrays") else None
    if rule is not None:
        return _sampled_in_tasks(df, rule, features, centres, half, edges, key, model_id, seed)
    draws = F.array(*[F.struct(F.lit(i).alias("perm"), F.array(*map(F.lit, o)).alias("order")) for i, o in enumerate(orders)])
    u = hash_uniform(str(seed), "centre", F.col(key), (F.col("perm") / 2).cast("int"))
    pick = F.lit(len(centres) - 1)
    for i in range(len(centres) - 2, -1, -1):
        pick = F.when(u < float(edges[i]), i).otherwise(pick)
    centre = F.element_at(
        F.array(*[F.array(*[F.lit(float(c[f])) for f in features]) for _, c in centres]), F.col("_c") + 1)
    own = F.array(*[F.col(f).cast("double") for f in features])
    steps = (
        df.select(key, own.alias("_own"), F.explode(draws).alias("_d")).select(key, "_own", "_d.*")
        .withColumn("_c", pick).withColumn("_from", centre)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    )
    # after _step switches, feature i has its own value if it is among the first _step of the order
    mixed = [
        F.when(F.array_position("order", F.lit(i)) <= F.col("_step"), F.col("_own")[i]).otherwise(F.col("_from")[i]).alias(f)
        for i, f in enumerate(features)
    ]
    # a variant is a row of its own: scorers that join by the key must not mix those of one entity
    variant = F.concat_ws(":", F.col(key).cast("string"), "perm", "_step").alias(key)
    scored = score.score(steps.select(F.col(key).alias("_entity"), variant, "perm", "order", "_step", *mixed), "_p")
    names = F.array(*[F.lit(f) for f in features])
    gains = F.explode(F.array(
        F.struct(F.when(F.col("_step") > 0, F.col("order")[F.greatest(F.col("_step") - 1, F.lit(0))]).alias("f"), F.col("_p").alias("g")),
        F.struct(F.when(F.col("_step") < d, F.col("order")[F.least(F.col("_step"), F.lit(d - 1))]).alias("f"), (-F.col("_p")).alias("g")),
    ))
    changes = scored.select(F.col("_entity").alias(key), gains.alias("c")).select(key, "c.*").where(F.col("f").isNotNull())
    return changes.groupBy(key, F.element_at(names, F.col("f") + 1).alias("feature")).agg(
        (F.sum("g") / len(orders)).alias("phi")).withColumn("model_id", F.lit(model_id))


def _sampled_in_tasks(df: DataFrame, rule, features: Sequence[str], centres: Sequence[tuple[float, dict[str, float]]],
                      half: Sequence[Sequence[int]], edges: np.ndarray, key: str, model_id: str, seed: int) -> DataFrame:
    """The same draws and switches, each row's in the task that holds it; only its sums leave."""
    d, starts = len(features), np.array([[float(c[f]) for f in features] for _, c in centres])
    names = [f"_phi{i}" for i in range(d)]
    draws = [hash_uniform(str(seed), "centre", F.col(key), F.lit(i)).alias(f"_u{i}") for i in range(len(half))]
    rows = df.select(key, *(F.col(f).cast("double").alias(n) for f, n in zip(features, names)), *draws)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    shared = df.sparkSession.sparkContext.broadcast((rule, starts, edges, [list(o) for o in half]))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored, origins, ends, orders = shared.value
        at_start = scored(origins)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, u = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in part])
                      for part in (batch.columns[1:1 + d], batch.columns[1 + d:]))
            if np.isnan(own).any():
                raise ValueError(f"rows miss a value of {', '.join(features)}; impute them first")
            phi, whole = np.zeros(own.shape), scored(own)
            for i, order in enumerate(orders):
                centre = np.minimum(np.searchsorted(ends, u[:, i], "right"), len(ends) - 1)
                for way in (order, order[::-1]):
                    mixed, before = origins[centre], at_start[centre]
                    for step, f in enumerate(way):
                        mixed[:, f] = own[:, f]
                        after = scored(mixed) if step + 1 < d else whole
                        phi[:, f] += after - before
                        before = after
            phi /= 2 * len(orders)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, phi.T)], [key, *names])

    wide = rows.mapInArrow(explain, schema).groupBy(key).agg(*(F.sum(n).alias(f) for n, f in zip(names, features)))
    return wide.unpivot([key], features, "feature", "phi").withColumn("model_id", F.lit(model_id))
