"""Discrete AdaBoost over decision stumps.

Rows are written once as places among the cuts of each feature (``histogram_trees``' blocks; equal rows are one that counts
several times where that makes them fewer). A round is one pass over the blocks: a row's weight follows from the stumps
so far, and the weight of each class per feature and place is all that leaves a task. The stump and its error follow from
these sums: a feature is cut at up to ``BINS`` - 1 places of about equal weight, and the cut of the largest decrease of
Gini impurity wins. Weights are rounded to multiples of a step so small that sums are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import sigmoid
from cohortlens.operators.histogram_trees import DIRECT_CELLS, Growth, _bin_rows, _kept
from cohortlens.operators.splits import equal_shares, value_cuts
from cohortlens.session import unstage

#: Places at which a stump may cut, plus one.
BINS = 32


@dataclass(frozen=True)
class Stump:
    """Class ``left`` for values up to ``cut``, else ``right``; no feature: one class for all."""

    feature: int | None
    cut: float
    place: int
    left: float
    right: float


@dataclass(frozen=True)
class BoostedStumps:
    stumps: tuple[Stump, ...]
    alphas: tuple[float, ...]
    features: tuple[str, ...]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Sigmoid of the weighted vote; the votes add up stump by stump."""
        vote = F.lit(0.0)
        for s, alpha in zip(self.stumps, self.alphas):
            left, right = F.lit(alpha * (2 * s.left - 1)), F.lit(alpha * (2 * s.right - 1))
            vote = vote + (left if s.feature is None else F.when(F.col(f"`{self.features[s.feature]}`") <= s.cut, left).otherwise(right))
        return df.withColumn(out, sigmoid(vote / sum(self.alphas)))

    def importances(self) -> dict[str, float]:
        total = sum(self.alphas)
        return {f: sum(a for s, a in zip(self.stumps, self.alphas) if s.feature == i and s.left != s.right) / total
                for i, f in enumerate(self.features)}


def _gini(negative: np.ndarray, positive: np.ndarray) -> np.ndarray:
    total = negative + positive
    safe = np.where(total > 0, total, 1.0)
    return np.where(total > 0, 1.0 - (negative / safe) ** 2 - (positive / safe) ** 2, 0.0)


def best_stump(sums: np.ndarray, cuts: Sequence[np.ndarray], bins: int = BINS) -> tuple[Stump, float, float]:
    """The stump of these weights by (class, feature, place), the weight it gets wrong and all weight."""
    whole = sums[:, 0].sum(axis=-1)
    everything = float(whole.sum())
    best, gain = None, 0.0
    for f, own in enumerate(cuts):
        negative, positive = sums[0, f, :len(own) + 1], sums[1, f, :len(own) + 1]
        filled = np.flatnonzero(negative + positive)  # a place without weight is no value
        if len(filled) < 2:
            continue
        places = filled[equal_shares((negative + positive)[filled], bins - 1)]
        n, p = np.cumsum(negative)[places], np.cumsum(positive)[places]
        share = (n + p) / everything
        gains = float(_gini(*whole)) - share * _gini(n, p) - (1 - share) * _gini(whole[0] - n, whole[1] - p)
        at = int(np.argmax(gains))
        if gains[at] > gain:
            best, gain = (f, int(places[at]), n[at], p[at]), float(gains[at])
    if best is None:
        major = float(whole[1] > whole[0])
        return Stump(None, math.inf, 0, major, major), float(whole.min()), everything
    f, place, n, p = best
    left, right = float(p > n), float(whole[1] - p > whole[0] - n)
    bad = (n if left else p) + (whole[0] - n if right else whole[1] - p)
    return Stump(f, float(cuts[f][place]), place, left, right), float(bad), everything


def fit_adaboost(df: DataFrame, features: Sequence[str], label: str = "label", n_estimators: int = 50,
                 learning_rate: float = 1.0, weight: str | None = None, seed: int = 42) -> BoostedStumps:
    """Each round fits a stump, measures its weighted error and raises the weight of its misses."""
    features = list(features)
    cuts = value_cuts(df, features)
    least, most = df.agg(F.min(label), F.max(label)).first()
    if least == most:
        return BoostedStumps((Stump(None, math.inf, 0, float(most), float(most)),), (learning_rate * math.log(1 / 1e-12),), tuple(features))
    rows = _bin_rows(df, features, label, features[0], weight, cuts, Growth(base_score=0.5, seed=seed))
    rows.blocks = _kept(rows.table)
    stumps, alphas, changes = [], [], []
    step, total = rows.step, 0.0
    for _ in range(n_estimators):
        stump, bad, total = best_stump(_weights(rows, changes, step), cuts)
        error = bad / total
        if error >= 0.5:  # no better than chance on the reweighted rows
            break
        alpha = learning_rate * math.log((1 - error) / max(error, 1e-12))
        stumps.append(stump)
        alphas.append(alpha)
        if error <= 0:
            break
        up = math.exp(alpha)
        changes.append((stump.feature or 0, stump.place if stump.feature is not None else rows.missing, stump.left, stump.right, up / total, 1 / total))
        step = 2.0 ** (math.ceil(math.log2(1 + error * up)) - 51)  # weights add up to (1 - error) + error * up
    rows.blocks.unpersist()
    unstage(rows.table)
    if not stumps:
        raise ValueError("no stump is better than chance; balance the class weights")
    return BoostedStumps(tuple(stumps), tuple(alphas), tuple(features))


def _weights(rows, changes: Sequence[tuple], step: float) -> np.ndarray:
    """Weight by (class, feature, place) after the given changes, in one pass."""
    blocks, d, bins = rows.blocks, len(rows.cuts), rows.missing + 1
    arrays, changes = _Reader(rows), list(changes)

    def run(parts):
        total = np.zeros((2, d, bins))
        for block in parts:
            x, y, w, times = arrays(block)
            columns, true = [np.ascontiguousarray(x[:, f]) for f in range(d)], y > 0.5
            w = w.copy()
            for f, place, left, right, up, keep in changes:
                w *= np.where(np.where(columns[f] <= place, left > 0.5, right > 0.5) != true, up, keep)
            often = np.rint(w / step) * times
            for f in range(d):
                total[:, f] += np.bincount(columns[f] + bins * true.astype(np.int64), often, 2 * bins).reshape(2, bins)
        return [total]

    parts = blocks.mapPartitions(run)
    found = parts.treeReduce(np.add) if blocks.getNumPartitions() * 2 * d * bins > DIRECT_CELLS else sum(parts.collect())
    return found * step


class _Reader:
    """What a task needs to read a block."""

    def __init__(self, rows):
        self.kind, self.d = rows.kind, len(rows.cuts)

    def __call__(self, block) -> tuple[np.ndarray, ...]:
        return (np.frombuffer(block[0], self.kind).reshape(-1, self.d), np.frombuffer(block[1]), np.frombuffer(block[2]),
                np.frombuffer(block[5], np.int64))
