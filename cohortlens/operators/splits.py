"""Where trees may cut a feature: between its values, or at about equal shares of the weight."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.histogram_trees import quantile_cuts
from cohortlens.session import stage, unstage

#: A feature with more values than this is cut at ``FINE`` quantiles; its values never reach the driver.
VALUES = 1 << 15
FINE = 4096


def value_weights(df: DataFrame, features: Sequence[str], weight: str | None = None) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The values of each feature in order and the weight of their rows; None for a feature with more than ``VALUES``.
    Weights are added up as multiples of a step, exactly. A missing value is an error."""
    own = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    cells = F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(features)))
    gap = F.exists(cells, lambda c: c["v"].isNull() | F.isnan(c["v"]))
    n, most, bad = df.agg(F.count(F.lit(1)), F.max(own), F.count_if(gap)).first()
    if bad:
        raise ValueError(f"{bad} rows miss a value of {', '.join(features)}; impute them first")
    if not n:
        raise ValueError("no training rows")
    step = 2.0 ** (math.ceil(math.log2(max(n * most, 1e-300))) - 51)
    long = df.select(own.alias("w"), F.explode(cells).alias("c")).select("w", "c.*")
    found = stage(long.groupBy("f", "v").agg(F.sum(F.rint(F.col("w") / step)).alias("w")))
    few = [r["f"] for r in found.groupBy("f").count().where(F.col("count") <= VALUES).collect()]
    out: list = [None] * len(features)
    for i in few:
        rows = found.where(F.col("f") == i).select("v", "w").toPandas().sort_values("v")
        out[i] = rows["v"].to_numpy(), rows["w"].to_numpy() * step
    unstage(found)
    return out


def between(values: np.ndarray) -> np.ndarray:
    """A cut between each value and the next."""
    return (values[:-1] + values[1:]) / 2.0


def equal_shares(weights: np.ndarray, n_splits: int) -> np.ndarray:
    """Places (after which value) of at most ``n_splits`` cuts: all, or those nearest to equal shares of the weight."""
    if len(weights) - 1 <= n_splits:
        return np.arange(len(weights) - 1)
    share = float(weights.sum()) / (n_splits + 1)
    places, passed, target = [], float(weights[0]), share
    for i, w in enumerate(weights[1:].tolist()):
        before, passed = passed, passed + w
        if abs(before - target) < abs(passed - target):
            places.append(i)
            target += share
    return np.array(places, int)


def value_cuts(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """A cut between any two values of each feature; ``FINE`` quantiles where there are too many."""
    found = value_weights(df, features)
    return [between(own[0]) if own else quantile_cuts(df, [f], FINE)[0] for f, own in zip(features, found)]


def share_cuts(df: DataFrame, features: Sequence[str], bins: int, weight: str | None = None) -> list[np.ndarray]:
    """At most ``bins`` - 1 cuts of each feature at about equal shares of the weight."""
    found = value_weights(df, features, weight)
    return [between(own[0])[equal_shares(own[1], bins - 1)] if own else quantile_cuts(df, [f], bins)[0] for f, own in zip(features, found)]
