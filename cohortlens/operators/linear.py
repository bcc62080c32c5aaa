"""Linear learners in closed form: discriminant analysis and calibrated ridge.

The training data is read once into cross products (X'WX per group, X with a leading 1): each
task adds its rows up in numpy and emits half of one symmetric matrix per group; these are added
up in two levels, first by groups of tasks, then by group. What reaches the driver is groups x
(d + 1)^2 / 2 numbers, where the d x d system is solved. Scores are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import add_all
from cohortlens.functions.scalars import sigmoid
from cohortlens.operators.preprocess import FULL
from cohortlens.operators.ranking import hash_rank
from cohortlens.session import stage


def cross_products(df: DataFrame, columns: Sequence[str], by: str, weight: str | None = None) -> dict[int, np.ndarray]:
    """{group: X'WX} with X = (1, columns)."""
    n = len(columns) + 1
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(by).cast("int").alias("g"), w.alias("w"), *[F.col(c).cast("double") for c in columns])

    half = np.triu_indices(n)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, part in batch.groupby("g"):
                x = np.column_stack([np.ones(len(part)), part[list(columns)].to_numpy()])
                sums[g] = sums.get(g, 0.0) + (x * part["w"].to_numpy()[:, None]).T @ x
        if sums:
            yield pd.DataFrame({"g": list(sums), "m": [s[half] for s in sums.values()]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, m in zip(batch["g"], batch["m"]):
                sums[g] = sums.get(g, 0.0) + np.asarray(m)
        if sums:
            yield pd.DataFrame({"g": list(sums), "m": list(sums.values())})

    # one matrix per input partition and group, added up in two levels
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "g int, m array<double>"
    some = rows.mapInPandas(partial, schema).repartition(tasks).mapInPandas(total, schema)
    out: dict[int, np.ndarray] = {}
    for r in some.repartition("g").mapInPandas(total, schema).collect():
        whole = out[r["g"]] = np.zeros((n, n))
        whole[half] = r["m"]
        whole.T[half] = r["m"]
    return out


@dataclass(frozen=True)
class LinearScore:
    """intercept + sum of coefficient x feature."""

    coefficients: dict[str, float]
    intercept: float

    def margin(self) -> Column:
        return F.lit(float(self.intercept)) + add_all(
            [F.lit(float(c)) * F.col(f) for f, c in self.coefficients.items()])

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, sigmoid(self.margin()))

    def importances(self) -> dict[str, float]:
        return {f: abs(c) for f, c in self.coefficients.items()}


def fit_discriminant(df: DataFrame, features: Sequence[str], label: str = "label") -> LinearScore:
    """Linear discriminant analysis: class means, pooled covariance (n - 2), class shares as priors."""
    return _discriminant(cross_products(df, features, label), features)


def fit_discriminants(df: DataFrame, features: Sequence[str], fold: str = "fold",
                      label: str = "label") -> dict[int, LinearScore]:
    """One discriminant per left-out fold (and FULL) from one pass: cross products add up.

    The analysis does not depend on the scale of the features, so statistics of one common
    scale serve every fold. Features should be roughly centred, for precision.
    """
    source = df.where(F.col(fold).isNotNull())
    group = F.when(F.col(fold) < 0, 0).otherwise(F.col(fold) + 1) * 2 + F.col(label)
    own = cross_products(source.withColumn("_group", group), features, "_group")
    whole = {y: sum(m for g, m in own.items() if g % 2 == y) for y in (0, 1)}
    folds = {g // 2 - 1 for g in own if g >= 2}
    models = {FULL: _discriminant(whole, features)}
    for f in folds:
        rest = {y: whole[y] - own.get(2 * (f + 1) + y, 0.0) for y in (0, 1)}
        models[f] = _discriminant(rest, features)
    return models


def _discriminant(sums: dict[int, np.ndarray], features: Sequence[str]) -> LinearScore:
    n = {y: sums[y][0, 0] for y in (0, 1)}
    mean = {y: sums[y][0, 1:] / n[y] for y in (0, 1)}
    within = sum(sums[y][1:, 1:] - n[y] * np.outer(mean[y], mean[y]) for y in (0, 1))
    pooled = within / (n[0] + n[1] - 2)
    direction = np.linalg.lstsq(pooled, mean[1] - mean[0], rcond=None)[0]
    offset = -0.5 * (mean[1] + mean[0]) @ direction + np.log(n[1] / n[0])
    return LinearScore(dict(zip(features, map(float, direction))), float(offset))


def solve_ridge(cross: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge with a free intercept from X'WX of (1, features..., target)."""
    total, mean = cross[0, 0], cross[0, 1:] / cross[0, 0]
    centred = cross[1:, 1:] - total * np.outer(mean, mean)
    gram, target = centred[:-1, :-1], centred[:-1, -1]
    w = np.linalg.lstsq(gram + alpha * np.eye(len(gram)), target, rcond=None)[0]
    return w, float(mean[-1] - mean[:-1] @ w)


@dataclass(frozen=True)
class CalibratedScore:
    """Mean of sigmoids over linear margins, one per inner fold."""

    parts: tuple[tuple[LinearScore, float, float], ...]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        curves = [sigmoid(F.lit(a) * s.margin() + F.lit(b)) for s, a, b in self.parts]
        return df.withColumn(out, add_all(curves) / len(curves))

    def importances(self) -> dict[str, float]:
        return self.parts[0][0].importances()

    def linear(self) -> LinearScore:
        return self.parts[0][0]


def fit_calibrated_ridge(df: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
                         weight: str | None = None, key: str = "entity_id", inner: int = 3,
                         seed: int = 42) -> CalibratedScore:
    """Ridge on targets -1/+1, calibrated by a sigmoid on held-out inner folds, then averaged."""
    kept = [key, label, *features] + ([weight] if weight else [])
    folded = hash_rank(df.select(*kept), [label], key, seed, groups=3)
    rows = stage(folded.select(
        label, *features, *([weight] if weight else []), (F.col("rank") % inner).cast("int").alias("_inner"),
        F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("_y")))
    sums = cross_products(rows, [*features, "_y"], "_inner", weight)
    linear = []
    for i in range(inner):
        w, b = solve_ridge(sum(m for g, m in sums.items() if g != i), alpha)
        linear.append(LinearScore(dict(zip(features, map(float, w))), b))
    margin = linear[0].margin()
    for i in range(1, inner):
        margin = F.when(F.col("_inner") == i, linear[i].margin()).otherwise(margin)
    curves = fit_sigmoids(rows.select("_inner", F.col(label).alias("_label"), margin.alias("_m")), inner)
    return CalibratedScore(tuple((s, a, b) for s, (a, b) in zip(linear, curves)))


def fit_sigmoids(held_out: DataFrame, groups: int, steps: int = 30) -> list[tuple[float, float]]:
    """Platt's sigmoid(a m + b) for every inner fold at once: a Newton step is one aggregate.

    Targets are smoothed by the class counts, which keeps the curve finite on separable margins.
    """
    counts = held_out.groupBy("_inner").agg(
        F.count_if(F.col("_label") == 1).alias("pos"), F.count_if(F.col("_label") == 0).alias("neg")).collect()
    pos, neg = ({r["_inner"]: r[c] for r in counts} for c in ("pos", "neg"))
    theta = np.array([[0.0, np.log((pos[g] + 1.0) / (neg[g] + 1.0))] for g in range(groups)])

    def per_group(values) -> Column:
        pairs = ",".join(f"{g},{float(v)!r}D" for g, v in enumerate(values))
        return F.expr(f"map({pairs})[_inner]")

    high = per_group([(pos[g] + 1) / (pos[g] + 2) for g in range(groups)])
    low = per_group([1 / (neg[g] + 2) for g in range(groups)])
    rows = held_out.select("_inner", "_m", F.when(F.col("_label") == 1, high).otherwise(low).alias("_t"))
    for _ in range(steps):
        p = sigmoid(per_group(theta[:, 0]) * F.col("_m") + per_group(theta[:, 1]))
        at = rows.withColumn("_p", p).withColumn("_v", F.col("_p") * (1 - F.col("_p")))
        gap = F.col("_p") - F.col("_t")
        sums = at.groupBy("_inner").agg(
            F.sum(gap * F.col("_m")).alias("ga"), F.sum(gap).alias("gb"),
            F.sum(F.col("_v") * F.col("_m") * F.col("_m")).alias("haa"),
            F.sum(F.col("_v") * F.col("_m")).alias("hab"), F.sum("_v").alias("hbb")).collect()
        moved = 0.0
        for r in sums:
            hessian = np.array([[r["haa"], r["hab"]], [r["hab"], r["hbb"]]]) + 1e-12 * np.eye(2)
            step = np.linalg.solve(hessian, np.array([r["ga"], r["gb"]]))
            step *= min(1.0, 10.0 / (np.abs(step).max() + 1e-12))  # far from the optimum, go slowly
            theta[r["_inner"]] -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return [(float(a), float(b)) for a, b in theta]
