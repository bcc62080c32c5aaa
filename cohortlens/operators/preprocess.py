"""Impute and standardise, with statistics from the training part only.

One scan gives (rows, values, mean, M2) per fold, class and feature. That table has folds x
classes x features rows whatever the size of the data, so it is fetched, and the training
statistics of a fold follow as the merge of all other folds on centred values: ten folds cost
one scan, and no large sums of squares are subtracted.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ranking import exact_median

FULL = -999  # the "fold" that leaves nothing out: statistics of every source row


@dataclass(frozen=True)
class Moments:
    """Rows, non-missing values, their mean and their sum of squared deviations."""

    rows: int = 0
    vals: int = 0
    mean: float = 0.0
    m2: float = 0.0

    @property
    def variance(self) -> float:
        return self.m2 / self.vals if self.vals else 0.0

    @property
    def filled_std(self) -> float:
        """Population deviation of the column after its gaps were filled with the mean; 1 if constant."""
        std = (self.m2 / self.rows) ** 0.5 if self.rows else 0.0
        return std if std > 0 else 1.0


    def filled(self, value: float) -> Moments:
        """Moments after every gap was filled with one value."""
        gaps = self.rows - self.vals
        if not gaps:
            return self
        mean = (self.vals * self.mean + gaps * value) / self.rows
        m2 = self.m2 + self.vals * gaps / self.rows * (self.mean - value) ** 2
        return Moments(self.rows, self.rows, mean, m2)


def merge(parts: Iterable[Moments]) -> Moments:
    parts = [p for p in parts if p.rows]
    vals = sum(p.vals for p in parts)
    mean = sum(p.vals * p.mean for p in parts) / vals if vals else 0.0
    m2 = sum(p.m2 + p.vals * (p.mean - mean) ** 2 for p in parts)
    return Moments(sum(p.rows for p in parts), vals, mean, m2)


def long_form(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (row, feature). Keeps wide tables out of aggregates with hundreds of columns."""
    typed = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return typed.unpivot(list(keys), list(features), "feature", "value")


def moments(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """rows, vals, mean and m2 per (by, feature)."""
    return (
        long_form(df, by, features).groupBy(*by, "feature")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("value").alias("vals"),
            F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop("value") * F.count("value"), F.lit(0.0)).alias("m2"),
        )
    )


def trains(fold: int, left_out: int, past_only: bool = False, parts: int = 2) -> bool:
    """Whether rows of ``fold`` are training rows when ``left_out`` validates."""
    if left_out == FULL:
        return True
    return fold // parts < left_out // parts if past_only else fold != left_out


def fold_moments(df: DataFrame, features: Sequence[str], fold: str = "fold", label: str | None = None,
                 past_only: bool = False, parts: int = 2) -> dict[int, dict[tuple, Moments]]:
    """Training statistics per left-out fold: {fold: {(label, feature): Moments}}; FULL leaves out none.

    Without a label the inner key is (feature,).
    """
    by = [fold] + ([label] if label else [])
    own: dict[tuple, dict[int, Moments]] = defaultdict(dict)
    for r in moments(df.where(F.col(fold).isNotNull()), by, features).collect():
        key = (r[label], r["feature"]) if label else (r["feature"],)
        own[key][r[fold]] = Moments(r["rows"], r["vals"], r["mean"], r["m2"])
    folds = {f for found in own.values() for f in found} | {FULL}
    return {
        left_out: {
            key: merge(m for f, m in found.items() if trains(f, left_out, past_only, parts))
            for key, found in own.items()
        }
        for left_out in folds
    }


def join_per_fold(df: DataFrame, rows: list[tuple], schema: str, fold: str = "fold",
                  leaky: bool = False) -> DataFrame:
    """Attach fitted parameters by fold. ``rows`` start with the fold; rows without one use FULL.

    The right side holds one entry per fold (and candidate), never per data row.
    """
    table = df.sparkSession.createDataFrame(rows, f"_left_out int, {schema}")
    use = F.lit(FULL) if leaky else F.coalesce(F.col(fold), F.lit(FULL))
    return df.withColumn("_use", use).join(F.broadcast(table), F.col("_use") == F.col("_left_out")).drop("_use", "_left_out")


def fold_standardise(df: DataFrame, features: Sequence[str], fold: str = "fold",
                     leaky: bool = False) -> DataFrame:
    """Mean-impute and z-score each row with the statistics of the other folds.

    Rows with NULL fold (the target cohort) use all source rows; ``leaky`` does so for every
    row. The scale is the population deviation of the filled column; a constant column is
    only centred. Features without any training value are dropped.
    """
    fitted = fold_moments(df, features, fold)
    kept = [f for f in features if fitted[FULL][(f,)].vals]
    rows = [(k, [(m[(f,)].mean, m[(f,)].filled_std) for f in kept]) for k, m in fitted.items()]
    joined = join_per_fold(df, rows, "_scale array<struct<mean:double,std:double>>", fold, leaky)
    dropped = [f for f in features if f not in kept]
    return joined.withColumns({f: _zscore(f, F.col("_scale")[i]) for i, f in enumerate(kept)}).drop("_scale", *dropped)


def _zscore(feature: str, scale: Column) -> Column:
    return (F.coalesce(F.col(feature).cast("double"), scale["mean"]) - scale["mean"]) / scale["std"]


def scale_by(df: DataFrame, stats: dict[tuple, Moments], features: Sequence[str]) -> DataFrame:
    """Mean-impute and z-score every row with one set of training statistics, put in as literals."""
    kept = [f for f in features if stats[(f,)].vals]
    scaled = {
        f: (F.coalesce(F.col(f).cast("double"), F.lit(stats[(f,)].mean)) - F.lit(stats[(f,)].mean))
        / F.lit(stats[(f,)].filled_std)
        for f in kept
    }
    return df.withColumns(scaled).drop(*[f for f in features if f not in kept])


def fit_standardiser(df: DataFrame, features: Sequence[str], strategy: str = "mean") -> DataFrame:
    """Per feature: fill value (mean or exact median), then mean and deviation after filling."""
    stats = moments(df, [], features)
    if strategy == "mean":
        fill = stats.withColumn("fill", F.col("mean"))
    elif strategy == "median":
        fill = stats.join(exact_median(long_form(df, [], features), ["feature"], "value", "fill"), "feature")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    # filling adds (rows - vals) copies of one value: merge that block into the moments
    missing = F.col("rows") - F.col("vals")
    gap = F.col("fill") - F.col("mean")
    m2 = F.col("m2") + F.col("vals") * missing / F.col("rows") * gap * gap
    std = F.sqrt(m2 / F.col("rows"))
    return fill.where(F.col("vals") > 0).select(
        "feature", "fill",
        ((F.col("vals") * F.col("mean") + missing * F.col("fill")) / F.col("rows")).alias("centre"),
        F.when(std > 0, std).otherwise(1.0).alias("scale"),
    )


def apply_standardiser(df: DataFrame, fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill and z-score with fitted statistics, one row per feature, put in as literals.

    Features without any training value have no statistics and are dropped.
    """
    rows = {r["feature"]: r for r in fitted.collect()}
    scaled = {
        f: (F.coalesce(F.col(f).cast("double"), F.lit(rows[f]["fill"])) - F.lit(rows[f]["centre"]))
        / F.lit(rows[f]["scale"])
        for f in features if f in rows
    }
    return df.withColumns(scaled).drop(*[f for f in features if f not in rows])
