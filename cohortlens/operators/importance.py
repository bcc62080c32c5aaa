"""Attribution tables to rankings: mean |phi|, contribution, ranks, propagation through fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import constants as K


def global_importance(phi: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Mean of absolute attributions per model and feature."""
    return phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def importance_table(importance: DataFrame, by: Sequence[str] = ("model_id",), top: int | None = None) -> DataFrame:
    """Rank (1-based, ties by name) and contribution in percent; one row per feature and model."""
    model = Window.partitionBy(*by)
    share = F.col("importance") / (F.sum("importance").over(model) + F.lit(K.EPS)) * 100
    ranked = importance.withColumns({
        "contribution_pct": share,
        "rank": F.row_number().over(model.orderBy(F.col("importance").desc(), "feature")),
    })
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def top_features(importance: DataFrame, n: int = K.SELECT_FEATURES) -> list[str]:
    """Names of the n most important features of one model, best first."""
    best = importance.orderBy(F.col("importance").desc(), "feature").limit(n)
    return [r["feature"] for r in best.select("feature").collect()]


def flatten_top(importance: DataFrame, by: Sequence[str] = ("model_id",), n: int = K.TOP_NATIVE) -> DataFrame:
    """One row per model with top1_feature, top1_contrib, ... top<n>_contrib."""
    table = importance_table(importance, by, n)
    wide = []
    for i in range(1, n + 1):
        here = F.col("rank") == i
        wide += [F.max(F.when(here, F.col("feature"))).alias(f"top{i}_feature"),
                 F.max(F.when(here, F.round("contribution_pct", 4))).alias(f"top{i}_contrib")]
    return table.groupBy(*by).agg(*wide)


def propagate_importance(meta: DataFrame, base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Importance of original features through a fusion model.

    ``meta``: (by, model_id, importance) of each base model in the fusion model; ``base``:
    (model_id, feature, importance). Both have models x features rows at most.
    """
    weight = meta.select(*by, "model_id", F.col("importance").alias("_w"))
    return (
        weight.join(base, "model_id").groupBy(*by, "feature")
        .agg(F.sum(F.col("_w") * F.col("importance")).alias("importance"))
    )
