"""Focal-loss baseline: stratified hold-out, median imputation, dense-low threshold sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import DENSE_LOW_GRID
from cohortlens.operators.focal import FocalSchedule, fit_focal
from cohortlens.operators.folds import holdout_split
from cohortlens.operators.metrics import auc, metric_record
from cohortlens.operators.preprocess import apply_standardiser, fit_standardiser
from cohortlens.operators.threshold import carry_threshold, threshold_sweep
from cohortlens.session import stage


def run_baseline(source: DataFrame, target: DataFrame, features: Sequence[str], label: str = "label",
                 key: str = "entity_id", objective: str = "gmean",
                 schedule: FocalSchedule = FocalSchedule()) -> DataFrame:
    """Metric record of the target cohort at the threshold chosen on the validation part.

    Source and target are different cohorts; the target takes part in nothing but scoring.
    """
    split = stage(holdout_split(source.select(key, label, *features), label=label, key=key))
    fitted = fit_standardiser(split.where("part = 'train'"), features, "median")
    scaled = apply_standardiser(split, fitted, features)
    kept = [f for f in features if f in scaled.columns]
    model, _ = fit_focal(scaled, kept, label, "part", schedule)
    name = F.lit("Focal_Logistic").alias("model_id")
    by = ["model_id"]
    seen = model.score(scaled.where("part = 'valid'")).select(label, "p", name)
    learned = threshold_sweep(seen, by, DENSE_LOW_GRID, objective, label=label)
    goal = model.score(apply_standardiser(target.select(key, label, *features), fitted, features)).select(label, "p", name)
    counts = carry_threshold(learned, goal, by, DENSE_LOW_GRID, label=label)
    return metric_record(counts, auc(goal, by, label=label), by, extra=["threshold"])
