"""Threshold selection on pooled scores.

Each score is reduced to k, the number of grid points strictly below it, and counted per
(group, k): at most len(grid) + 1 rows per group leave the map side, whatever the number of
scores. The row is predicted positive at threshold i exactly when k > i, so suffix sums over k
are the confusion counts of every threshold, for all models and trials in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.scalars import BASE_GRID, double_array
from cohortlens.operators.metrics import auc, rates, rows_where

SCORE_OF = {"acc": "acc", "f1": "f1", "pre": "weighted_score", "gmean": "gmean", "auc": "auc"}


def score_histogram(scores: DataFrame, by: Sequence[str], grid: Sequence[float], score: str = "p",
                    label: str = "label", times: str | None = None) -> DataFrame:
    """Positives and negatives per (group, k). NaN and NULL scores are an error, not a class. ``times``: how often a row counts."""
    # the Bucketizer is left-closed; on -p with negated cuts a score on a grid point stays below it
    splits = [float("-inf"), *[-g for g in reversed(grid)], float("inf")]
    checked = F.when(F.col(score).isNull() | F.isnan(score), F.raise_error(F.lit("score is missing")).cast("double"))
    negated = scores.withColumn("_neg", checked.otherwise(-F.col(score)))
    bucketed = Bucketizer(splits=splits, inputCol="_neg", outputCol="_b").transform(negated)
    k = (F.lit(len(grid)) - F.col("_b")).cast("int")
    return bucketed.groupBy(*by, k.alias("k")).agg(
        rows_where(F.col(label) == 1, times).alias("pos"), rows_where(F.col(label) == 0, times).alias("neg"))


def threshold_curve(histogram: DataFrame, by: Sequence[str], n: int, dense: bool = True) -> DataFrame:
    """Confusion counts per (group, i). Sparse form: only the lowest i of each run of equal counts."""
    keys = "".join(f"`{c}`, " for c in by)
    group = f"PARTITION BY {keys[:-2]}" if by else "PARTITION BY 1"  # at most n + 1 rows
    after = f"OVER ({group} ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    runs = histogram.selectExpr(
        *by, "k",
        f"coalesce(sum(pos) {after}, 0L) AS tp_k", f"coalesce(sum(neg) {after}, 0L) AS fp_k",
        f"sum(pos) OVER ({group}) AS p_all", f"sum(neg) OVER ({group}) AS n_all",
        f"lead(k, 1, {n}) OVER ({group} ORDER BY k) AS k_next",
        f"row_number() OVER ({group} ORDER BY k) AS k_row",
    )
    # thresholds k .. k_next - 1 share counts; below the lowest score everything is positive
    own = "named_struct('a', k, 'b', k_next, 'tp', tp_k, 'fp', fp_k)"
    head = "named_struct('a', 0, 'b', k, 'tp', p_all, 'fp', n_all)"
    spread = runs.selectExpr(
        *by, "p_all", "n_all",
        f"inline(if(k_row = 1, array({head}, {own}), array({own}))) AS (a, b, tp, fp)").where("a < b")
    index = "explode(sequence(a, b - 1))" if dense else "a"
    return spread.selectExpr(
        *by, f"{index} AS i", "tp", "fp", "n_all - fp AS tn", "p_all - tp AS fn")


def threshold_sweep(
    scores: DataFrame, by: Sequence[str], grid: Sequence[float] = BASE_GRID, objective: str = "gmean",
    min_recall: float | None = None, score: str = "p", label: str = "label",
    w_specificity: float = K.WEIGHT_SPECIFICITY, w_recall: float = K.WEIGHT_RECALL, times: str | None = None,
) -> DataFrame:
    """Best threshold per group: (by, i, threshold, tp, fp, tn, fn, recall, specificity, score).

    Without ``min_recall``: highest score, lowest threshold among equals; under 'pre',
    thresholds that predict one class only are skipped while both classes exist.
    With ``min_recall``: highest score among thresholds that reach it, else highest recall.
    'auc' does not choose: it evaluates at 0.5 and scores by AUC. ``i`` is NULL where the
    threshold is not a grid point.
    """
    by = list(by)
    if objective not in SCORE_OF:
        raise ValueError(f"unknown objective {objective!r}")
    if objective == "auc":
        grid = []
    points = sorted({*grid, K.FALLBACK_THRESHOLD})
    extra = points.index(K.FALLBACK_THRESHOLD) if K.FALLBACK_THRESHOLD not in grid else -1
    curve = threshold_curve(score_histogram(scores, by, points, score, label, times), by, len(points))
    rated = rates(curve, w_specificity, w_recall)
    if objective == "auc":
        rated = rated.join(auc(scores, by, score, label, times=times), by) if by else _attach_auc(rated, scores, score, label, times)
    rated = rated.withColumn("score", F.col(SCORE_OF[objective]))
    usable = f"i <> {extra}"
    if objective == "pre" and min_recall is None:
        usable += " AND (tp + fp > 0 AND tn + fn > 0 OR tp + fn = 0 OR tn + fp = 0)"
    if min_recall is None or objective == "auc":
        tier, rank = f"if({usable}, 0, 1)", f"if({usable}, -score, abs(i - {extra}))"
    else:
        tier = f"CASE WHEN {usable} AND recall >= {min_recall!r}D THEN 0 WHEN {usable} THEN 1 ELSE 2 END"
        rank = f"if({usable} AND recall >= {min_recall!r}D, -score, -recall)"
    row = "named_struct('i', i, 'tp', tp, 'fp', fp, 'tn', tn, 'fn', fn, 'recall', recall, " \
          "'specificity', specificity, 'score', score)"
    best = rated.groupBy(*by).agg(
        F.expr(f"min_by({row}, struct({tier} AS tier, {rank} AS rank, i)) AS best")).selectExpr(*by, "best.*")
    off_grid = extra >= 0
    grid_index = f"if(i = {extra}, NULL, i - if(i > {extra}, 1, 0))" if off_grid else "i"
    return best.withColumn("threshold", F.element_at(double_array(points), F.col("i") + 1)).withColumn(
        "i", F.expr(f"CAST({grid_index} AS INT)"))


def _attach_auc(rated: DataFrame, scores: DataFrame, score: str, label: str, times: str | None = None) -> DataFrame:
    area = auc(scores, [], score, label, times=times).first()["auc"]
    return rated.withColumn("auc", F.lit(float(area)))


def penalised(sweep: DataFrame, lam: float = K.PENALTY_BASE, min_recall: float = K.MIN_RECALL,
              out: str = "value") -> DataFrame:
    """Objective of a trial: score minus lam times the recall missing to the floor."""
    return sweep.withColumn(
        out, F.col("score") - F.lit(lam) * F.greatest(F.lit(0.0), F.lit(min_recall) - F.col("recall")))


def carry_threshold(learned: DataFrame, scores: DataFrame, by: Sequence[str],
                    grid: Sequence[float] = BASE_GRID, score: str = "p", label: str = "label",
                    times: str | None = None) -> DataFrame:
    """Confusion counts of new scores at thresholds learned elsewhere, one threshold per group.

    Both sides of the join are curves (a few hundred rows per group); the scores themselves
    are only counted.
    """
    by = list(by)
    points = sorted({*grid, K.FALLBACK_THRESHOLD})
    curve = threshold_curve(score_histogram(scores, by, points, score, label, times), by, len(points))
    values = F.element_at(double_array(points), F.col("i") + 1)
    wanted = learned.select(*by, "threshold")
    return curve.withColumn("threshold", values).drop("i").join(wanted, [*by, "threshold"])
