"""Class counts, weights, confusion counts, AUC and the metric record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.joins import attach
from cohortlens import constants as K
from cohortlens.functions.scalars import hard_decision, ratio, ratio_or_zero
from cohortlens.operators.preprocess import moments
from cohortlens.operators.ranking import range_cuts, with_bucket


def class_profile(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """Rows per class and group."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def imbalance(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """Positives, negatives, positive rate and negatives per positive."""
    return (
        df.groupBy(*by)
        .agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
        .withColumn("pos_rate", ratio_or_zero("n_pos", F.col("n_pos") + F.col("n_neg")))
        .withColumn("neg_per_pos", ratio("n_neg", "n_pos"))
    )


def balanced_weights(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                     out: str = "weight") -> DataFrame:
    """Add n / (2 n_class), within ``by`` where given. The joined table has one row per group and class."""
    keys = [*by, label]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    weights = counts.select(*keys, (F.sum("_n").over(group) / (2.0 * F.col("_n"))).alias(out))
    return attach(df, weights, keys, salt=df.columns)


def positive_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Add the imbalance ratio as weight of the positives, 1 for the negatives."""
    row = imbalance(df, [], label).first()
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(row["neg_per_pos"]))).otherwise(1.0))


def cohort_drift(df: DataFrame, features: Sequence[str], cohort: str = "cohort") -> DataFrame:
    """Standardised mean difference of each cohort's features from the pooled rows."""
    stats = moments(df, [cohort], features)
    group = Window.partitionBy("feature")  # one row per cohort
    total = F.sum("vals").over(group)
    pooled = stats.withColumn(
        "pooled_mean", F.sum(F.col("vals") * F.col("mean")).over(group) / total)
    gap = F.col("mean") - F.col("pooled_mean")
    spread = F.sqrt(F.sum(F.col("m2") + F.col("vals") * gap * gap).over(group) / total)
    return pooled.select(
        cohort, "feature", "mean", "pooled_mean", F.try_divide(gap, spread).alias("shift"))


def confusion(scores: DataFrame, by: Sequence[str], threshold: float | Column, score: str = "p",
              label: str = "label") -> DataFrame:
    """tp, fp, tn, fn per group in one pass."""
    decided = scores.withColumn("_d", hard_decision(score, threshold))
    hit = lambda y, d: F.count_if((F.col(label) == y) & (F.col("_d") == d))
    return decided.groupBy(*by).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))


def rates(counts: DataFrame, w_specificity: float = K.WEIGHT_SPECIFICITY,
          w_recall: float = K.WEIGHT_RECALL) -> DataFrame:
    """All scalars of the metric record from tp, fp, tn, fn. Unrounded."""
    eps = f"{K.EPS!r}D"
    basic = counts.selectExpr(
        "*", f"tp / (tp + fn + {eps}) AS recall", f"tn / (tn + fp + {eps}) AS specificity")
    return basic.selectExpr(
        "*",
        "sqrt(recall * specificity) AS gmean",
        f"{w_specificity!r}D * specificity + {w_recall!r}D * recall AS weighted_score",
        "(recall + specificity) / 2 AS balanced_acc",
        "coalesce(try_divide(tp + tn, tp + fp + tn + fn), 0D) AS acc",
        "coalesce(try_divide(tp, tp + fp), 0D) AS precision",
        "coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0D) AS f1",
        f"fp / (tn + fp + {eps}) AS fpr",
        f"fn / (tp + fn + {eps}) AS fnr",
    )


RATE_COLUMNS = (
    "recall", "specificity", "gmean", "weighted_score", "balanced_acc", "acc", "precision", "f1",
    "fpr", "fnr",
)


def rows_where(condition: Column, times: str | None = None) -> Column:
    """How many rows meet the condition; ``times`` names how often a row counts."""
    return F.count_if(condition) if times is None else F.sum(F.when(condition, F.col(times)).otherwise(F.lit(0)))


def auc(scores: DataFrame, by: Sequence[str], score: str = "p", label: str = "label",
        cuts: Sequence[float] | None = None, times: str | None = None) -> DataFrame:
    """Area under the ROC curve per group; 0.5 where one class is absent.

    Equal scores are counted together first; score ranges are ranked alone and their totals
    (a few hundred rows per group) give the negatives below. Nothing is sorted globally.
    """
    by = list(by)
    if cuts is None:
        cuts = range_cuts(scores, score)
    counted = scores.groupBy(*by, score).agg(
        rows_where(F.col(label) == 1, times).alias("pos"), rows_where(F.col(label) == 0, times).alias("neg"))
    cut = with_bucket(counted, score, cuts)
    inside = Window.partitionBy(*by, "_bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    ranges = local.groupBy(*by, "_bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)).alias("inner"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = ranges.withColumn("_before", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    summed = placed.groupBy(*by).agg(
        F.sum(F.col("inner") + F.col("pos") * F.col("_before")).alias("_area"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    area = F.try_divide(F.col("_area"), F.col("_p").cast("double") * F.col("_n"))
    return summed.select(*by, F.coalesce(area, F.lit(0.5)).alias("auc"))


def metric_record(counts: DataFrame, areas: DataFrame, by: Sequence[str], digits: int = 4,
                  extra: Sequence[str] = ()) -> DataFrame:
    """One rounded record per group: rates, AUC, counts and any extra columns (threshold)."""
    full = rates(counts).join(areas, list(by))
    return full.select(
        *by, *[F.round(c, digits).alias(c) for c in (*RATE_COLUMNS, "auc")], "tp", "fp", "tn", "fn", *extra)


def evaluate(scores: DataFrame, by: Sequence[str], threshold: float, score: str = "p",
             label: str = "label") -> DataFrame:
    """Metric record of every group at one threshold."""
    counts = confusion(scores, by, threshold, score, label).withColumn("threshold", F.lit(threshold))
    return metric_record(counts, auc(scores, by, score, label), by, extra=("threshold",))
