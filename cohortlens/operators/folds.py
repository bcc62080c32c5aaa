"""Reproducible splits and samples. Every choice hangs on md5(seed:key), never on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ranking import hash_order, hash_rank, order_positions


def cohort_index(cohort: str | Column, cohorts: Sequence) -> Column:
    """Position of a cohort in the configured list, also when some of them are absent."""
    col = F.col(cohort) if isinstance(cohort, str) else cohort
    return F.array_position(F.array(*[F.lit(c) for c in cohorts]), col).cast("int") - 1


def assign_folds(df: DataFrame, cohorts: Sequence, cohort: str = "cohort", label: str = "label",
                 key: str = "entity_id", parts: int = 2, seed: int = 42) -> DataFrame:
    """Split each cohort into label-stratified parts; fold = parts * cohort index + part.

    A cohort that is not listed gets no fold.
    """
    index = cohort_index(cohort, cohorts)
    # all cohorts that are not listed are one group, so that there are no more groups than the list says
    listed = df.withColumn("_listed", F.when(index >= 0, index))
    ranked = hash_rank(listed, ["_listed", label], key, seed, groups=3 * (len(cohorts) + 1))
    fold = F.when(F.col("_listed").isNotNull(), F.col("_listed") * parts + F.col("rank") % parts)
    return ranked.withColumn("fold", fold.cast("int")).drop("rank", "group_rows", "_listed")


def stratified_folds(df: DataFrame, k: int = 10, label: str = "label", key: str = "entity_id",
                     seed: int = 42) -> DataFrame:
    """Plain stratified k-fold: class counts of two folds differ by one at most."""
    ranked = hash_rank(df, [label], key, seed, groups=3)
    return ranked.withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank", "group_rows")


def time_series_folds(df: DataFrame, order: str, n: int = 10, key: str = "entity_id",
                      cuts: Sequence[float] | None = None) -> DataFrame:
    """Expanding split: fold i tests the i-th block and trains on everything before it.

    Blocks hold n_rows // (n + 1) rows; the remainder stays in the first, train-only block
    (fold -1).
    """
    placed = order_positions(df, order, key, cuts=cuts)
    size = F.floor(F.col("n_rows") / (n + 1))
    start = F.col("n_rows") - size * n
    fold = F.when(F.col("position") < start, -1).otherwise(F.floor((F.col("position") - start) / size))
    return placed.withColumn("fold", fold.cast("int")).drop("position", "n_rows")


def holdout_split(df: DataFrame, fraction: float = 0.2, label: str = "label", key: str = "entity_id",
                  seed: int = 42) -> DataFrame:
    """Stratified hold-out: ``part`` is 'valid' for the first fraction of each class in hash order."""
    ranked = hash_rank(df, [label], key, seed, groups=3)
    limit = F.floor(F.col("group_rows") * fraction + 0.5)
    part = F.when(F.col("rank") < limit, "valid").otherwise("train")
    return ranked.withColumn("part", part).drop("rank", "group_rows")


def sample_rows(df: DataFrame, n: int, key: str = "entity_id", seed: int = 42) -> DataFrame:
    """n rows without replacement: the first in hash order (a top-n, not a sort)."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def train_rows(df: DataFrame, fold: int, past_only: bool = False, parts: int = 2) -> DataFrame:
    """Rows to train on when ``fold`` validates: every other fold, or only earlier cohorts."""
    if past_only:
        return df.where(F.floor(F.col("fold") / parts) < fold // parts)
    return df.where(F.col("fold") != fold)


def valid_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)
