"""Minority oversampling on interpolated neighbours, reproducible by hashes.

Nearest-neighbour search is ``knn_join``; how many synthetic rows a minority row gets, which
neighbour is used and how far the new point lies all follow from md5, so a re-run or a lost
task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.neighbors import knn_join
from cohortlens.operators.ranking import hash_rank, hash_uniform


def smote(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "entity_id",
          k: int = 5, seed: int = 42, bases: DataFrame | None = None) -> DataFrame:
    """Synthetic positives that bring the classes level: (key of the base row, copy, label, features).

    Each base row (all positives, or ``bases``) gets an equal share of the missing rows, the
    remainder going to the first in hash order. A new point lies at a + u (b - a), with b one
    of the k nearest positives of a; fewer than k + 1 positives raise a ValueError.
    Append to the training rows with ``with_synthetic``.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    positives = df.where(F.col(label) == 1).select(key, *[F.col(f).cast("double").alias(f) for f in features])
    missing = counts.get(0, 0) - counts.get(1, 0)
    if missing > 0 and counts.get(1, 0) <= k:
        raise ValueError(f"{counts.get(1, 0)} positives have no {k} neighbours each; k + 1 = {k + 1} are needed")
    if missing <= 0:
        return positives.select(key, F.lit(0).alias("copy"), F.lit(1).alias(label), *features).limit(0)
    base = positives if bases is None else positives.join(bases.select(key), key, "left_semi")
    ranked = hash_rank(base, [], key, seed, groups=1)
    share = F.floor(F.lit(missing) / F.col("group_rows"))
    copies = share + (F.col("rank") < F.lit(missing) - share * F.col("group_rows")).cast("long")
    spec = (
        ranked.withColumn("_copies", copies).where(F.col("_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))))
        .withColumn("rank", (F.floor(hash_uniform(str(seed), "pick", F.col(key), F.col("copy")) * k) + 1).cast("int"))
        .withColumn("_u", hash_uniform(str(seed), "step", F.col(key), F.col("copy")))
        .drop("_copies", "group_rows")
    )
    found = knn_join(base, positives, features, k, key, exclude=key, payload=features)
    others = found.select(key, "rank", *[F.col(f).alias(f"_to_{f}") for f in features])
    between = [(F.col(f) + F.col("_u") * (F.col(f"_to_{f}") - F.col(f))).alias(f) for f in features]
    return spec.join(others, [key, "rank"]).select(key, "copy", F.lit(1).alias(label), *between)


def danger_rows(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "entity_id",
                m: int = 10) -> DataFrame:
    """Positives on the border: at least half, but not all, of their m neighbours are negative."""
    positives = df.where(F.col(label) == 1)
    near = knn_join(positives, df, features, m, key, exclude=key, payload=[label])
    negatives = near.groupBy(key).agg(
        F.count_if(F.col(label) == 0).alias("n_neg"), F.count(F.lit(1)).alias("m"))
    return negatives.where((F.col("n_neg") * 2 >= F.col("m")) & (F.col("n_neg") < F.col("m")))


def borderline_smote(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "entity_id",
                     k: int = 5, m: int = 10, seed: int = 42) -> DataFrame:
    """SMOTE from the border rows only; their partners are any positives."""
    return smote(df, features, label, key, k, seed, bases=danger_rows(df, features, label, key, m))


def with_synthetic(train: DataFrame, synthetic: DataFrame, key: str = "entity_id") -> DataFrame:
    """Training rows plus synthetic ones (``copy`` NULL for real rows)."""
    real = train.withColumn("copy", F.lit(None).cast("int"))
    return real.unionByName(synthetic, allowMissingColumns=True)
