"""Connected components by alternating star operations; no list of neighbours is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` (smallest id of the component) for every id in ``edges`` (``a``, ``b``).

    Each round points the larger neighbours of every id at its smallest one, then the smaller ones; the
    rounds end when the edges are stars. Edges with equal or NULL ends join nothing.
    """
    kind = edges.schema["a"].dataType
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a <> b").distinct())
    while not _stars(now):
        both = now.select(F.expr("inline(array(struct(a AS u, b AS v), struct(b AS u, a AS v)))"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        ends = F.when(F.col("b") == F.col("m"), F.array("a")).otherwise(F.array("a", "b"))
        now = stage(small.select(F.explode(ends).alias("a"), F.col("m").alias("b")).distinct())
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").cast(kind).alias("id"), F.col("b").alias("root")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` and no ``b`` is an ``a``. As ``a > b``, each ``b`` is then a root."""
    ends = edges.select(F.expr("inline(array(struct(a AS id, 1 AS up, 0 AS down), struct(b AS id, 0 AS up, 1 AS down)))"))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()
