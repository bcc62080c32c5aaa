"""Join a grouped table back to its rows without trusting that it is small, or that keys are even."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import stage

BROADCAST_ROWS = 100_000
HOT_SHARE = 1000
SALTS = 64


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], salt: Sequence[str],
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of ``rows`` with a table unique in ``keys``.

    The table is staged and counted: up to ``max_rows`` entries it is broadcast. Beyond that
    both sides are shuffled. Keys that hold more than a thousandth of all rows, of which there
    are fewer than a thousand, are spread by a hash of the ``salt`` columns and their table
    entries repeated; all other keys are joined as they are.
    """
    keys, table = list(keys), stage(table)
    if table.count() <= max_rows:
        return meet(rows, table, keys, small=True)
    return _salted(rows, table, keys, salt)


def meet(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal ``keys``, where NULL equals NULL; the keys stay once. ``small``: the table was counted."""
    named = table.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)),
                         *(c for c in table.columns if c not in keys))
    same = reduce(and_, (rows[k].eqNullSafe(named[f"_key{i}"]) for i, k in enumerate(keys)))
    joined = rows.join(F.broadcast(named) if small else named, same, how)
    return joined.drop(*(f"_key{i}" for i in range(len(keys))))


def _salted(rows: DataFrame, table: DataFrame, keys: list[str], salt: Sequence[str]) -> DataFrame:
    total = rows.count()
    crowded = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT_SHARE > total)
    found = crowded.collect()  # fewer than HOT_SHARE rows, by their definition
    if not found:
        return meet(rows, table, keys)
    hot = (rows.sparkSession.createDataFrame(found, crowded.schema).withColumnRenamed("_n", "_hot"))
    part = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = meet(rows, hot, keys, "left", small=True).withColumn("_salt", part).drop("_hot")
    repeated = meet(table, hot, keys, "left", small=True).withColumn("_salt", F.explode(copies)).drop("_hot")
    return meet(spread, repeated, [*keys, "_salt"]).drop("_salt")
