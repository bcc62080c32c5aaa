"""The trials table: parameters, objective value and threshold of every search trial.

It is the interface between search, fusion and explanation. Rows carry a stored ``rank``
because a Spark table has no row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalars import decode_param, matches_keyword, param_keys_only

TRIALS_SCHEMA = (
    "model_type string, trial_id int, params map<string,string>, value double, "
    "threshold double, status string, rank int"
)


def write_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("overwrite").partitionBy("model_type").parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIALS_SCHEMA).parquet(path)


def rank_trials(trials: DataFrame, by: Sequence[str] = ("model_type",), value: str = "value",
                tie: str = "trial_id", top: int | None = None) -> DataFrame:
    """0-based rank by objective value among the trials that finished; with ``top``, only the best.

    A search has a few hundred trials. A larger table should be ranked with ``top``, which
    Spark applies before the shuffle.
    """
    best_first = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(tie))
    position = valid_trials(trials, value).withColumn("rank", F.row_number().over(best_first))
    kept = position if top is None else position.where(F.col("rank") <= top)
    return kept.withColumn("rank", F.col("rank") - 1)


def valid_trials(trials: DataFrame, value: str = "value", above: float | None = None) -> DataFrame:
    """Trials with a value; fusion also asks for one above a floor. A failed trial has none."""
    kept = trials.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept if above is None else kept.where(F.col(value) > above)


def select_trials(trials: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """Rows by ordinal; ordinals out of range select nothing."""
    return trials.where(F.col("rank").isin(*ranks))


def select_by_keyword(trials: DataFrame, keyword: str, row: int = 0, name: str = "model_type",
                      order: Sequence[str] = ("rank",)) -> DataFrame:
    """The row-th (0-based) trial whose model name matches the keyword, ignoring case."""
    matching = trials.where(matches_keyword(name, keyword))
    # TakeOrdered keeps row + 1 rows per partition; only those reach the window
    first = matching.orderBy(*order).limit(row + 1)
    return (
        first.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
        .where(F.col("_n") == row + 1).drop("_n")
    )


def decode_params(trials: DataFrame, keys: Sequence[str], lenient: bool = False) -> DataFrame:
    """One row per (trial, parameter) with its typed value; undecodable parameters are left out."""
    cells = trials.select(*keys, F.explode(param_keys_only("params")).alias("param", "cell"))
    decoded = cells.withColumn("value", decode_param("param", "cell", lenient))
    return decoded.where(F.col("value").isNotNull()).select(*keys, "param", "value.*")
