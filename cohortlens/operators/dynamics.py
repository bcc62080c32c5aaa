"""Behavioural dynamics: activity series, acceleration, procrastination ranks, imputation.

The concepts are published in words only; the formulas here are this library's reading:

* acceleration: second difference x_k - 2 x_{k-1} + x_{k-2} of an entity's activity per period;
* procrastination (rank form): mean percent rank of completion time within (cohort, task);
* procrastination (robust form): mean of (delay - median) / (1.4826 MAD) within (cohort, task);
* penalty imputation: a missing completion time becomes the task's largest delay x a factor;
* motivation: expectancy x value / (1 + impulsiveness x delay).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.joins import attach
from cohortlens.operators.ranking import exact_median, range_cuts, ranks_within
from cohortlens.session import stage

MAD_SCALE = 1.4826


def period_of(time: str | Column, start: str, days: int) -> Column:
    """Index of the period of ``days`` days that a timestamp falls in, from the start date."""
    time = F.col(time) if isinstance(time, str) else time
    return F.floor(F.datediff(time.cast("date"), F.lit(start).cast("date")) / days).cast("int")


def window_of(events: DataFrame, time: str, days: int) -> tuple[str, int]:
    """First date of the events and the number of periods of ``days`` days up to the last; no events, no periods."""
    day = F.col(time).cast("date")
    first, periods = events.agg(F.min(day).cast("string"), F.floor(F.datediff(F.max(day), F.min(day)) / days) + 1).first()
    return first or "1970-01-01", int(periods or 0)


def activity_grid(events: DataFrame, entity: str, period: Column, periods: int,
                  value: str | None = None) -> DataFrame:
    """Events (and their summed value) per entity and period 0..periods-1, zero where there are none.

    Events are counted per (entity, period) first, so a very active entity is combined before
    the shuffle; the dense grid is then unfolded in place, without a join.
    """
    measures = [F.count(F.lit(1)).alias("x")] + ([F.sum(value).alias("total")] if value else [])
    steps = F.sequence(F.lit(0), F.lit(max(periods, 1) - 1))
    counted = (
        events.withColumn("period", period).where(F.col("period").between(0, periods - 1))
        .groupBy(entity, "period").agg(*measures)
    )
    names = ["x", "total"] if value else ["x"]
    series = counted.groupBy(entity).agg(
        F.map_from_entries(F.collect_list(F.struct("period", F.struct(*names)))).alias("_s"))
    grid = series.select(entity, "_s", F.explode(steps).alias("period"))
    cell = F.try_element_at("_s", F.col("period"))
    zero = {"x": F.lit(0).cast("long"), "total": F.lit(0.0)}
    return grid.select(entity, "period", *[F.coalesce(cell[n], zero[n]).alias(n) for n in names])


def acceleration(grid: DataFrame, entity: str, period: str = "period", value: str = "x") -> DataFrame:
    """Add first and second differences; NULL where an entity's series is too short."""
    w = Window.partitionBy(entity).orderBy(period)
    back = lambda n: F.lag(value, n).over(w)
    return grid.withColumns({
        "velocity": F.col(value) - back(1),
        "acceleration": F.col(value) - 2 * back(1) + back(2),
    })


def acceleration_features(series: DataFrame, entity: str, period: str = "period") -> DataFrame:
    """Last, mean and smallest acceleration, and the share of periods that slow down."""
    a = F.col("acceleration")
    return series.groupBy(entity).agg(
        F.max_by("acceleration", period).alias("acc_last"),
        F.avg(a).alias("acc_mean"),
        F.min(a).alias("acc_min"),
        F.avg(F.when(a.isNotNull(), (a < 0).cast("double"))).alias("slowing_share"),
    )


def procrastination_rank(events: DataFrame, entity: str, task: Sequence[str], time: str) -> DataFrame:
    """Mean percent rank of completion within each task, per entity.

    Ranks are taken inside ranges of time and shifted by the counts of earlier ranges, so a
    task, or a moment, that holds most of the data is still ranked by many tasks.
    """
    task = list(task)
    counted = stage(events.groupBy(*task, time, entity).agg(F.count(F.lit(1)).alias("m")))
    ranked = ranks_within(counted, task, time, "m", entity, range_cuts(counted, time))
    rank = F.coalesce(F.try_divide(F.col("before"), (F.col("all") - 1).cast("double")), F.lit(0.0))
    return ranked.groupBy(entity).agg((F.sum(F.col("m") * rank) / F.sum("m")).alias("rpi"))


def procrastination_robust(events: DataFrame, entity: str, task: Sequence[str], delay: str) -> DataFrame:
    """Mean robust z-score of the delay within each task; tasks without spread are skipped."""
    task = list(task)
    rows = stage(events.select(entity, *task, F.col(delay).cast("double").alias("_d")))
    middle = exact_median(rows, task, "_d", "_median")
    centred = attach(rows, middle, task, [entity, "_d"]).withColumn("_gap", F.abs(F.col("_d") - F.col("_median")))
    centred = stage(centred)
    spread = exact_median(centred, task, "_gap", "_mad").where(F.col("_mad") > 0)
    z = (F.col("_d") - F.col("_median")) / (F.lit(MAD_SCALE) * F.col("_mad") + F.lit(1e-9))
    return attach(centred, spread, task, [entity, "_d"]).groupBy(entity).agg(F.avg(z).alias("rpi"))


def penalty_impute(df: DataFrame, by: Sequence[str], column: str, factor: float = 1.5,
                   key: str = "entity_id") -> DataFrame:
    """Missing delays become the group's largest delay x factor; ``was_missing`` keeps the fact."""
    largest = df.groupBy(*by).agg(F.max(column).alias("_largest"))
    joined = attach(df, largest, by, [key])
    return joined.withColumns({
        "was_missing": F.col(column).isNull().cast("int"),
        column: F.coalesce(F.col(column), F.col("_largest") * factor),
    }).drop("_largest")


def motivation(expectancy: str | Column, value: str | Column, impulsiveness: str | Column,
               delay: str | Column) -> Column:
    """Temporal motivation: high expectancy and value raise it, delay discounts it."""
    e, v, i, d = (F.col(c) if isinstance(c, str) else c for c in (expectancy, value, impulsiveness, delay))
    return e * v / (F.lit(1.0) + i * d)
