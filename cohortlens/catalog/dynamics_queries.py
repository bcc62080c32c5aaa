"""Activity, acceleration, procrastination, imputation, motivation and losses over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog.inputs import fixed_columns, r, table
from cohortlens.functions.scalars import focal_loss, hard_decision, sigmoid
from cohortlens.operators import dynamics

DAYS = 3


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, from the first day to the last."""
    events = _events(spark, sf_dir)
    start, periods = dynamics.window_of(events, "ts", DAYS)
    return dynamics.activity_grid(events, "user_id", dynamics.period_of("ts", start, DAYS), periods, "value")


GRID = """span as (select min(cast(ts as date)) first_day from events),
w as (select user_id, date_diff('day', first_day, cast(ts as date)) // 3 period, count(*) x, sum(value) total
  from events, span group by 1, 2),
grid as (select u.user_id, cast(p.period as int) period, coalesce(x, 0) x, coalesce(total, 0) total
  from (select distinct user_id from w) u cross join (select unnest(range((select max(period) + 1 from w))) period) p
  left join w on w.user_id = u.user_id and w.period = p.period),
moves as (select *, x - lag(x) over s velocity, x - 2 * lag(x) over s + lag(x, 2) over s acceleration
  from grid window s as (partition by user_id order by period))"""


@query(f"with {GRID} select user_id, period, x, {r('total')} total from grid")
def activity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(_grid(spark, sf_dir))


@query(f"with {GRID} select user_id, period, x, velocity, acceleration from moves")
def acceleration_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.acceleration(_grid(spark, sf_dir).drop("total"), "user_id")


@query(f"""with {GRID} select user_id, arg_max(acceleration, period) acc_last, {r('avg(acceleration)')} acc_mean,
  min(acceleration) acc_min, {r('avg(case when acceleration is not null then (case when acceleration < 0 then 1 else 0 end) end)')} slowing_share
from moves group by user_id""")
def acceleration_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = dynamics.acceleration(_grid(spark, sf_dir), "user_id")
    return fixed_columns(dynamics.acceleration_features(series, "user_id"))


@query(f"""with p as (select user_id, percent_rank() over (partition by event_type, cast(ts as date) order by ts) pr from events)
select user_id, {r('avg(pr)')} rpi from p group by user_id""")
def procrastination_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select(
        "user_id", "event_type", F.to_date("ts").alias("day"), F.unix_micros("ts").alias("t"))
    return fixed_columns(dynamics.procrastination_rank(events, "user_id", ["event_type", "day"], "t"))


DELAY = "date_diff('microsecond', cast(cast(ts as date) as timestamp), ts) / 1e6"


@query(f"""with e as (select user_id, event_type, cast(ts as date) d, {DELAY} x from events),
m as (select *, median(x) over (partition by event_type, d) med from e),
a as (select *, median(abs(x - med)) over (partition by event_type, d) mad from m)
select user_id, {r('avg((x - med) / (1.4826 * mad + 1e-9))', 4)} rpi from a where mad > 0 group by user_id""")
def procrastination_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    delay = (F.unix_micros("ts") - F.unix_micros(day.cast("timestamp"))) / 1e6
    events = _events(spark, sf_dir).select("user_id", "event_type", day.alias("day"), delay.alias("delay"))
    return fixed_columns(dynamics.procrastination_robust(events, "user_id", ["event_type", "day"], "delay"), 4)


@query(f"""with e as (select event_id, event_type, cast(ts as date) d, case when value < 5 then null else value end delay from events)
select event_id, {r('coalesce(delay, max(delay) over (partition by event_type, d) * 1.5)')} delay,
  case when delay is null then 1 else 0 end was_missing from e""")
def penalty_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under 5 stand for completions that were never recorded."""
    events = _events(spark, sf_dir).select(
        "event_id", "event_type", F.to_date("ts").alias("day"), F.when(F.col("value") >= 5, F.col("value")).alias("delay"))
    filled = dynamics.penalty_impute(events, ["event_type", "day"], "delay", 1.5, "event_id")
    return fixed_columns(filled.select("event_id", "delay", "was_missing"))


@query(f"""with u as (select user_id, avg(case when event_type = 'purchase' then 1.0 else 0.0 end) e, avg(value) v,
  avg(case when event_type = 'error' then 1.0 else 0.0 end) i, avg(hour(ts) / 24.0) d from events group by user_id)
select user_id, {r('e * v / (1 + i * d)')} motivation from u""")
def motivation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    users = _events(spark, sf_dir).groupBy("user_id").agg(
        share("purchase").alias("e"), F.avg("value").alias("v"), share("error").alias("i"), F.avg(F.hour("ts") / 24.0).alias("d"))
    return fixed_columns(users.select("user_id", dynamics.motivation("e", "v", "i", "d").alias("motivation")))


LOSS = """z as (select *, (value - 50) / 50 z, case when event_type = 'error' then 1.0::double else 0.0::double end y from events),
b as (select *, greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) bce from z),
f as (select *, (0.75 * y + 0.25 * (1 - y)) * power(1 - exp(-bce), 2) * bce loss from b)"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = (F.col("event_type") == "error").cast("double")
    return _events(spark, sf_dir).withColumn("z", (F.col("value") - 50) / 50).withColumn("loss", focal_loss("z", y))


@query(f"with {LOSS} select event_type, {r('avg(loss)')} mean_loss, {r('sum(loss)', 4)} sum_loss from f group by event_type")
def focal_loss_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _losses(spark, sf_dir).groupBy("event_type").agg(F.avg("loss").alias("mean_loss"), F.sum("loss").alias("sum_loss"))
    return fixed_columns(grouped, sum_loss=4)


@query(f"with {LOSS} select event_id, {r('loss')} loss, {r('1 / (1 + exp(-z))')} p, case when 1 / (1 + exp(-z)) > 0.5 then 1 else 0 end decision from f")
def focal_loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _losses(spark, sf_dir).withColumn("p", sigmoid("z"))
    return fixed_columns(rows.select("event_id", "loss", "p", hard_decision("p", 0.5).alias("decision")))
