"""Confusion counts, AUC, metric records and threshold choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.catalog import query
from cohortlens.catalog.inputs import SCORES, fixed_columns, model_scores, r
from cohortlens.functions.scalars import BASE_GRID, DENSE_LOW_GRID
from cohortlens.operators import metrics, threshold
from cohortlens.session import stage

BY = ["model_id"]


def grid_sql(grid, name: str = "grid") -> str:
    return f"{name}(i, t) as (values " + ", ".join(f"({i}, {t!r}::double)" for i, t in enumerate(grid)) + ")"


def rates_sql(source: str) -> str:
    """Adds the rates of a confusion table."""
    return f"""(select *, sqrt(recall * specificity) gmean, 0.5 * specificity + 0.5 * recall weighted_score,
      (recall + specificity) / 2 balanced_acc, (tp + tn) / (tp + fp + tn + fn) acc,
      case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision,
      case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end f1,
      fp / (tn + fp + 1e-9) fpr, fn / (tp + fn + 1e-9) fnr
    from (select *, tp / (tp + fn + 1e-9) recall, tn / (tn + fp + 1e-9) specificity from {source}))"""


def counts_sql(threshold_sql: str, extra: str = "") -> str:
    return f"""count(*) filter (label = 1 and p > {threshold_sql}) tp, count(*) filter (label = 0 and p > {threshold_sql}) fp,
      count(*) filter (label = 0 and not p > {threshold_sql}) tn, count(*) filter (label = 1 and not p > {threshold_sql}) fn{extra}"""


def curve_sql(grid, scores: str = "scores", keys: str = "model_id", name: str = "curve") -> str:
    """The plain form of the sweep: every score against every threshold (counted by distinct score)."""
    return f"""{grid_sql(grid, name + '_grid')},
{name}_s as (select {keys}, p, count(*) filter (label = 1) pos, count(*) filter (label = 0) neg from {scores} group by {keys}, p),
{name}_n as (select {keys}, i, t, coalesce(sum(pos) filter (p > t), 0) tp, coalesce(sum(neg) filter (p > t), 0) fp,
  coalesce(sum(neg) filter (not p > t), 0) tn, coalesce(sum(pos) filter (not p > t), 0) fn
  from {name}_s, {name}_grid group by {keys}, i, t),
{name} as {rates_sql(name + '_n')}"""


AUC = """select model_id, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) auc from (
  select *, coalesce(sum(neg) over (partition by model_id order by p rows between unbounded preceding and 1 preceding), 0) below
  from (select model_id, p, count(*) filter (label = 1) pos, count(*) filter (label = 0) neg from {scores} group by model_id, p))
  group by model_id"""

COUNTS = "cast(tp as bigint) tp, cast(fp as bigint) fp, cast(tn as bigint) tn, cast(fn as bigint) fn"
BEST = "{c} i, {t} threshold, " + COUNTS + f", {r('recall')} recall, {r('specificity')} specificity, {r('score')} score"


def best_sql(score: str, order: str, where: str = "true", grid=BASE_GRID, scores: str = "scores",
             keys: str = "model_id", with_: str = SCORES) -> str:
    """``with ... best as (the chosen row of the curve per key)``, unrounded."""
    return f"""with {with_}, {curve_sql(grid, scores, keys)},
best as (select * from (select *, row_number() over (partition by {keys} order by {order}) place
  from (select *, {score} score from curve where {where})) where place = 1)"""


def sweep_sql(*args, keys: str = "model_id", **options) -> str:
    return f"{best_sql(*args, keys=keys, **options)} select {keys}, {BEST.format(c='cast(i as int)', t=r('t'))} from best"


@query(f"""with {SCORES} select model_id, cohort, {counts_sql('0.1')} from scores group by model_id, cohort""")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(model_scores(spark, sf_dir), ["model_id", "cohort"], 0.1)


@query(f"""with {SCORES} select model_id, {r('auc')} auc from ({AUC.format(scores='scores')})""")
def auc_by_score_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(metrics.auc(stage(model_scores(spark, sf_dir).select("model_id", "label", "p")), BY))


RECORD = ", ".join(f"{r(c, 4)} as {c}" for c in (*metrics.RATE_COLUMNS, "auc"))


@query(f"""with {SCORES}, c as (select model_id, {counts_sql('0.1')} from scores group by model_id)
select model_id, {RECORD}, {COUNTS}, 0.1::double threshold
from {rates_sql('c')} join ({AUC.format(scores='scores')}) using (model_id)""")
def metric_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(stage(model_scores(spark, sf_dir).select("model_id", "label", "p")), BY, 0.1)


@query(f"""with {SCORES}, {curve_sql(BASE_GRID)} select model_id, cast(i as int) i, {COUNTS} from curve""")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of all 200 thresholds, from at most 201 counts per model."""
    histogram = threshold.score_histogram(model_scores(spark, sf_dir), BY, BASE_GRID)
    return threshold.threshold_curve(histogram, BY, len(BASE_GRID))


def _sweep(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return fixed_columns(threshold.threshold_sweep(model_scores(spark, sf_dir), BY, **options))


@query(sweep_sql("gmean", "score desc, i"))
def sweep_gmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, objective="gmean")


@query(sweep_sql("f1", "score desc, i"))
def sweep_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, objective="f1")


@query(sweep_sql("acc", "score desc, i"))
def sweep_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, objective="acc")


@query(sweep_sql("weighted_score", "score desc, i", "tp + fp > 0 and tn + fn > 0"))
def sweep_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, objective="pre")


@query(f"""with {SCORES}, c as (select model_id, {counts_sql('0.5')} from scores group by model_id)
select model_id, cast(null as int) i, 0.5::double threshold, {COUNTS}, {r('recall')} recall, {r('specificity')} specificity, {r('auc')} score
from {rates_sql('c')} join ({AUC.format(scores='scores')}) using (model_id)""")
def sweep_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the AUC objective the threshold stays at 0.5."""
    scores = stage(model_scores(spark, sf_dir).select("model_id", "label", "p"))
    return fixed_columns(threshold.threshold_sweep(scores, BY, objective="auc"))


CONSTRAINED = "recall >= 0.8 desc, case when recall >= 0.8 then score else recall end desc, i"


@query(sweep_sql("gmean", CONSTRAINED))
def sweep_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, objective="gmean", min_recall=0.8)


@query(sweep_sql("f1", CONSTRAINED))
def sweep_constrained_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, objective="f1", min_recall=0.8)


@query(sweep_sql("gmean", "score desc, i", grid=DENSE_LOW_GRID))
def sweep_dense_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, grid=DENSE_LOW_GRID, objective="gmean")


@query(f"""{best_sql("gmean", "score desc, i")}
select model_id, cast(i as int) i, {r('t')} threshold, {r('recall', 5)} recall, {r('score', 5)} score,
  {r('score - 6.0 * greatest(0, 0.8 - recall)', 5)} base_value, {r('score - 0.6 * greatest(0, 0.8 - recall)', 5)} fusion_value
from best""")
def penalised_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score minus the weighted shortfall of recall, with the weights of both layers."""
    swept = threshold.threshold_sweep(model_scores(spark, sf_dir), BY)
    both = threshold.penalised(threshold.penalised(swept, 6.0, out="base_value"), 0.6, out="fusion_value")
    chosen = both.select("model_id", "i", "threshold", "recall", "score", "base_value", "fusion_value")
    return fixed_columns(chosen, 5, threshold=6)


@query(f"""with {SCORES}, src as (select * from scores where cohort <= 2000), tgt as (select * from scores where cohort = 2001),
{curve_sql(BASE_GRID, 'src')},
best as (select model_id, t from (select *, row_number() over (partition by model_id order by {CONSTRAINED}) best
  from (select *, gmean score from curve)) where best = 1),
c as (select model_id, t, {counts_sql('t')} from tgt join best using (model_id) group by model_id, t)
select model_id, {RECORD}, {COUNTS}, {r('t')} threshold from {rates_sql('c')} join ({AUC.format(scores='tgt')}) using (model_id)""")
def carried_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds learned on the source cohorts, metrics on the target cohort."""
    scores = stage(model_scores(spark, sf_dir).select("cohort", "label", "model_id", "p"))
    source, target = scores.where("cohort <= 2000"), scores.where("cohort = 2001")
    learned = threshold.threshold_sweep(source, BY, min_recall=0.8)
    counts = threshold.carry_threshold(learned, target, BY)
    return fixed_columns(metrics.metric_record(counts, metrics.auc(target, BY), BY, extra=["threshold"]))
