"""Scans, column policies, class counts, folds, imputation and scaling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog.inputs import (
    FEAT, FEATURES, FOLD, SOURCE_YEARS, TARGET_YEAR, fixed_columns, orders_with_features, r, source_folds, table,
)
from cohortlens.functions.columns import POLICIES, clean_numeric, features_and_label, resolve_features
from cohortlens.operators import folds, metrics, preprocess
from cohortlens.operators.ranking import exact_median
from cohortlens.session import stage, stage_dir
from cohortlens.sources.cohorts import load_cohorts


@query(f"""with {FEAT}
select cohort, cast(cohort - 1994 as int) cohort_index, case when cohort <= 2000 then 'source' else 'target' end split,
  count(*) n, cast(sum(label) as bigint) n_pos, {r('sum(qty)')} qty,
  sum(case when cohort = 1996 then 0 else 1 end)::bigint n_tax
from feat group by cohort""")
def cohort_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder per cohort, one source missing (1994), one cohort without a column (1996)."""
    feat = orders_with_features(spark, sf_dir).select("entity_id", "cohort", "label", "qty", "tax")
    root = f"{stage_dir(spark)}/cohorts-{uuid.uuid4().hex}"
    whole, bare = feat.where("cohort <> 1996"), feat.where("cohort = 1996").drop("tax")
    whole.write.partitionBy("cohort").parquet(root)
    bare.drop("cohort").write.parquet(f"{root}-bare")
    sources = {y: f"{root}/cohort={y}" if y != 1996 else f"{root}-bare" for y in [1994, *SOURCE_YEARS]}
    loaded = load_cohorts(spark, sources, (TARGET_YEAR, f"{root}/cohort={TARGET_YEAR}"), "label")
    return fixed_columns(loaded.groupBy("cohort", "cohort_index", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.sum("qty").alias("qty"), F.count("tax").alias("n_tax")))


# Columns of a cohort table named as real ones are, and what fills them here.
NAMED = {
    "SID": "entity_id", "grade": "top_price", "MOOCgrade": "tax", "LE_score_off": "qty", "LS_score_off": "disc",
    "Fixed_rate": "disc", "LAcc_week": "n_lines", "RPI_mean": "tax", "LS_1": "qty", "LE_1": "n_lines",
    "作业完成时间": "qty", "作业完成处理后时间": "tax", "作业提交处理后时间": "disc", "作业总成绩": "top_price",
    "班级": "n_lines", "期末成绩_fg": "disc", "线下考试相关_1": "tax", "video_count": "n_lines", "only_in_source": "qty",
}
KEPT = {
    "with_finish_time": ["RPI_mean", "LS_1", "LE_1", "作业完成时间", "作业完成处理后时间", "作业提交处理后时间", "作业总成绩",
                         "班级", "期末成绩_fg", "线下考试相关_1", "video_count"],
    "with_finish_time_and_acceleration": ["LAcc_week", "RPI_mean", "LS_1", "LE_1", "作业完成时间", "作业完成处理后时间",
                                          "作业提交处理后时间", "作业总成绩", "班级", "期末成绩_fg", "线下考试相关_1", "video_count"],
    "without_finish_time": ["LE_score_off", "LS_score_off", "Fixed_rate", "LAcc_week", "RPI_mean", "LS_1", "LE_1",
                            "作业完成处理后时间", "作业提交处理后时间", "作业总成绩", "班级", "期末成绩_fg", "线下考试相关_1", "video_count"],
    "time_before_processing": ["LE_score_off", "LS_score_off", "Fixed_rate", "LAcc_week", "RPI_mean", "LS_1", "LE_1",
                               "作业完成时间", "作业总成绩", "班级", "期末成绩_fg", "线下考试相关_1", "video_count"],
    "predict_offline": ["LE_score_off", "LS_score_off", "Fixed_rate", "LAcc_week", "RPI_mean", "LS_1", "LE_1", "作业完成时间",
                        "作业完成处理后时间", "作业提交处理后时间", "作业总成绩", "video_count"],
    "fusion": ["Fixed_rate", "LAcc_week", "作业完成时间", "作业完成处理后时间", "作业提交处理后时间", "作业总成绩", "班级",
               "期末成绩_fg", "线下考试相关_1", "video_count"],
    "neural_baseline": ["LE_score_off", "LS_score_off", "Fixed_rate", "LAcc_week", "RPI_mean", "LS_1", "LE_1", "作业完成时间",
                        "作业完成处理后时间", "作业提交处理后时间", "班级", "期末成绩_fg", "线下考试相关_1", "video_count"],
}


@query(f"with {FEAT}, kept(policy, feature, src) as (values " + ", ".join(
    f"('{p}', '{f}', '{NAMED[f]}')" for p, fs in KEPT.items() for f in fs) + f"""),
long as (select label, unnest(['entity_id', 'top_price', 'tax', 'qty', 'disc', 'n_lines']) src,
  unnest([entity_id::double, top_price, tax, qty, disc, n_lines::double]) v from feat)
select policy, feature, count(*) n, {r('avg(v)')} mean from kept join long using (src) group by policy, feature""")
def feature_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named policy resolved against source and target schemas, then read."""
    feat = orders_with_features(spark, sf_dir)
    source = feat.select(*[F.col(c).alias(n) for n, c in NAMED.items()], F.col("label").alias("grade_label"))
    target = source.drop("only_in_source")
    kept = {p: resolve_features(source, target, policy) for p, policy in POLICIES.items()}
    every = sorted({f for fs in kept.values() for f in fs})
    long = preprocess.moments(features_and_label(source, every, "grade_label", []), [], every)
    pairs = F.array(*[F.struct(F.lit(p).alias("policy"), F.array(*map(F.lit, fs)).alias("fs")) for p, fs in kept.items()])
    return fixed_columns(
        long.select("feature", F.col("vals").alias("n"), "mean", F.explode(pairs).alias("k"))
        .where(F.array_contains("k.fs", F.col("feature"))).select("k.policy", "feature", "n", "mean"))


@query(f"""with {FEAT}
select cohort, count(*) n, count(case when n_lines > 2 then 1 end) n_finite,
  {r('avg(case when n_lines > 2 then qty / (n_lines - 2) end)')} mean from feat group by cohort""")
def clean_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate that is +inf, -inf or NaN for short orders, cleaned before it is averaged."""
    feat = orders_with_features(spark, sf_dir)
    wild = F.when(F.col("n_lines") == 1, float("-inf")).when((F.col("n_lines") == 2) & (F.col("label") == 1), float("nan")).when(
        F.col("n_lines") == 2, float("inf")).otherwise(F.try_divide(F.col("qty"), F.col("n_lines") - 2))
    cleaned = clean_numeric(feat.withColumn("rate", wild), ["rate"])
    return fixed_columns(cleaned.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.count("rate").alias("n_finite"), F.avg("rate").alias("mean")))


@query(f"""with {FEAT} select case when cohort <= 2000 then 'source' else 'target' end split, label, count(*) n
from feat group by all""")
def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("cohort") < TARGET_YEAR, "source").otherwise("target")
    return metrics.class_profile(orders_with_features(spark, sf_dir).withColumn("split", split), ["split"])


@query(f"""with {FEAT}, c as (select cohort, count(*) filter (label = 1) n_pos, count(*) filter (label = 0) n_neg
  from feat group by cohort)
select cohort, n_pos, n_neg, {r('n_pos / (n_pos + n_neg)')} pos_rate, {r('n_neg / (n_pos + 1e-9)')} neg_per_pos from c""")
def imbalance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(metrics.imbalance(orders_with_features(spark, sf_dir), ["cohort"]))


@query(f"""with {FEAT}, c as (select cohort, label, count(*) n, sum(count(*)) over (partition by cohort) total
  from feat group by cohort, label)
select entity_id, feat.cohort, feat.label, {r('total / (2.0 * n)')} weight
from feat join c on feat.cohort = c.cohort and feat.label = c.label""")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    feat = orders_with_features(spark, sf_dir).select("entity_id", "cohort", "label")
    return fixed_columns(metrics.balanced_weights(feat, ["cohort"]))


@query(f"""with {FEAT}, p as (select avg(label) rate, sum(1 - label) / (sum(label) + 1e-9) ratio from feat where cohort <= 2000)
select entity_id, label, {r('case when label = 1 then ratio else 1 end')} weight from feat, p where cohort <= 2000""")
def positive_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    feat = orders_with_features(spark, sf_dir).where(F.col("cohort") < TARGET_YEAR).select("entity_id", "label")
    return fixed_columns(metrics.positive_weight(feat))


@query(f"""with {FEAT}, long as (select cohort, unnest(['qty', 'disc', 'n_lines']) feature,
  unnest([qty, disc, n_lines::double]) v from feat),
p as (select feature, avg(v) pooled_mean, stddev_pop(v) sd from long group by feature)
select cohort, feature, {r('avg(v)')} mean, {r('max(pooled_mean)')} pooled_mean,
  {r('(avg(v) - max(pooled_mean)) / max(sd)', 5)} shift
from long join p using (feature) group by cohort, feature""")
def cohort_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(metrics.cohort_drift(orders_with_features(spark, sf_dir), FEATURES), shift=5)


@query(f"with {FOLD} select entity_id, cohort, label, fold from fold")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = orders_with_features(spark, sf_dir).where(F.col("cohort") < TARGET_YEAR).select("entity_id", "cohort", "label")
    return folds.assign_folds(source, SOURCE_YEARS)


@query(f"""with {FEAT} select entity_id, label, cast((row_number() over (partition by label
  order by md5(concat('42:', cast(entity_id as varchar))), entity_id) - 1) % 10 as int) fold from feat""")
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(orders_with_features(spark, sf_dir).select("entity_id", "label"))


@query(f"""with {FEAT} select entity_id, label, case when row_number() over (partition by label
  order by md5(concat('42:', cast(entity_id as varchar))), entity_id) - 1
  < floor(count(*) over (partition by label) * 0.2 + 0.5) then 'valid' else 'train' end part from feat""")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.holdout_split(orders_with_features(spark, sf_dir).select("entity_id", "label"))


@query("""with o as (select event_id, ts, row_number() over (order by ts, md5(concat('42:', cast(event_id as varchar))), event_id) - 1 pos,
  count(*) over () n from events)
select event_id, cast(case when pos < n - 10 * (n // 11) then -1 else (pos - (n - 10 * (n // 11))) // (n // 11) end as int) fold from o""")
def time_series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return folds.time_series_folds(events, "t", 10, "event_id").drop("t")


@query(f"""with {FEAT} select entity_id, label from feat
order by md5(concat('42:', cast(entity_id as varchar))), entity_id limit 2000""")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.sample_rows(orders_with_features(spark, sf_dir).select("entity_id", "label"), 2000)


@query(f"""with {FOLD}
select b.fold, count(*) n_train, cast(sum(f.label) as bigint) n_pos,
  count(*) filter (f.fold // 2 < b.fold // 2) n_past
from (select distinct fold from fold) b join fold f on f.fold <> b.fold group by b.fold""")
def fold_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of every fold, all others or only past cohorts, from one count per fold."""
    counts = source_folds(spark, sf_dir).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    return counts.selectExpr(
        "fold", "sum(n) OVER (PARTITION BY 1) - n AS n_train", "sum(pos) OVER (PARTITION BY 1) - pos AS n_pos",
        "coalesce(sum(n) OVER (PARTITION BY 1 ORDER BY fold DIV 2 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS n_past")


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing values: disc of one-line orders, qty of two-line orders."""
    return orders_with_features(spark, sf_dir).withColumns({
        "disc": F.when(F.col("n_lines") > 1, F.col("disc")), "qty": F.when(F.col("n_lines") != 2, F.col("qty")),
        "tax": F.when(F.col("label") == 1, F.col("tax"))})


GAPS = FEAT + """, gaps as (select entity_id, cohort, label, n_lines, case when n_lines > 1 then disc end disc,
  case when n_lines <> 2 then qty end qty, case when label = 1 then tax end tax from feat),
long as (select entity_id, unnest(['disc', 'qty', 'tax']) feature, unnest([disc, qty, tax]) v from gaps)"""
FILLED = """select feature, {fill} fill, {centre} centre, {scale} scale
from (select *, coalesce(v, f) w from long join (select feature, {agg}(v) f from long group by feature) using (feature))
group by feature"""


def _filled(agg: str) -> str:
    return f"with {GAPS} " + FILLED.format(
        fill=r("max(f)"), centre=r("avg(w)"), scale=r("stddev_pop(w)"), agg=agg)


@query(_filled("avg"))
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(preprocess.fit_standardiser(_with_gaps(spark, sf_dir), ["disc", "qty", "tax"], "mean"))


@query(_filled("median"))
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_with_gaps(spark, sf_dir).select("disc", "qty", "tax"))
    return fixed_columns(preprocess.fit_standardiser(rows, ["disc", "qty", "tax"], "median"))


@query(f"""with {GAPS}, w as (select entity_id, feature, coalesce(v, avg(v) over (partition by feature)) w from long),
z as (select entity_id, feature, {r('(w - avg(w) over (partition by feature)) / stddev_pop(w) over (partition by feature)')} z from w)
select entity_id, max(case when feature = 'disc' then z end) disc, max(case when feature = 'qty' then z end) qty,
  max(case when feature = 'tax' then z end) tax from z group by entity_id""")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_with_gaps(spark, sf_dir).select("entity_id", "disc", "qty", "tax"))
    names = ["disc", "qty", "tax"]
    return fixed_columns(preprocess.apply_standardiser(rows, preprocess.fit_standardiser(rows, names), names))


_GAP_FOLDS = FOLD + """, gaps as (select entity_id, fold, case when n_lines > 1 then disc end disc,
  case when n_lines <> 2 then qty end qty, n_lines::double n_lines from fold),
st as (select b.fold, avg(disc) m1, sqrt(var_pop(disc) * count(disc) / count(*)) s1, avg(qty) m2,
  sqrt(var_pop(qty) * count(qty) / count(*)) s2, avg(n_lines) m3, stddev_pop(n_lines) s3
  from (select distinct fold from gaps) b join gaps g on g.fold <> b.fold group by b.fold)"""


@query(f"""with {_GAP_FOLDS} select entity_id, g.fold, {r('(coalesce(disc, m1) - m1) / s1')} disc,
  {r('(coalesce(qty, m2) - m2) / s2')} qty, {r('(n_lines - m3) / s3')} n_lines
from gaps g join st on g.fold = st.fold""")
def fold_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold imputed and scaled by the statistics of the other folds, from one scan."""
    rows = source_folds(spark, sf_dir).withColumns({
        "disc": F.when(F.col("n_lines") > 1, F.col("disc")), "qty": F.when(F.col("n_lines") != 2, F.col("qty"))})
    scaled = preprocess.fold_standardise(rows.select("entity_id", "fold", *FEATURES), FEATURES)
    return fixed_columns(scaled)


@query(f"""with {FEAT} select cohort, {r('median(disc)')} disc, {r('median(qty)')} qty from feat group by cohort""")
def cohort_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians per cohort without holding a cohort in one task."""
    feat = stage(orders_with_features(spark, sf_dir).select("cohort", "disc", "qty"))
    both = exact_median(feat, ["cohort"], "disc", "disc").join(exact_median(feat, ["cohort"], "qty", "qty"), "cohort")
    return fixed_columns(both)
