"""Meta-features, voting, stacking, attribution, importance; whole searches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog.inputs import (
    FEAT, FEATURES, FOLD, MODELS, PAIR, SCORES, fixed_columns, model_scores, orders_with_features, r, source_folds,
)
from cohortlens.catalog.learner_queries import (
    DEFAULTS, OUT_OF_FOLD, SMOOTHING, WHOLE_SOURCE, _SMOOTHED, gnb_sql,
)
from cohortlens.catalog.threshold_queries import AUC, CONSTRAINED, COUNTS, RECORD, best_sql, counts_sql, curve_sql, rates_sql
from cohortlens.operators import importance as ranking
from cohortlens.operators import metrics, preprocess
from cohortlens.operators.attribution import background, linear_attribution
from cohortlens.operators.learners import make_learner
from cohortlens.operators.linear import LinearScore
from cohortlens.operators.preprocess import FULL
from cohortlens.plans import baseline, explain, fusion, search
from cohortlens.plans.validation import FoldedData, oof_scores
from cohortlens.session import stage, stage_dir
from cohortlens.sources.cohorts import union_by_name
from cohortlens.sources.trials import rank_trials, read_trials, write_trials

# --- meta-features --------------------------------------------------------------------------

BASE = {"nb_qty": ("GNB", {"var_smoothing": 0.0}, ["qty"]), "nb_lines": ("GNB", {"var_smoothing": 0.0}, ["n_lines"])}


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = FoldedData(source_folds(spark, sf_dir, target=True), PAIR)
    return fusion.meta_scores(data, BASE)


def _one_feature(feature: str, name: str) -> str:
    stats = "select b.fold, f.label, count(*) n, avg(f.{x}) m, var_pop(f.{x}) v from fold f join (select distinct fold from fold) b on f.fold <> b.fold group by b.fold, f.label".replace("{x}", feature)
    full = "select label, count(*) n, avg({x}) m, var_pop({x}) v from fold group by label".replace("{x}", feature)

    def scored(rows: str, stats: str, on: str) -> str:
        return f"""select entity_id, label, fold, '{name}' model_id, 1 / (1 + exp(max(case when y = 0 then l end) - max(case when y = 1 then l end))) p
  from (select f.entity_id, f.label, f.fold, st.label y, ln(n) - 0.5 * (ln(6.283185307179586 * v) + (f.{feature} - m) * (f.{feature} - m) / v) l
    from {rows} f join ({stats}) st on {on}) group by entity_id, label, fold"""
    return f"{scored('fold', stats, 'f.fold = st.fold')} union all {scored('tgt', full, 'true')}"


META = f"""{FOLD}, tgt as (select *, cast(null as int) fold from feat where cohort = 2001),
meta as ({_one_feature('qty', 'nb_qty')} union all {_one_feature('n_lines', 'nb_lines')}),
wide as (select entity_id, label, fold, max(case when model_id = 'nb_qty' then p end) nb_qty, max(case when model_id = 'nb_lines' then p end) nb_lines
  from meta group by entity_id, label, fold)"""


@query(f"with {META} select entity_id, label, fold, {r('nb_qty')} nb_qty, {r('nb_lines')} nb_lines from wide")
def meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the source and full-model scores of the target, one column per model."""
    return fixed_columns(fusion.meta_features(_meta(spark, sf_dir), list(BASE)))


@query(f"with {META} select w.entity_id, w.label, w.fold, {r('nb_qty')} nb_qty, {r('nb_lines')} nb_lines, qty, n_lines from wide w join feat using (entity_id)")
def meta_with_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = orders_with_features(spark, sf_dir).select("entity_id", *PAIR)
    return fixed_columns(fusion.meta_features(_meta(spark, sf_dir), list(BASE), features=features))


@query(f"with {META} select entity_id, label, fold, {r('(nb_qty + nb_lines) / 2')} p, 2::bigint n_models from wide")
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(fusion.soft_vote(_meta(spark, sf_dir)))


@query(f"""with {META}, votes as (select entity_id, label, fold, 'Soft_Voting_Average' model_id, (nb_qty + nb_lines) / 2 p from wide),
src as (select * from votes where fold is not null), goal as (select * from votes where fold is null),
{curve_sql(fusion.BASE_GRID, 'src')},
best as (select model_id, t from (select *, row_number() over (partition by model_id order by {CONSTRAINED}) place
  from (select *, gmean score from curve)) where place = 1),
c as (select model_id, t, {counts_sql('t')} from goal join best using (model_id) group by model_id, t)
select model_id, {RECORD}, {COUNTS}, {r('t')} threshold, 2::bigint included_models_count
from {rates_sql('c')} join ({AUC.format(scores='goal')}) using (model_id)""")
def voting_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold learned on out-of-fold votes, metrics of the target's votes."""
    return fixed_columns(fusion.voting_report(_meta(spark, sf_dir)))


@query(f"""with {META}, stacked as (select entity_id, 0 cohort, label, fold, nb_qty qty, nb_lines n_lines from wide where fold is not null),
{gnb_sql('stacked', OUT_OF_FOLD.replace('from fold', 'from stacked'))} select entity_id, label, fold, {r('p')} p from gnb""")
def stacked_gnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A naive Bayes on the out-of-fold scores, with the same folds."""
    wide = stage(fusion.meta_features(_meta(spark, sf_dir), list(BASE)).where("fold IS NOT NULL"))
    meta = FoldedData(wide, list(BASE), scale=False)
    return fixed_columns(oof_scores(meta, make_learner("GNB", {"var_smoothing": 0.0}, list(BASE))))


@query(f"""with {SCORES}, every as (select model_id, p, cohort from scores union all select 'dead', 0.0::double, cohort from scores where model_id = 'a')
select model_id, count(*) n, {r('avg(p)')} mean from every group by model_id having max(abs(case when cohort <= 2000 then p end)) > 0""")
def live_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose scores are all zero on the source is dropped."""
    scores = model_scores(spark, sf_dir)
    dead = scores.where("model_id = 'a'").withColumns({"model_id": F.lit("dead"), "p": F.lit(0.0)})
    every = stage(scores.unionByName(dead).withColumn("fold", F.when(F.col("cohort") <= 2000, 0)))
    kept = every.where(F.col("model_id").isin(*fusion.live_models(every)))
    return fixed_columns(kept.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean")))


_SEARCHED = f"""{best_sql('gmean', 'score desc, i', scores='gnb', keys='trial_id', with_=f'{FOLD}, {_SMOOTHED}')},
tgt as (select *, cast(null as int) fold from feat where cohort = 2001),
{gnb_sql('tgt', WHOLE_SOURCE, ", ".join(f"({t}, {s!r}::double)" for t, s in SMOOTHING.items()), own=True, name='full_nb', per_fold=False)},
placed as (select trial_id, t, score - 6.0 * greatest(0, 0.8 - recall) value,
  row_number() over (order by score - 6.0 * greatest(0, 0.8 - recall) desc, trial_id) - 1 as rank from best)"""


@query(f"""{_SEARCHED},
goal as (select trial_id model_id, label, p from full_nb),
c as (select model_id, t, rank, value, {counts_sql('t')} from goal join placed on model_id = trial_id where rank < 2 group by model_id, t, rank, value)
select cast(model_id as int) trial_id, 'GNB_Top' || (rank + 1) model_id, cast(rank as int) as rank, {r('value', 5)} as value, {RECORD}, {COUNTS}, {r('t')} threshold
from {rates_sql('c')} join ({AUC.format(scores='goal')}) using (model_id)""")
def search_report_gnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates ranked by out-of-fold value; the best two refitted and evaluated on the target."""
    data = FoldedData(source_folds(spark, sf_dir, target=True), PAIR)
    candidates = {t: {"var_smoothing": s} for t, s in SMOOTHING.items()}
    trials = rank_trials(search.rate_candidates(data, "GNB", candidates).drop("rank"))
    report = search.evaluate_on_target(data, "GNB", trials, candidates, top=2)
    return fixed_columns(report.drop("model_type", "params"), value=5)


@query(f"""{_SEARCHED} select entity_id, label, fold, {r('avg(p)')} p, count(*) n_models from (
  select trial_id, entity_id, label, fold, p from gnb union all select trial_id, entity_id, label, fold, p from full_nb)
join placed using (trial_id) where rank in (0, 2) group by entity_id, label, fold""")
def fusion_from_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials are searched and stored; the fusion reads the table, builds the models of two ranks and votes."""
    data = FoldedData(source_folds(spark, sf_dir, target=True), PAIR)
    candidates = {t: {"var_smoothing": s} for t, s in SMOOTHING.items()}
    path = f"{stage_dir(spark).rstrip('/')}/trials-{uuid.uuid4().hex}"
    write_trials(rank_trials(search.rate_candidates(data, "GNB", candidates).drop("rank")), path)
    models = fusion.models_from_trials(read_trials(spark, path), {"GNB": [0, 2]})
    return fixed_columns(fusion.soft_vote(fusion.meta_scores(data, models)))


# --- attribution and importance ---------------------------------------------------------------

# Coefficients of linear scorers over the stand-in features.
LINEAR = {
    "a": {"qty": 0.004, "disc": 0.3, "n_lines": -0.9}, "b": {"qty": -0.002, "disc": 4.0, "n_lines": -0.2},
    "c": {"qty": 0.001, "disc": -1.5, "n_lines": 0.01},
}
PHI = FEAT + """, coef(model_id, feature, w) as (values """ + ", ".join(
    f"('{m}', '{f}', {w}::double)" for m, ws in LINEAR.items() for f, w in ws.items()) + """),
long as (select entity_id, unnest(['qty', 'disc', 'n_lines']) feature, unnest([qty, disc, n_lines::double]) v from feat),
mean as (select feature, avg(v) mu from long group by feature),
phi as (select entity_id, model_id, feature, w * (v - mu) phi from long join mean using (feature) join coef using (feature)),
imp as (select model_id, feature, avg(abs(phi)) importance from phi group by model_id, feature),
tab as (select *, importance / (sum(importance) over (partition by model_id) + 1e-9) * 100 pct,
  row_number() over (partition by model_id order by importance desc, feature) as rank from imp)"""


def _phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    feat = stage(orders_with_features(spark, sf_dir).select("entity_id", *FEATURES))
    return union_by_name([linear_attribution(feat, LinearScore(w, 0.0), model_id=m) for m, w in LINEAR.items()])


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(ranking.global_importance(_phi(spark, sf_dir)))


@query(f"with {PHI} select entity_id, model_id, feature, {r('phi', 5)} phi from phi")
def linear_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(_phi(spark, sf_dir), 5)


@query(f"with {PHI} select model_id, feature, {r('importance')} importance, {r('pct', 4)} contribution_pct, cast(rank as int) as rank from tab where rank <= 2")
def importance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute attribution, its share and rank; the top two of each model."""
    table = ranking.importance_table(_importance(spark, sf_dir), top=2)
    return fixed_columns(table, contribution_pct=4)


@query(f"""with {PHI} select model_id, max(case when rank = 1 then feature end) top1_feature, {r('max(case when rank = 1 then pct end)', 4)} top1_contrib,
  max(case when rank = 2 then feature end) top2_feature, {r('max(case when rank = 2 then pct end)', 4)} top2_contrib,
  max(case when rank = 3 then feature end) top3_feature, {r('max(case when rank = 3 then pct end)', 4)} top3_contrib from tab group by model_id""")
def importance_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(ranking.flatten_top(_importance(spark, sf_dir), n=3))


@query(f"""with {PHI}, best as (select feature from tab where model_id = 'a' and rank <= 2)
select feature, count(*) n, {r('avg(v)')} mean from long where feature in (select feature from best) group by feature""")
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the most important columns are read on."""
    chosen = ranking.top_features(_importance(spark, sf_dir).where("model_id = 'a'"), 2)
    stats = preprocess.moments(orders_with_features(spark, sf_dir), [], chosen)
    return fixed_columns(stats.select("feature", F.col("vals").alias("n"), "mean"))


# Weights of the stand-in models in a linear fusion.
FUSED = {"a": 1.5, "b": 0.5, "c": -0.8}


@query(f"""with {PHI}, models(model_id, a, b, c, v) as (values """ + ", ".join(
    f"('{m}', {a}::double, {b}::double, {c}::double, {FUSED[m]}::double)" for m, (a, b, c) in MODELS.items()) + f"""),
s as (select model_id, v, 1 / (1 + exp(-(a + b * n_lines + c * qty))) p from feat, models),
w as (select model_id, avg(abs(v * (p - mu))) w from (select *, avg(p) over (partition by model_id) mu from s) group by model_id)
select feature, {r('sum(w * importance)')} importance from imp join w using (model_id) group by feature""")
def importance_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of base features through a fusion model: its weight on each model times theirs."""
    scores = model_scores(spark, sf_dir).withColumn("fold", F.lit(0))
    wide = stage(fusion.meta_features(scores, list(MODELS)))
    meta = ranking.global_importance(linear_attribution(wide, LinearScore(FUSED, 0.0), model_id="fusion"))
    weights = meta.select(F.col("feature").alias("model_id"), "importance")
    return fixed_columns(ranking.propagate_importance(weights, _importance(spark, sf_dir)))


# --- iterative plans: rows only -----------------------------------------------------------------

def _explained(spark: SparkSession, sf_dir: str, family: str, rows: int | None = None) -> DataFrame:
    data = FoldedData(source_folds(spark, sf_dir, target=True), FEATURES)
    train, _ = data.split(FULL)
    learner = make_learner(family, DEFAULTS[family], FEATURES)
    phi = explain.attribute(learner, learner.fit(train), train, family, rows)
    return fixed_columns(ranking.importance_table(ranking.global_importance(phi)))


@query()
def tree_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tree attributions of boosted trees over every source row."""
    return _explained(spark, sf_dir, "XGBoost")


@query()
def sampled_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled attributions of a perceptron against a k-means background, over every source row."""
    return _explained(spark, sf_dir, "MLP")


@query()
def background_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means summary of the source rows."""
    rows = source_folds(spark, sf_dir)
    centres = background(rows, FEATURES)
    return fixed_columns(spark.createDataFrame(
        [(i, float(s), *[c[f] for f in FEATURES]) for i, (s, c) in enumerate(centres)],
        "centre int, share double, " + ", ".join(f"{f} double" for f in FEATURES)))


@query()
def focal_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focal-loss scorer: hold-out, median fill, dense-low sweep, metrics of the target cohort."""
    rows = source_folds(spark, sf_dir, target=True)
    return fixed_columns(baseline.run_baseline(
        rows.where("fold IS NOT NULL"), rows.where("fold IS NULL"), FEATURES))


@query()
def search_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random start, guided batch, refit and target report for two families."""
    data = FoldedData(source_folds(spark, sf_dir, target=True), FEATURES)
    _, report = search.run_search(data, ["GNB", "BNB"])
    return fixed_columns(report.drop("params"))


@query()
def fusion_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two base models stacked by discriminant analysis and naive Bayes, reported on the target."""
    data = FoldedData(source_folds(spark, sf_dir, target=True), FEATURES)
    models = {"nb": ("GNB", {}), "bern": ("BNB", {"binarize": 0.2})}
    report = fusion.run_fusion(data, models, "stacking", ["BNB", "LDA"])
    return fixed_columns(report.select("model_id", "rank", "value", *metrics.RATE_COLUMNS, "auc", "threshold"))
