"""Out-of-fold scores, learners on the target cohort, neighbours and oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.catalog import query
from cohortlens.catalog.inputs import (
    FEATURES, FOLD, PAIR, fixed_columns, orders_with_features, r, source_folds, table,
)
from cohortlens.catalog.threshold_queries import CONSTRAINED, best_sql, sweep_sql
from cohortlens.operators import bayes, neighbors, resample
from cohortlens.operators.learners import make_learner, native_importance
from cohortlens.operators.importance import flatten_top
from cohortlens.operators.preprocess import FULL
from cohortlens.operators.threshold import threshold_sweep
from cohortlens.plans.search import BASE_GOAL, rate_candidates
from cohortlens.plans.validation import FoldedData, oof_one_pass, oof_scores


# --- naive Bayes ------------------------------------------------------------------------

def gnb_sql(rows: str, train: str, trials: str = "(0, 0.0)", own: bool = False, name: str = "gnb",
            per_fold: bool = True) -> str:
    """Gaussian naive Bayes as CTEs: ``rows`` are scored by statistics of ``train`` (aliases f, b).

    ``own``: smoothing is a share of each feature's own variance, else of the largest one.
    """
    v1, v2 = ("o1", "o2") if own else ("greatest(o1, o2)", "greatest(o1, o2)")
    return f"""{name}_t(trial_id, s) as (values {trials}),
{name}_c as ({train.format(cols="f.label, count(*) n, avg(f.qty) m1, var_pop(f.qty) v1, avg(f.n_lines) m2, var_pop(f.n_lines) v2", more=', f.label')}),
{name}_o as ({train.format(cols="var_pop(f.qty) o1, var_pop(f.n_lines) o2", more='')}),
{name}_st as (select fold, label, trial_id, n, m1, v1 + s * {v1} v1, m2, v2 + s * {v2} v2
  from {name}_c join {name}_o using (fold), {name}_t),
{name} as (select trial_id, entity_id, cohort, label, fold, 1 / (1 + exp(max(case when y = 0 then l end) - max(case when y = 1 then l end))) p
  from (select st.trial_id, f.entity_id, f.cohort, f.label, f.fold, st.label y, ln(n) - 0.5 * (ln(6.283185307179586 * v1) + (f.qty - m1) * (f.qty - m1) / v1)
        - 0.5 * (ln(6.283185307179586 * v2) + (f.n_lines - m2) * (f.n_lines - m2) / v2) l
    from {rows} f join {name}_st st on {'f.fold = st.fold' if per_fold else 'true'})
  group by trial_id, entity_id, cohort, label, fold)"""


OUT_OF_FOLD = "select b.fold, {cols} from fold f join (select distinct fold from fold) b on f.fold <> b.fold group by b.fold{more}"
WHOLE_SOURCE = "select 0 fold, {cols} from fold f group by 1{more}"
GNB = gnb_sql("fold", OUT_OF_FOLD)


@query(f"with {FOLD}, {GNB} select entity_id, fold, label, cast(trial_id as int) trial_id, {r('p')} p from gnb")
def gnb_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(bayes.gaussian_nb(source_folds(spark, sf_dir), PAIR))


@query(f"""with {FOLD}, tgt as (select *, cast(null as int) fold from feat where cohort = 2001),
{gnb_sql('tgt', WHOLE_SOURCE, per_fold=False)} select entity_id, label, {r('p')} p from gnb""")
def gnb_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of all source cohorts on the target cohort."""
    rows = source_folds(spark, sf_dir, target=True)
    scored = bayes.fit_gaussian_nb(rows, PAIR).score(rows.where("fold IS NULL"))
    return fixed_columns(scored.select("entity_id", "label", "p"))


@query(sweep_sql("gmean", CONSTRAINED, scores="gnb", keys="trial_id", with_=f"{FOLD}, {GNB}").replace(
    "select trial_id,", "select cast(trial_id as int) trial_id,"))
def recall_constrained_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: folds, pooled out-of-fold scores, best G-mean threshold with recall of 0.8."""
    scores = bayes.gaussian_nb(source_folds(spark, sf_dir), PAIR)
    return fixed_columns(threshold_sweep(scores, ["trial_id"], min_recall=0.8))


SMOOTHING = {0: 1e-9, 1: 1e-3, 2: 0.05, 3: 0.5}
_SMOOTHED = gnb_sql("fold", OUT_OF_FOLD, ", ".join(f"({t}, {s!r}::double)" for t, s in SMOOTHING.items()), own=True)
_VALUE = f"cast(trial_id as int) trial_id, {r('score - 6.0 * greatest(0, 0.8 - recall)', 5)} value, {r('t')} threshold, 'ok' status"


@query(f"{best_sql('gmean', 'score desc, i', scores='gnb', keys='trial_id', with_=f'{FOLD}, {_SMOOTHED}')} select {_VALUE} from best")
def candidate_search_gnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a batch in one scan of statistics, one scoring pass and one sweep."""
    data = FoldedData(source_folds(spark, sf_dir), PAIR)
    trials = rate_candidates(data, "GNB", {t: {"var_smoothing": s} for t, s in SMOOTHING.items()}, BASE_GOAL)
    return fixed_columns(trials.select("trial_id", "value", "threshold", "status"), value=5)


def bnb_sql(above: str, candidates: str, name: str = "bnb") -> str:
    """Bernoulli naive Bayes as CTEs; ``above`` gives the raw cut of feature x from trial t and fold statistics z."""
    flags = ", ".join(f"case when f.{x} > {above.format(x=x)} then 1 else 0 end b{i}" for i, x in ((1, "qty"), (2, "n_lines")))
    return f"""{name}_t(trial_id, alpha, cut) as (values {candidates}),
{name}_z as (select b.fold, avg(f.qty) m_qty, stddev_pop(f.qty) s_qty, avg(f.n_lines) m_n_lines, stddev_pop(f.n_lines) s_n_lines
  from fold f join (select distinct fold from fold) b on f.fold <> b.fold group by b.fold),
{name}_f as (select z.fold left_out, t.trial_id, alpha, f.entity_id, f.fold, f.label, {flags} from fold f, {name}_z z, {name}_t t),
{name}_st as (select left_out, trial_id, label, count(*) n, (sum(b1) + alpha) / (count(*) + 2 * alpha) q1, (sum(b2) + alpha) / (count(*) + 2 * alpha) q2
  from {name}_f where left_out <> fold group by left_out, trial_id, label, alpha),
{name} as (select trial_id, entity_id, label, fold, 1 / (1 + exp(max(case when y = 0 then l end) - max(case when y = 1 then l end))) p
  from (select f.trial_id, entity_id, f.label, fold, st.label y, ln(n) + ln(case when b1 = 1 then q1 else 1 - q1 end) + ln(case when b2 = 1 then q2 else 1 - q2 end) l
    from {name}_f f join {name}_st st on f.left_out = st.left_out and f.trial_id = st.trial_id where f.left_out = f.fold)
  group by trial_id, entity_id, label, fold)"""


BERNOULLI = {0: (1.0, 3.0), 1: (0.5, 90.0)}


@query(f"""with {FOLD}, {bnb_sql('t.cut', ', '.join(f'({t}, {a}, {c})' for t, (a, c) in BERNOULLI.items()))}
select entity_id, fold, label, cast(trial_id as int) trial_id, {r('p')} p from bnb""")
def bnb_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(bayes.bernoulli_nb(source_folds(spark, sf_dir), PAIR, BERNOULLI))


SCALED_CUTS = {0: (1.0, 0.0), 1: (10.0, 0.5), 2: (0.01, 1.0)}


@query(best_sql('gmean', 'score desc, i', scores='bnb', keys='trial_id', with_=f"""{FOLD},
{bnb_sql('z.m_{x} + t.cut * z.s_{x}', ', '.join(f'({t}, {a}, {c})' for t, (a, c) in SCALED_CUTS.items()))}""") + f"""
select {_VALUE} from best""")
def candidate_search_bnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose cuts are z-scores, so every fold counts its training rows at its own cuts."""
    data = FoldedData(source_folds(spark, sf_dir), PAIR)
    candidates = {t: {"alpha": a, "binarize": c} for t, (a, c) in SCALED_CUTS.items()}
    trials = rate_candidates(data, "BNB", candidates, BASE_GOAL)
    return fixed_columns(trials.select("trial_id", "value", "threshold", "status"), value=5)


# --- discriminant analysis --------------------------------------------------------------

@query(f"""with {FOLD},
c as (select b.fold, f.label, count(*) n, avg(qty) m1, avg(n_lines) m2, var_pop(qty) v1, var_pop(n_lines) v2, covar_pop(qty, n_lines) v12
  from fold f join (select distinct fold from fold) b on f.fold <> b.fold group by b.fold, f.label),
w as (select a.fold, a.n n0, b.n n1, a.m1 m01, a.m2 m02, b.m1 m11, b.m2 m12, (a.n * a.v1 + b.n * b.v1) / (a.n + b.n - 2) s11,
  (a.n * a.v2 + b.n * b.v2) / (a.n + b.n - 2) s22, (a.n * a.v12 + b.n * b.v12) / (a.n + b.n - 2) s12
  from c a join c b on a.fold = b.fold where a.label = 0 and b.label = 1),
d as (select *, (s22 * (m11 - m01) - s12 * (m12 - m02)) / (s11 * s22 - s12 * s12) d1,
  (s11 * (m12 - m02) - s12 * (m11 - m01)) / (s11 * s22 - s12 * s12) d2 from w)
select entity_id, f.fold, label, {r('1 / (1 + exp(-(d1 * (qty - (m11 + m01) / 2) + d2 * (n_lines - (m12 + m02) / 2) + ln(n1 / n0))))')} p
from fold f join d on f.fold = d.fold""")
def lda_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = FoldedData(source_folds(spark, sf_dir), PAIR)
    return fixed_columns(oof_scores(data, make_learner("LDA", {}, PAIR)))


# --- learners on the target cohort --------------------------------------------------------

DEFAULTS = {**K.BASE_DEFAULTS, **K.LIBRARY_DEFAULTS}


def _register_learner(family: str) -> None:
    def fit_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = FoldedData(source_folds(spark, sf_dir, target=True), FEATURES)
        train, target = data.split(FULL)
        model = make_learner(family, DEFAULTS[family], FEATURES).fit(train)
        return fixed_columns(model.score(target).select("entity_id", "label", "p"))

    fit_and_score.__doc__ = f"{family} trained cost-sensitively on all source cohorts, scores of the target cohort."
    query(name=f"learner_{family.lower()}")(fit_and_score)


for _family in DEFAULTS:
    _register_learner(_family)


@query()
def decision_tree_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of an iterative learner: one fit per fold, pooled."""
    data = FoldedData(source_folds(spark, sf_dir), FEATURES)
    return fixed_columns(oof_scores(data, make_learner("DT", DEFAULTS["DT"], FEATURES)))


@query()
def native_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impurity and coefficient importances, flattened to one row per model."""
    data = FoldedData(source_folds(spark, sf_dir), FEATURES)
    train = data.split(FULL)[0]
    rows = None
    for family in ("DT", "LR"):
        found = native_importance(make_learner(family, DEFAULTS[family], FEATURES).fit(train), train, family)
        rows = found if rows is None else rows.unionByName(found)
    return flatten_top(rows, n=3)


# --- neighbours ---------------------------------------------------------------------------

COORDINATES = [f"x{i}" for i in range(64)]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("entity_id"), *(F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(COORDINATES)),
        (F.col("label") < 3).cast("int").alias("label"))


POINTS = f"""pts as (select vec_id entity_id, {", ".join(f"embedding[{i + 1}]::double {x}" for i, x in enumerate(COORDINATES))}, case when label < 3 then 1 else 0 end as label from embeddings),
near as (select *, row_number() over (partition by entity_id order by raw, neighbor) as rank from (
  select q.entity_id, p.entity_id neighbor, {{raw}} raw, p.label from pts q join pts p on q.entity_id <> p.entity_id))"""
SQUARED = " + ".join(f"(q.{x} - p.{x}) * (q.{x} - p.{x})" for x in COORDINATES)
ABSOLUTE = " + ".join(f"abs(q.{x} - p.{x})" for x in COORDINATES)


@query(f"with {POINTS.format(raw=SQUARED)} select entity_id, cast(rank as int) as rank, neighbor, {r('sqrt(raw)')} distance, label from near where rank <= 5")
def knn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return fixed_columns(neighbors.knn_join(points, points, COORDINATES, 5, exclude="entity_id", payload=["label"]))


@query(f"with {POINTS.format(raw=SQUARED)} select entity_id, {r('avg(label)')} p from near where rank <= 5 group by entity_id")
def knn_vote_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    near = neighbors.knn_join(points, points, COORDINATES, 5, exclude="entity_id", payload=["label"])
    return fixed_columns(neighbors.neighbor_vote(near, 5))


@query(f"with {POINTS.format(raw=ABSOLUTE)} select entity_id, {r('sum(label / raw) / sum(1 / raw)')} p from near where rank <= 15 group by entity_id")
def knn_vote_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    near = neighbors.knn_join(points, points, COORDINATES, 15, exclude="entity_id", p=1, payload=["label"])
    return fixed_columns(neighbors.neighbor_vote(near, 15, "distance"))


@query()
def knn_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold KNN candidates over all source orders; checked by brute force in the tests."""
    data = FoldedData(source_folds(spark, sf_dir), PAIR)
    candidates = {0: {"n_neighbors": 15, "weights": "uniform", "p": 2}, 1: {"n_neighbors": 50, "weights": "distance", "p": 2}}
    return fixed_columns(oof_one_pass(data, "KNN", candidates))


# --- oversampling -------------------------------------------------------------------------

def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_with_features(spark, sf_dir).where("cohort <= 2000").select("entity_id", "label", *PAIR)


def smote_sql(bases: str) -> str:
    u = "('0x' || substr(md5(concat_ws(':', '42', '{0}', entity_id, copy)), 1, 8))::bigint / 4294967296.0::double"
    return f"""pos as (select entity_id, qty, n_lines::double n_lines from feat where cohort <= 2000 and label = 1),
base as (select *, row_number() over (order by md5(concat('42:', cast(entity_id as varchar))), entity_id) - 1 rk, count(*) over () nb
  from pos where entity_id in ({bases})),
need as (select count(*) filter (label = 0) - count(*) filter (label = 1) missing from feat where cohort <= 2000),
spec as (select entity_id, qty, n_lines, unnest(range(copies)) copy from (
  select *, missing // nb + case when rk < missing - missing // nb * nb then 1 else 0 end copies from base, need)),
drawn as (select *, floor({u.format('pick')} * 5) + 1 as rank, {u.format('step')} u from spec),
nbr as (select *, row_number() over (partition by entity_id order by raw, neighbor) as rank from (
  select a.entity_id, b.entity_id neighbor, (a.qty - b.qty) * (a.qty - b.qty) + (a.n_lines - b.n_lines) * (a.n_lines - b.n_lines) raw,
    b.qty to_qty, b.n_lines to_n_lines from base a join pos b on a.entity_id <> b.entity_id)),
synthetic as (select d.entity_id, cast(copy as int) copy, 1 as label, {r('qty + u * (to_qty - qty)')} qty, {r('n_lines + u * (to_n_lines - n_lines)')} n_lines
  from drawn d join nbr on d.entity_id = nbr.entity_id and d.rank = nbr.rank)"""


_FEAT = FOLD.split(",\nfold as")[0]
DANGER = """select entity_id from (select q.entity_id, p.label, row_number() over (partition by q.entity_id
    order by (q.qty - p.qty) * (q.qty - p.qty) + (q.n_lines - p.n_lines) * (q.n_lines - p.n_lines), p.entity_id) as rank
  from feat q join feat p on q.entity_id <> p.entity_id where q.label = 1 and q.cohort <= 2000 and p.cohort <= 2000)
  where rank <= 10 group by entity_id having count(*) filter (label = 0) * 2 >= count(*) and count(*) filter (label = 0) < count(*)"""


@query(f"with {_FEAT}, {smote_sql('select entity_id from pos')} select * from synthetic")
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(resample.smote(_train(spark, sf_dir), PAIR))


@query(f"with {_FEAT}, {smote_sql(DANGER)} select * from synthetic")
def borderline_smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_columns(resample.borderline_smote(_train(spark, sf_dir), PAIR))
