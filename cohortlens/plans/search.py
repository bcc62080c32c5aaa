"""Recall-penalised hyper-parameter search and evaluation on the held-out cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException, SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.scalars import BASE_GRID
from cohortlens.operators.importance import top_features
from cohortlens.operators.learners import make_learner
from cohortlens.operators.metrics import auc, metric_record
from cohortlens.operators.preprocess import FULL
from cohortlens.operators.threshold import carry_threshold, penalised, threshold_sweep
from cohortlens.plans.candidates import draw, draw_near
from cohortlens.plans.validation import ONE_PASS, TIMES, FoldedData, oof_candidates, scores_counted, target_one_pass  # noqa: F401
from cohortlens.session import stage
from cohortlens.sources.cohorts import union_by_name
from cohortlens.sources.trials import TRIALS_SCHEMA, rank_trials, select_trials


@dataclass(frozen=True)
class Goal:
    """What a search maximises. ``constrained`` picks thresholds under the recall floor."""

    objective: str = "gmean"
    min_recall: float = K.MIN_RECALL
    lam: float = K.PENALTY_BASE
    constrained: bool = False

    def rate(self, scores: DataFrame, by: Sequence[str], times: str | None = None) -> DataFrame:
        floor = self.min_recall if self.constrained else None
        swept = threshold_sweep(scores, by, BASE_GRID, self.objective, floor, times=times)
        return penalised(swept, self.lam, self.min_recall)


BASE_GOAL = Goal()
FUSION_GOAL = Goal(lam=K.PENALTY_FUSION, constrained=True)


#: What a fit raises for parameters or data that it cannot take; all else (lost executors, say) is passed on.
FIT_ERRORS = (ValueError, ArithmeticError, IllegalArgumentException, SparkRuntimeException)


#: Families whose candidates are rated on equal rows as one.
COUNTED = ("GNB", "BNB")


def _learner(data: FoldedData, family: str, params: Mapping):
    return make_learner(family, params, data.features, label=data.label, key=data.key,
                        cost_sensitive=params.get("class_weight", "balanced") is not None)


def _alike(data: FoldedData, family: str, candidates: Mapping[int, Mapping]) -> dict[int, int]:
    """{trial: first trial whose learner is the same}."""
    first: dict[str, int] = {}
    out = {}
    for trial, params in candidates.items():
        learner = _learner(data, family, params)
        out[trial] = first.setdefault(repr((sorted(learner.params.items()), learner.cost_sensitive)), trial)
    return out


def rate_candidates(data: FoldedData, family: str, candidates: Mapping[int, Mapping], goal: Goal = BASE_GOAL,
                    workers: int = 4) -> DataFrame:
    """The trials table of a batch: value and threshold from pooled out-of-fold scores.

    Closed-form families rate the whole batch in one sweep; others trial by trial, so that a
    plan holds the folds of one trial only. Trials that differ in nothing the learner uses are fitted once. A failed trial has a NULL value and its error as
    status.
    """
    rated, failed = {}, {}
    alike = _alike(data, family, candidates)
    first = {t: candidates[t] for t in dict.fromkeys(alike.values())}
    batches = [first] if family in ONE_PASS and data.plain else [{t: p} for t, p in first.items()]
    while batches:
        some = batches.pop(0)
        try:
            counted = family in COUNTED and data.plain
            scores = scores_counted(data, family, some) if counted else oof_candidates(data, family, some, workers)
            rated |= {r["trial_id"]: r for r in goal.rate(scores, ["trial_id"], TIMES if counted else None).collect()}  # one row per trial
        except FIT_ERRORS as problem:  # a trial that cannot be fitted is recorded, not rated as 0
            if len(some) > 1:
                batches = [{t: p} for t, p in some.items()] + batches  # which of them it was
            else:
                failed |= {t: f"{type(problem).__name__}: {problem}"[:500] for t in some}
    rows = []
    for trial, params in candidates.items():
        r = rated.get(alike[trial])
        cells = {k: str(v) for k, v in params.items()}
        status = "ok" if r else failed.get(alike[trial], "failed: no scores")
        rows.append((family, trial, cells, r and float(r["value"]), r and float(r["threshold"]), status, None))
    return data.df.sparkSession.createDataFrame(rows, TRIALS_SCHEMA)


def constrained_search(
    data: FoldedData, family: str, space: Mapping[str, Sequence], fixed: Mapping, goal: Goal = BASE_GOAL,
    n_trials: int = K.BASE_TRIALS, n_random: int = K.BASE_RANDOM_TRIALS, rules: str = "fusion",
    batch: int = 10, seed: int = K.SEED, workers: int = 4,
) -> tuple[DataFrame, dict[int, dict]]:
    """Search one family: a random batch, then batches near the best trials so far.

    Returns the ranked trials table and the typed parameters by trial id.
    """
    candidates = draw(space, fixed, range(min(n_random, n_trials)), rules, seed)
    trials = [rate_candidates(data, family, candidates, goal, workers)]
    while len(candidates) < n_trials:
        top = select_trials(rank_trials(union_by_name(trials)), range(max(1, len(candidates) // 4)))
        best = [candidates[r["trial_id"]] for r in top.orderBy("rank").collect()]
        start = len(candidates)
        ids = range(start, min(start + batch, n_trials))
        more = draw_near(space, fixed, ids, best, rules, seed) if best else draw(space, fixed, ids, rules, seed)
        candidates.update(more)
        trials.append(rate_candidates(data, family, more, goal, workers))
    return rank_trials(union_by_name(trials)), candidates


def evaluate_on_target(data: FoldedData, family: str, trials: DataFrame, candidates: Mapping[int, Mapping],
                       top: int = K.BASE_TOP) -> DataFrame:
    """Refit the best trials on all source rows and evaluate the target at each learned threshold.

    Order is by out-of-fold value; the target's metrics are a report, never a criterion.
    """
    chosen = select_trials(trials, range(top)).orderBy("rank").collect()  # at most ``top`` rows
    alike = _alike(data, family, {r["trial_id"]: candidates[r["trial_id"]] for r in chosen})
    first = {t: candidates[t] for t in dict.fromkeys(alike.values())}
    train, target = data.split(FULL)
    train = stage(train) if data.resample else train
    counted = False
    if not first:
        scored = [target.select(data.label, F.lit(0.0).alias("p"), F.lit(0).alias("trial_id")).limit(0)]
    elif counted := family in COUNTED and data.plain:  # one scan of statistics, one scoring pass
        scored = [scores_counted(data, family, first, target=True)]
    else:
        scored = [_learner(data, family, p).fit(train).score(target).select(data.label, "p", F.lit(t).alias("trial_id"))
                  for t, p in first.items()]
    fitted = stage(union_by_name(scored)).withColumnRenamed("trial_id", "_fit")
    of = data.df.sparkSession.createDataFrame([(f, t) for t, f in alike.items()], "_fit int, trial_id int")
    scores = fitted.join(F.broadcast(of), "_fit").drop("_fit")  # at most ``top`` rows
    learned = trials.where(F.col("rank") < top).select("trial_id", "threshold")
    times = TIMES if counted else None
    counts = carry_threshold(learned, scores, ["trial_id"], label=data.label, times=times)
    record = metric_record(counts, auc(scores, ["trial_id"], label=data.label, times=times), ["trial_id"], extra=["threshold"])
    names = F.concat(F.lit(f"{family}_Top"), F.col("rank") + 1)
    return trials.select("model_type", "trial_id", "rank", "value", "params", names.alias("model_id")).join(
        record, "trial_id")


def best_per_model(report: DataFrame) -> DataFrame:
    """The first-ranked row of every model."""
    return report.where(F.col("rank") == 0)


REPORT_ORDER = {"gmean": "gmean", "acc": "acc", "f1": "f1", "auc": "auc", "pre": "weighted_score"}


def sort_report(report: DataFrame, objective: str) -> DataFrame:
    """Best first by the column that belongs to the objective."""
    column = REPORT_ORDER.get(objective, "acc")
    return report.orderBy(F.col(column).desc(), "model_id")


def run_search(data: FoldedData, families: Sequence[str] = K.BASE_METHODS, spaces: Mapping = K.BASE_SPACES,
               goal: Goal = BASE_GOAL, n_trials: int = K.BASE_TRIALS, n_random: int = K.BASE_RANDOM_TRIALS,
               top: int = K.BASE_TOP, rules: str = "fusion", workers: int = 4) -> tuple[DataFrame, DataFrame]:
    """Search every family; returns (all trials, target report of the best of each family)."""
    trials, reports = [], []
    for family in families:
        space, fixed = spaces[family]
        found, params = constrained_search(data, family, space, fixed, goal, n_trials, n_random, rules, workers=workers)
        trials.append(found)
        reports.append(evaluate_on_target(data, family, found, params, top))
    return union_by_name(trials), union_by_name(reports)


def search_selected(data: FoldedData, importance: DataFrame, n: int = K.SELECT_FEATURES) -> FoldedData:
    """The same folds on the n most important features, for a second search."""
    part = data.on(top_features(importance, n))
    return part if part.features else data
