"""Fusion of base models: out-of-fold meta-features, stacking and soft voting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.scalars import BASE_GRID
from cohortlens.operators.importance import flatten_top
from cohortlens.operators.learners import make_learner, native_importance
from cohortlens.operators.metrics import auc, metric_record
from cohortlens.operators.preprocess import FULL
from cohortlens.operators.threshold import carry_threshold, threshold_sweep
from cohortlens.plans.candidates import fusion_space
from cohortlens.plans.search import FUSION_GOAL, Goal, constrained_search, evaluate_on_target, sort_report
from cohortlens.plans.validation import FoldedData, oof_scores
from cohortlens.session import stage
from cohortlens.sources.cohorts import union_by_name
from cohortlens.sources.trials import decode_params, rank_trials, select_trials, valid_trials


def meta_scores(data: FoldedData, models: Mapping[str, tuple], workers: int = 4) -> DataFrame:
    """Long scores (key, label, fold, model_id, p): out-of-fold for the source, full refit for the target.

    ``models``: {model id: (family, parameters)} or (family, parameters, features).
    """
    parts = []
    for model_id, (family, params, *own) in models.items():
        mine = data.on(own[0]) if own else data
        learner = make_learner(family, params, mine.features, label=data.label, key=data.key)
        scored = oof_scores(mine, learner, target=True, workers=workers)
        parts.append(scored.withColumn("model_id", F.lit(model_id)))
    return stage(union_by_name(parts))


def models_from_trials(trials: DataFrame, ranks: Mapping[str, Sequence[int]], name: str = "{family}_Top{place}") -> dict[str, tuple]:
    """Base models of a stored trials table: {model id: (family, parameters)} of the asked ranks of each family.

    Parameters are decoded by their names; numbers under other names become numbers again. Ranks without a trial give
    no model; a family without any raises a ValueError.
    """
    models: dict[str, tuple] = {}
    for family, asked in ranks.items():
        chosen = select_trials(valid_trials(trials.where(F.col("model_type") == family)), asked).select("rank", "params")
        held = sorted(r["rank"] for r in chosen.collect())  # at most as many as were asked for
        if not held:
            raise ValueError(f"no trial of {family} at ranks {list(asked)}")
        params: dict[int, dict] = {rank: {} for rank in held}
        for cell in decode_params(chosen, ["rank"], lenient=True).collect():
            value = cell[{"int": "i", "float": "d", "bool": "b", "str": "s"}[cell["kind"]]]
            params[cell["rank"]][cell["param"]] = _number(value) if cell["kind"] == "str" else value
        models |= {name.format(family=family, place=rank + 1): (family, params[rank]) for rank in held}
    return models


def _number(text: str) -> float | str:
    try:
        return float(text)
    except ValueError:
        return text


def live_models(scores: DataFrame, fold: str = "fold") -> list[str]:
    """Models with a non-zero score on some source row; the others carry nothing."""
    top = scores.where(F.col(fold).isNotNull()).groupBy("model_id").agg(F.max(F.abs("p")).alias("m"))
    return sorted(r["model_id"] for r in top.where(F.col("m") > 0).collect())


def meta_features(scores: DataFrame, models: Sequence[str], keys: Sequence[str] = ("entity_id", "label", "fold"),
                  features: DataFrame | None = None, key: str = "entity_id") -> DataFrame:
    """One row per entity, one column per model; with ``features``, the base features beside them."""
    wide = scores.where(F.col("model_id").isin(*models)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("model_id") == m, F.col("p"))).alias(m) for m in models])
    return wide if features is None else wide.join(features, key)


def soft_vote(scores: DataFrame, keys: Sequence[str] = ("entity_id", "label", "fold")) -> DataFrame:
    """Unweighted mean of the models' scores per entity."""
    return scores.groupBy(*keys).agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n_models"))


def voting_report(scores: DataFrame, keys: Sequence[str] = ("entity_id", "label", "fold"), label: str = "label",
                  fold: str = "fold", goal: Goal = FUSION_GOAL) -> DataFrame:
    """Threshold from the source's out-of-fold votes, metrics on the target."""
    votes = soft_vote(scores.where(F.col("model_id").isin(*live_models(scores, fold))), keys)
    votes = stage(votes.withColumn("model_id", F.lit("Soft_Voting_Average")))
    learned = threshold_sweep(votes.where(F.col(fold).isNotNull()), ["model_id"], BASE_GRID, goal.objective,
                              goal.min_recall, label=label)
    target = votes.where(F.col(fold).isNull())
    counts = carry_threshold(learned, target, ["model_id"], label=label)
    members = target.groupBy("model_id").agg(F.max("n_models").alias("included_models_count"))
    record = metric_record(counts, auc(target, ["model_id"], label=label), ["model_id"], extra=["threshold"])
    return record.join(members, "model_id")


def stack(meta: FoldedData, method: str, goal: Goal = FUSION_GOAL, n_trials: int = K.FUSION_TRIALS,
          n_random: int = K.FUSION_RANDOM_TRIALS, top: int = K.FUSION_TOP, space: tuple | None = None,
          workers: int = 4) -> DataFrame:
    """Search a meta learner on the out-of-fold scores, refit its best trials, report on the target.

    Importances of the best trial's inputs are added as top1_feature, top1_contrib, ...
    """
    tuned, fixed = space or fusion_space(method)
    trials, candidates = constrained_search(meta, method, tuned, fixed, goal, n_trials, n_random, "fusion", workers=workers)
    trials = rank_trials(valid_trials(trials, above=K.FUSION_MIN_VALUE).drop("rank"))
    report = evaluate_on_target(meta, method, trials, candidates, top)
    best = trials.where(F.col("rank") == 0).first()
    if best is None:
        return report
    learner = make_learner(method, candidates[best["trial_id"]], meta.features, label=meta.label, key=meta.key)
    model = learner.fit(meta.split(FULL)[0])
    if not hasattr(model, "importances"):
        return report
    tops = flatten_top(native_importance(model, meta.df, f"{method}_Top1"))
    return report.join(F.broadcast(tops), "model_id", "left")  # one row


def run_fusion(data: FoldedData, models: Mapping[str, tuple], strategy: str = "stacking",
               methods: Sequence[str] = K.FUSION_METHODS, goal: Goal = FUSION_GOAL, passthrough: bool = False,
               n_trials: int = K.FUSION_TRIALS, n_random: int = K.FUSION_RANDOM_TRIALS, top: int = K.FUSION_TOP,
               spaces: Mapping | None = None, workers: int = 4) -> DataFrame:
    """Soft voting, or stacking with each method; the report is sorted by the objective's metric."""
    scores = meta_scores(data, models, workers)
    if strategy == "voting":
        return voting_report(scores, data.keys(), data.label, data.fold, goal)
    inputs = live_models(scores, data.fold)
    base = data.df.select(data.key, *data.features) if passthrough else None
    wide = stage(meta_features(scores, inputs, data.keys(), base, data.key))
    columns = [*(data.features if passthrough else []), *inputs]
    meta = FoldedData(wide, columns, data.label, data.key, data.fold, scale=passthrough)
    reports = [
        stack(meta, m, goal, n_trials, n_random, top, (spaces or {}).get(m), workers) for m in methods
    ]
    return sort_report(union_by_name(reports), goal.objective)
