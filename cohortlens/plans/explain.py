"""Refit chosen configurations and rank features by mean absolute attribution."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from cohortlens import constants as K
from cohortlens.operators.attribution import background, linear_attribution, sampled_attribution, tree_attribution
from cohortlens.operators.folds import sample_rows
from cohortlens.operators.importance import global_importance, importance_table
from cohortlens.operators.learners import Learner, VectorScore, make_learner
from cohortlens.operators.linear import CalibratedScore, LinearScore
from cohortlens.operators.preprocess import FULL
from cohortlens.plans.validation import FoldedData
from cohortlens.sources.cohorts import union_by_name
from cohortlens.sources.trials import decode_params, select_by_keyword


def attribute(learner: Learner, model, df: DataFrame, model_id: str, rows: int | None = None,
              permutations: int = 8) -> DataFrame:
    """phi per (entity, feature) by the method that fits the model.

    Trees and linear models are exact and run over every row; other scorers are sampled, on
    ``rows`` rows drawn by hash where that is given.
    """
    if learner.family in K.TREE_FAMILIES:
        trees = model.model if isinstance(model, VectorScore) else model
        return tree_attribution(df, trees, learner.features, learner.key, model_id)
    linear = _linear(model)
    if linear is not None:
        return linear_attribution(df, linear, learner.key, model_id)
    centres = background(df, learner.features)
    sample = df if rows is None else sample_rows(df, rows, learner.key)
    return sampled_attribution(sample, model, learner.features, centres, permutations, learner.key, model_id)


def _linear(model) -> LinearScore | None:
    if isinstance(model, LinearScore):
        return model
    if isinstance(model, CalibratedScore):
        return model.linear()
    if isinstance(model, VectorScore) and hasattr(model.model, "coefficients"):
        weights = dict(zip(model.features, map(float, model.model.coefficients.toArray())))
        return LinearScore(weights, float(model.model.intercept))
    return None


def params_of(trials: DataFrame, keyword: str, row: int = 0) -> dict | None:
    """Typed parameters of the row-th trial whose model name matches; None if there is none."""
    chosen = select_by_keyword(trials, keyword, row)
    cells = decode_params(chosen, ["model_type"], lenient=True).collect()  # one trial's parameters
    if not cells:
        return None
    pick = {"int": "i", "float": "d", "bool": "b", "str": "s"}
    return {c["param"]: c[pick[c["kind"]]] for c in cells}


def explain_models(data: FoldedData, trials: DataFrame, keywords: Mapping[str, str], row: int = 0,
                   rows: int | None = None, top: int | None = None) -> DataFrame:
    """Importance table over a {family: keyword} choice. A family without a trial is left out."""
    train, _ = data.split(FULL)
    tables = []
    for family, keyword in keywords.items():
        params = params_of(trials, keyword, row)
        if params is None:
            continue
        learner = make_learner(family, params, data.features, label=data.label, key=data.key)
        phi = attribute(learner, learner.fit(train), train, family, rows)
        tables.append(importance_table(global_importance(phi), top=top))
    if not tables:
        raise ValueError("no trial matches any keyword")
    return union_by_name(tables)
