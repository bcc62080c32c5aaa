"""Registered queries run at the configured budgets."""

import inspect
from unittest.mock import MagicMock

import pytest

from cohortlens import constants as K
from cohortlens.catalog import QUERIES, fusion_queries, learner_queries
from cohortlens.operators.focal import FocalSchedule
from cohortlens.plans import search
from cohortlens.plans.validation import FoldedData


class Asked(Exception):
    pass


@pytest.mark.parametrize("name,module,call,want", [
    ("search_families", "search", "run_search", {"n_trials": K.BASE_TRIALS, "n_random": K.BASE_RANDOM_TRIALS, "top": K.BASE_TOP}),
    ("fusion_stacking", "fusion", "run_fusion", {"n_trials": K.FUSION_TRIALS, "n_random": K.FUSION_RANDOM_TRIALS, "top": K.FUSION_TOP}),
    ("focal_baseline", "baseline", "run_baseline", {"schedule": FocalSchedule()}),
])
def test_plans_run_at_configured_budgets(monkeypatch, name, module, call, want):
    holder = getattr(fusion_queries, module)
    signature = inspect.signature(getattr(holder, call))

    def record(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        raise Asked(bound.arguments)

    monkeypatch.setattr(holder, call, record)
    monkeypatch.setattr(fusion_queries, "source_folds", MagicMock())
    monkeypatch.setattr(fusion_queries, "FoldedData", MagicMock())
    with pytest.raises(Asked) as asked:
        QUERIES[name](None, "")
    assert {k: asked.value.args[0][k] for k in want} == want


@pytest.mark.parametrize("family", [*K.BASE_DEFAULTS, *K.LIBRARY_DEFAULTS])
def test_learners_run_at_configured_defaults(monkeypatch, family):
    monkeypatch.setattr(learner_queries, "source_folds", MagicMock())
    data = MagicMock()
    data.return_value.split.return_value = (None, None)
    monkeypatch.setattr(learner_queries, "FoldedData", data)

    def record(family, params, features):
        raise Asked(params)

    monkeypatch.setattr(learner_queries, "make_learner", record)
    with pytest.raises(Asked) as asked:
        QUERIES[f"learner_{family.lower()}"](None, "")
    assert asked.value.args[0] == {**K.BASE_DEFAULTS, **K.LIBRARY_DEFAULTS}[family]


def test_trials_that_differ_in_nothing_used_are_equal_and_fitted_once(folded, monkeypatch):
    data = FoldedData(folded, ["a", "b"])
    fits = []
    rate = search.oof_candidates
    monkeypatch.setattr(search, "oof_candidates", lambda d, f, some, w: fits.append(list(some)) or rate(d, f, some, w))
    candidates = {0: {"solver": "svd", "tol": 1e-8}, 1: {"solver": "lsqr", "tol": 1e-2}}
    trials = search.rank_trials(search.rate_candidates(data, "LDA", candidates).drop("rank"))
    assert fits == [[0]] and len({r["value"] for r in trials.collect()}) == 1
    report = search.evaluate_on_target(data, "LDA", trials, candidates).drop("params").toPandas()
    assert sorted(report.trial_id) == [0, 1] and report.auc.nunique() == 1


def test_target_scores_in_one_pass_equal_single_fits(folded):
    data = FoldedData(folded, ["a", "b"])
    for family, candidates in (("GNB", {0: {"var_smoothing": 1e-9}, 1: {"var_smoothing": 0.3}}),
                               ("BNB", {0: {"binarize": 0.1}, 1: {"binarize": 0.7, "alpha": 5.0}})):
        got = search.target_one_pass(data, family, candidates).toPandas()
        train, target = data.split(search.FULL)
        for t, params in candidates.items():
            want = search._learner(data, family, params).fit(train).score(target).toPandas().set_index("entity_id").p
            mine = got[got.trial_id == t].set_index("entity_id").p
            assert mine.to_dict() == pytest.approx(want.to_dict(), abs=1e-9)


@pytest.mark.parametrize("family,candidates", [("GNB", {0: {"var_smoothing": 1e-9}, 3: {"var_smoothing": 0.1}}),
                                               ("BNB", {0: {"alpha": 1.0, "binarize": 0.2}, 3: {"alpha": 50.0, "binarize": 0.9}})])
def test_naive_bayes_is_rated_on_equal_rows_as_one(spark, family, candidates):
    rows = [(i, (i * 7 % 11 < 4) * 1, None if i % 40 == 39 else i % 8, float(i * 3 % 5), None if i % 9 == 0 else float(i % 2) + (i * 7 % 11 < 4))
            for i in range(800)]
    data = FoldedData(spark.createDataFrame(rows, "entity_id long, label int, fold int, a double, b double"), ["a", "b"])
    assert data.counted.count() < 400 and data.counted.agg({"_times": "sum"}).first()[0] == 800
    trials = {r["trial_id"]: r for r in search.rate_candidates(data, family, candidates).collect()}
    plain = {r["trial_id"]: r for r in search.BASE_GOAL.rate(search.oof_candidates(data, family, candidates), ["trial_id"]).collect()}
    assert {t: (r["value"], r["threshold"]) for t, r in trials.items()} == {t: (r["value"], r["threshold"]) for t, r in plain.items()}
    ranked = search.rank_trials(search.rate_candidates(data, family, candidates).drop("rank"))
    report = {r["trial_id"]: r for r in search.evaluate_on_target(data, family, ranked, candidates).collect()}
    target = search.target_one_pass(data, family, candidates)
    areas = {r["trial_id"]: round(r["auc"], 4) for r in search.auc(target, ["trial_id"]).collect()}
    assert {t: r["auc"] for t, r in report.items()} == areas
    assert all(r["tp"] + r["fn"] + r["fp"] + r["tn"] == 20 for r in report.values())
