import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from cohortlens.functions.scalars import BASE_GRID, DENSE_LOW_GRID
from cohortlens.operators import metrics, threshold

EPS = 1e-9


def counts(y, p, t):
    d = p > t
    return int((d & (y == 1)).sum()), int((d & (y == 0)).sum()), int((~d & (y == 0)).sum()), int((~d & (y == 1)).sum())


def score_of(objective, tp, fp, tn, fn):
    recall, spec = tp / (tp + fn + EPS), tn / (tn + fp + EPS)
    return recall, {
        "gmean": np.sqrt(recall * spec), "pre": 0.5 * spec + 0.5 * recall, "acc": (tp + tn) / (tp + fp + tn + fn),
        "f1": 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)}[objective]


def brute(y, p, grid, objective, min_recall=None):
    rated = []
    for i, t in enumerate(grid):
        c = counts(y, p, t)
        recall, score = score_of(objective, *c)
        single = c[0] + c[1] == 0 or c[2] + c[3] == 0
        if objective == "pre" and min_recall is None and single and len(set(y)) > 1:
            continue
        rated.append((i, t, c, recall, score))
    if not rated:
        return None, 0.5
    if min_recall is not None:
        feasible = [r for r in rated if r[3] >= min_recall]
        best = max(feasible, key=lambda r: (r[4], -r[0])) if feasible else max(rated, key=lambda r: (r[3], -r[0]))
    else:
        best = max(rated, key=lambda r: (r[4], -r[0]))
    return best[0], best[1]


def frame_of(groups):
    return pd.concat([pd.DataFrame({"g": g, "label": y, "p": p}) for g, (y, p) in groups.items()])


SCORE = st.one_of(st.floats(0, 1), st.sampled_from(BASE_GRID), st.sampled_from([0.0, 1.0, 0.5, 0.01, 0.99]))
GROUP = st.lists(st.tuples(st.integers(0, 1), SCORE), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, phases=(Phase.explicit, Phase.generate), suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(GROUP, min_size=6, max_size=6))
def test_sweep_equals_every_threshold_tried(spark, groups):
    data = {i: (np.array([r[0] for r in g]), np.array([r[1] for r in g])) for i, g in enumerate(groups)}
    scores = spark.createDataFrame(frame_of(data))
    for grid, objective, floor in [(BASE_GRID, "gmean", None), (BASE_GRID, "pre", None), (BASE_GRID, "f1", 0.8),
                                   (DENSE_LOW_GRID, "acc", None), (BASE_GRID, "gmean", 0.8)]:
        got = {r["g"]: (r["i"], r["threshold"]) for r in
               threshold.threshold_sweep(scores, ["g"], grid, objective, floor).collect()}
        assert got == {g: brute(y, p, grid, objective, floor) for g, (y, p) in data.items()}


def test_curve_is_dense_and_exact_on_grid_points(spark):
    y, p = np.array([1, 0, 1, 0]), np.array([BASE_GRID[3], BASE_GRID[3], 0.2, 0.995])
    scores = spark.createDataFrame(pd.DataFrame({"label": y, "p": p}))
    curve = threshold.threshold_curve(threshold.score_histogram(scores, [], BASE_GRID), [], 200).orderBy("i").collect()
    assert [(r["tp"], r["fp"], r["tn"], r["fn"]) for r in curve] == [counts(y, p, t) for t in BASE_GRID]


def test_missing_scores_are_an_error(spark):
    scores = spark.createDataFrame([(1, float("nan"))], "label int, p double")
    with pytest.raises(Exception, match="score is missing"):
        threshold.score_histogram(scores, [], BASE_GRID).collect()
    with pytest.raises(ValueError):
        threshold.threshold_sweep(scores, [], objective="recall")


def test_one_class_and_no_feasible_threshold(spark):
    scores = spark.createDataFrame(
        [("neg", 0, 0.3), ("neg", 0, 0.6), ("low", 1, 0.001), ("low", 1, 0.5), ("low", 0, 0.2)], "g string, label int, p double")
    got = {r["g"]: r for r in threshold.threshold_sweep(scores, ["g"], min_recall=0.8).collect()}
    assert got["neg"]["i"] == 0 and got["low"]["i"] == 0 and got["low"]["recall"] < 0.8
    skipped = threshold.threshold_sweep(scores.where("g = 'low'").where("p < 0.1 OR p = 0.001"), ["g"], objective="pre").first()
    assert skipped["threshold"] == 0.01  # one class only in the labels: nothing is skipped


def test_penalty_and_carried_threshold(spark):
    scores = spark.createDataFrame(
        [(1, 0.9), (1, 0.2), (0, 0.1), (0, 0.6)], "label int, p double").selectExpr("'m' AS g", "*")
    swept = threshold.threshold_sweep(scores, ["g"], objective="acc")
    row = threshold.penalised(swept, 6.0, 0.8).first()
    assert np.isclose(row["value"], row["score"] - 6.0 * max(0, 0.8 - row["recall"]))
    new = spark.createDataFrame([(1, 0.15), (0, 0.05), (0, 0.7)], "label int, p double").selectExpr("'m' AS g", "*")
    carried = threshold.carry_threshold(swept, new, ["g"]).first()
    t = swept.first()["threshold"]
    assert (carried["tp"], carried["fp"], carried["tn"], carried["fn"]) == counts(
        np.array([1, 0, 0]), np.array([0.15, 0.05, 0.7]), t)


@settings(max_examples=5, deadline=None, phases=(Phase.explicit, Phase.generate), suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(GROUP, min_size=5, max_size=5))
def test_auc_is_the_pair_share_and_ignores_monotone_maps(spark, groups):
    data = {i: (np.array([r[0] for r in g]), np.array([r[1] for r in g])) for i, g in enumerate(groups)}
    scores = spark.createDataFrame(frame_of(data))

    def pairs(y, p):
        if len(set(y)) < 2:
            return 0.5
        a, b = p[y == 1][:, None], p[y == 0][None, :]
        return float(((a > b) + 0.5 * (a == b)).mean())

    want = {g: pairs(y, p) for g, (y, p) in data.items()}
    got = {r["g"]: r["auc"] for r in metrics.auc(scores, ["g"]).collect()}
    assert got == pytest.approx(want)
    moved = {r["g"]: r["auc"] for r in metrics.auc(scores.withColumn("p", scores.p * 4), ["g"]).collect()}
    assert moved == pytest.approx(want)


def test_metric_record_on_a_small_table(spark):
    scores = spark.createDataFrame(
        [(1, 0.9), (1, 0.4), (1, 0.8), (0, 0.7), (0, 0.1), (0, 0.2), (0, 0.3)], "label int, p double").selectExpr("'m' AS g", "*")
    r = metrics.evaluate(scores, ["g"], 0.5).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 3, 1)
    assert (r["recall"], r["specificity"], r["acc"], r["precision"], r["f1"]) == (0.6667, 0.75, 0.7143, 0.6667, 0.6667)
    assert (r["gmean"], r["balanced_acc"], r["weighted_score"], r["fpr"], r["fnr"]) == (0.7071, 0.7083, 0.7083, 0.25, 0.3333)
    assert r["auc"] == 0.9167
    empty = metrics.evaluate(scores.where("label = 0"), ["g"], 0.95).first()
    assert (empty["precision"], empty["f1"], empty["auc"]) == (0.0, 0.0, 0.5)


def test_weights(cohort):
    w = metrics.balanced_weights(cohort, []).toPandas()
    assert np.allclose(w.groupby("label").weight.sum(), len(w) / 2)
    ratio = metrics.positive_weight(cohort).where("label = 1").first()["weight"]
    n = w.groupby("label").size()
    assert np.isclose(ratio, n[0] / n[1])


def test_sweep_plan_counts_before_it_shuffles(spark):
    scores = spark.range(1000).selectExpr("'m' AS g", "cast(id % 2 as int) AS label", "id / 1000.0D AS p")
    plan = threshold.threshold_sweep(scores, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "partial_count" in plan  # counted before the exchange
