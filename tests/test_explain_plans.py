from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import attribution, importance
from cohortlens.operators.focal import FocalSchedule, epoch_sums, fit_focal
from cohortlens.operators.learners import make_learner
from cohortlens.operators.linear import LinearScore
from cohortlens.operators.preprocess import FULL
from cohortlens.plans import baseline, candidates, explain, fusion, search
from cohortlens.plans.validation import FoldedData, oof_candidates, oof_scores
from cohortlens.sources.trials import rank_trials

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(folded):
    return FoldedData(folded, FEATURES)


# --- attribution -------------------------------------------------------------------------

def shapley(value, d):
    """Shapley values of a set function by enumeration."""
    phi = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            for s in combinations(others, size):
                w = factorial(size) * factorial(d - size - 1) / factorial(d)
                phi[i] += w * (value({*s, i}) - value(set(s)))
    return phi


def test_path_attribution_equals_enumeration(monkeypatch):
    leaves = [  # the second feature is met on every path, ranges of the first one overlap
        (1.0, [(0, -np.inf, 0.5, 0.3), (1, -np.inf, 1.0, 0.6)]), (-2.0, [(0, -np.inf, 0.5, 0.3), (1, 1.0, np.inf, 0.4)]),
        (0.5, [(0, 0.5, np.inf, 0.7), (2, -np.inf, 0.0, 0.2)]), (4.0, [(0, 0.5, np.inf, 0.7), (2, 0.0, np.inf, 0.8)])]
    x = np.array([[0.2, 2.0, 1.0], [0.9, 0.0, -1.0], [0.5, 1.0, 0.0]])
    for longest in (8, 1):  # with tables of patterns, and without
        monkeypatch.setattr(attribution, "TABLE_LENGTH", longest)
        got = attribution.path_shapley(x, attribution.flat_paths(leaves))
        for row, phi in zip(x, got):
            def value(known):
                return sum(v * np.prod([float(lo < row[f] <= hi) if f in known else s for f, lo, hi, s in ranges]) for v, ranges in leaves)
            assert np.allclose(phi, shapley(value, 3))


@pytest.mark.parametrize("family,params", [("DT", {"max_depth": 4}), ("RF", {"n_estimators": 5, "max_depth": 4}), ("GBC", {"n_estimators": 3, "max_depth": 3}), ("XGBoost", {"n_estimators": 3, "max_depth": 3}), ("LightGBM", {"n_estimators": 2})])
def test_tree_attributions_add_up(data, family, params):
    train, target = data.split(FULL)
    learner = make_learner(family, params, FEATURES)
    model = learner.fit(train)
    trees = getattr(model, "model", model)
    phi = attribution.tree_attribution(target, trees, FEATURES).groupBy("entity_id").agg(F.sum("phi").alias("s"))
    both = phi.join(model.score(target), "entity_id").toPandas()
    score = np.log(both.p / (1 - both.p)) / (2 if family == "GBC" else 1) if family in ("GBC", "XGBoost", "LightGBM") else both.p
    assert len(both) == 200 and np.ptp(score - both.s) < 1e-9  # a constant, the mean score, is left


def test_rows_in_the_same_ranges_are_explained_once(data, monkeypatch):
    model = make_learner("XGBoost", {"n_estimators": 3, "max_depth": 3}, FEATURES).fit(data.split(FULL)[0])
    groups = attribution.flat_paths(model.paths())
    x = np.random.default_rng(1).normal(size=(200, 3))
    x[::9, 1] = np.nan
    plain, asked = attribution.path_shapley, []
    monkeypatch.setattr(attribution, "path_shapley", lambda rows, some: asked.append(len(rows)) or plain(rows, some))
    kept = attribution.RangeCache(groups, 3)
    assert np.array_equal(kept.phi(np.concatenate([x, x])), plain(np.concatenate([x, x]), groups)) and asked[0] <= 200
    assert np.array_equal(kept.phi(x), plain(x, groups)) and len(asked) == 1
    monkeypatch.setattr(attribution, "KEPT_ROWS", 10)
    assert np.array_equal(attribution.RangeCache(groups, 3).phi(x), plain(x, groups))


def test_perceptron_is_explained_in_tasks_as_by_a_table_of_variants(data, monkeypatch):
    rows = data.split(FULL)[1].limit(30)
    model = make_learner("MLP", {"hidden": 4, "max_iter": 15}, FEATURES).fit(data.split(FULL)[0])
    centres = attribution.background(data.split(FULL)[0], FEATURES, k=3)
    explained = lambda: attribution.sampled_attribution(rows, model, FEATURES, centres).toPandas().sort_values(["entity_id", "feature"], ignore_index=True)
    scored, score = [], type(model).score
    monkeypatch.setattr(type(model), "score", lambda self, *args: scored.append(1) or score(self, *args))
    got = explained()
    assert not scored
    monkeypatch.setattr(type(model), "in_arrays", lambda self: None)
    want = explained()
    assert scored and list(got.feature) == list(want.feature) and len(got) == 90 and np.allclose(got.phi, want.phi, atol=1e-12)
    twice = attribution.sampled_attribution(rows.unionByName(rows), model, FEATURES, centres)
    assert twice.count() == 90


def test_rows_reach_a_perceptron_as_columns_of_numbers(data, monkeypatch):
    asked, plain = [], type(data.df).mapInArrow
    monkeypatch.setattr(type(data.df), "mapInArrow", lambda self, *args: asked.append([t for _, t in self.dtypes[1:]]) or plain(self, *args))
    rows = data.split(FULL)[1].limit(10)
    model = make_learner("MLP", {"hidden": 4, "max_iter": 5}, FEATURES).fit(data.split(FULL)[0])
    assert attribution.sampled_attribution(rows, model, FEATURES, [(1.0, {f: 0.0 for f in FEATURES})], 4).count() == 30
    assert asked == [["double"] * 5]  # three features and a draw for each permutation and its reverse
    x = np.random.default_rng(4).normal(size=(1100, 3))
    kept, score = x.copy(), model.in_arrays()
    assert np.allclose(score(x)[700:], score(x[700:]), rtol=0, atol=1e-14) and np.array_equal(x, kept)


def test_linear_and_sampled_attribution(data):
    rows = data.df.where("fold IS NULL")
    model = LinearScore({"a": 2.0, "b": -1.0, "c": 0.0}, 0.5)

    class Margin:
        def score(self, df, out):
            return df.withColumn(out, model.margin())

    exact = attribution.linear_attribution(rows, model).toPandas().pivot(index="entity_id", columns="feature", values="phi")
    frame = rows.toPandas().set_index("entity_id")
    assert np.allclose(exact["a"].sort_index(), 2 * (frame["a"] - frame["a"].mean()).sort_index())
    centre = {f: float(frame[f].mean()) for f in FEATURES}
    sampled = attribution.sampled_attribution(rows, Margin(), FEATURES, [(1.0, centre)]).toPandas().pivot(
        index="entity_id", columns="feature", values="phi")
    assert np.allclose(sampled.sort_index(), exact.sort_index()[sampled.columns])


def test_sampled_attribution_adds_up_to_the_gap(data):
    rows = data.df.where("fold IS NULL").limit(20)
    centres = attribution.background(data.df, FEATURES, k=3)
    assert np.isclose(sum(s for s, _ in centres), 1.0)
    model = make_learner("LDA", {}, FEATURES).fit(data.split(FULL)[0])
    phi = attribution.sampled_attribution(rows, model, FEATURES, centres[:1], permutations=2).groupBy("entity_id").agg(F.sum("phi").alias("s"))
    spark = rows.sparkSession
    at = spark.createDataFrame([tuple(centres[0][1][f] for f in FEATURES)], "a double, b double, c double")
    base = model.score(at).first()["p"]
    both = phi.join(model.score(rows), "entity_id").toPandas()
    assert np.allclose(both.s, both.p - base)


def test_importance_tables(spark):
    imp = spark.createDataFrame([("m", "x", 3.0), ("m", "y", 1.0), ("m", "z", 1.0), ("n", "x", 2.0)], "model_id string, feature string, importance double")
    rows = {(r["model_id"], r["feature"]): (r["rank"], round(r["contribution_pct"], 4)) for r in importance.importance_table(imp).collect()}
    assert rows == {("m", "x"): (1, 60.0), ("m", "y"): (2, 20.0), ("m", "z"): (3, 20.0), ("n", "x"): (1, 100.0)}
    assert importance.top_features(imp.where("model_id = 'm'"), 2) == ["x", "y"]
    flat = importance.flatten_top(imp, n=2).where("model_id = 'm'").first()
    assert (flat["top1_feature"], flat["top1_contrib"], flat["top2_feature"]) == ("x", 60.0, "y")
    meta = spark.createDataFrame([("m", 0.5), ("n", 2.0)], "model_id string, importance double")
    spread = {r["feature"]: r["importance"] for r in importance.propagate_importance(meta, imp).collect()}
    assert spread == {"x": 5.5, "y": 0.5, "z": 0.5}


# --- candidates ----------------------------------------------------------------------------

def test_range_rules():
    base, fused = candidates.base_kind, candidates.fusion_kind
    assert base("reg_lambda", [0.0001, 1000]) == ("choice", False)  # mixed types: two choices
    assert base("max_depth", [3, 20]) == ("int", False) and base("C", [0.001, 100.0]) == ("float", False)
    assert base("max_depth", [1, 50, None]) == ("choice", False) and base("bootstrap", [True, False]) == ("choice", False)
    assert fused("reg_lambda", [0.0001, 1000]) == ("float", True) and fused("n_estimators", [100, 5000]) == ("int", False)
    assert fused("max_iter", [100, 10000]) == ("int", True) and fused("gamma", [0, 20]) == ("float", False)
    assert fused("max_features", ["sqrt", "log2", 0.5, 0.9]) == ("choice", False) and fused("p", [1, 2]) == ("int", False)


@pytest.mark.parametrize("rules", ["base", "fusion"])
def test_draws_stay_in_range(rules):
    for family, (space, fixed) in K.BASE_SPACES.items():
        drawn = candidates.draw(space, fixed, range(40), rules)
        near = candidates.draw_near(space, fixed, range(40, 60), [drawn[0], drawn[1]], rules)
        for params in [*drawn.values(), *near.values()]:
            assert {**params, **fixed} == params
            for name, values in space.items():
                if candidates.RULES[rules](name, values)[0] == "choice":
                    assert params[name] in values
                else:
                    assert min(values) <= params[name] <= max(values)
    assert candidates.draw(space, fixed, range(40), rules) == drawn


def test_fusion_space_changes():
    assert candidates.fusion_space("LR")[0]["class_weight"] == ["balanced", None]
    assert candidates.fusion_space("HGB")[1]["early_stopping"] is True and "early_stopping" not in K.BASE_SPACES["HGB"][1]


# --- plans ------------------------------------------------------------------------------------

def test_oof_pools_every_source_row_once(data):
    scores = oof_scores(data, make_learner("LDA", {}, FEATURES), target=True).toPandas()
    assert scores.entity_id.is_unique and len(scores) == 800 and scores.fold.isna().sum() == 200


def test_one_pass_discriminants_equal_a_fit_per_fold(data, folded):
    learner = make_learner("LDA", {}, FEATURES)
    once = {r["entity_id"]: r["p"] for r in oof_scores(data, learner, target=True).collect()}
    for left_out in (3, FULL):
        train, valid = data.split(left_out)
        slow = {r["entity_id"]: r["p"] for r in learner.fit(train).score(valid).collect()}
        assert {k: once[k] for k in slow} == pytest.approx(slow)
    gaps = FoldedData(folded.withColumn("b", F.when(F.col("entity_id") % 7 != 0, F.col("b"))), FEATURES)
    assert oof_scores(gaps, learner).where("p IS NOT NULL").count() == 600


def test_past_only_and_resampled_folds(folded):
    past = FoldedData(folded.where("fold IS NOT NULL"), FEATURES, past_only=True)
    assert past.folds == [2, 3, 4, 5]
    train, valid = past.split(4)
    assert {r["fold"] for r in train.select("fold").distinct().collect()} == {0, 1, 2, 3} and valid.count() > 0
    assert oof_candidates(past, "GNB", {0: {}}).count() == folded.where("fold >= 2").count()
    train, _ = FoldedData(folded, FEATURES, resample="regular").split(0)
    assert train.where("label = 1").count() == train.where("label = 0").count()


def test_search_ranks_by_out_of_fold_value_and_reports_target(data):
    trials, params = search.constrained_search(data, "GNB", *K.BASE_SPACES["GNB"], n_trials=6, n_random=4, batch=2)
    rows = trials.orderBy("rank").collect()
    assert len(rows) == 6 and [r["value"] for r in rows] == sorted((r["value"] for r in rows), reverse=True)
    report = search.evaluate_on_target(data, "GNB", trials, params, top=3)
    assert report.count() == 3 and {r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in report.collect()} == {200}
    assert search.best_per_model(report).count() == 1
    assert [r["gmean"] for r in search.sort_report(report, "gmean").collect()] == sorted([r["gmean"] for r in report.collect()], reverse=True)


def test_failed_trial_has_no_value(data):
    trials = search.rate_candidates(data, "DT", {0: {"max_depth": 2}, 1: {"max_depth": 2, "min_samples_leaf": "many"}})
    rows = {r["trial_id"]: r for r in trials.collect()}
    assert rows[0]["status"] == "ok" and rows[0]["value"] is not None
    assert rows[1]["value"] is None and rows[1]["status"].startswith("ValueError")
    assert [r["trial_id"] for r in rank_trials(trials.drop("rank")).collect()] == [0]


def test_second_search_on_selected_features(data):
    imp = data.df.sparkSession.createDataFrame([("a", 3.0), ("b", 0.1), ("c", 2.0)], "feature string, importance double")
    assert search.search_selected(data, imp, 2).features == ["a", "c"]


def test_voting_and_stacking(data):
    models = {"nb": ("GNB", {}), "lda": ("LDA", {}, ["a", "c"]), "bern": ("BNB", {"binarize": 0.5})}
    vote = fusion.run_fusion(data, models, "voting").first()
    assert vote["included_models_count"] == 3 and vote["auc"] > 0.8
    report = fusion.run_fusion(data, models, methods=["LDA", "GNB"], n_trials=1, n_random=1, top=1, spaces={"GNB": ({"var_smoothing": [1e-9, 1e-3]}, {})})
    rows = {r["model_id"]: r for r in report.collect()}
    assert set(rows) == {"LDA_Top1", "GNB_Top1"} and rows["LDA_Top1"]["top1_feature"] in models


def test_passthrough_adds_base_features(data):
    report = fusion.run_fusion(data, {"nb": ("GNB", {})}, methods=["LDA"], passthrough=True, n_trials=1, n_random=1, top=1)
    row = report.first()
    assert {row[f"top{i}_feature"] for i in range(1, 5)} == {"a", "b", "c", "nb"}


def test_explain_models(data):
    trials = data.df.sparkSession.createDataFrame(
        [("DT", 0, {"max_depth": "3.0"}, 0.5, 0.5, "ok", 0), ("LR", 0, {"C": "1.0", "penalty": "l2"}, 0.4, 0.5, "ok", 0)],
        "model_type string, trial_id int, params map<string,string>, value double, threshold double, status string, rank int")
    table = explain.explain_models(data, trials, {"DT": "dt", "LR": "lr", "RF": "forest"}, top=1)
    assert {(r["model_id"], r["feature"]) for r in table.collect()} == {("DT", "a"), ("LR", "a")}
    with pytest.raises(ValueError):
        explain.explain_models(data, trials, {"RF": "forest"})


# --- baseline ---------------------------------------------------------------------------------

def test_focal_gradient_is_the_slope_of_the_loss(folded):
    rows = folded.where("fold IS NOT NULL").withColumn("part", F.when(F.col("fold") == 0, "valid").otherwise("train"))
    schedule = FocalSchedule()
    at = lambda d: epoch_sums(rows, LinearScore({"a": 0.3 + d, "b": -0.2}, 0.1), "label", schedule)
    slope = (at(1e-5)[0] - at(-1e-5)[0]) / 2e-5
    assert np.isclose(at(0)[1][1], slope, rtol=1e-5)


def test_focal_training_lowers_the_loss_and_stops(folded):
    rows = folded.where("fold IS NOT NULL").withColumn("part", F.when(F.col("fold") == 0, "valid").otherwise("train"))
    model, history = fit_focal(rows, ["a"], schedule=FocalSchedule(epochs=12, learning_rate=0.2))
    assert history[-1][0] < history[0][0] and model.coefficients["a"] > 0
    _, short = fit_focal(rows, ["a"], schedule=FocalSchedule(epochs=30, learning_rate=5.0, patience=3))
    assert len(short) < 30


def test_baseline_report(folded):
    source, target = folded.where("fold IS NOT NULL"), folded.where("fold IS NULL")
    row = baseline.run_baseline(source, target, FEATURES, schedule=FocalSchedule(epochs=8, learning_rate=0.2)).first()
    assert row["auc"] > 0.7 and row["tp"] + row["fp"] + row["tn"] + row["fn"] == 200


def test_knn_attribution_sees_the_feature_that_carries_the_label(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=120), rng.normal(size=120)
    df = spark.createDataFrame([(i, int(x > 0), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "entity_id int, label int, a double, b double")
    learner = make_learner("KNN", {"n_neighbors": 5}, ["a", "b"])
    model = learner.fit(df)
    centres = [(1.0, {"a": -1.0, "b": 0.0})]
    phi = attribution.sampled_attribution(df, model, ["a", "b"], centres, 2)
    mean = {r["feature"]: r["m"] for r in phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("m")).collect()}
    assert mean["a"] > 0.3 > 0.1 > mean["b"]
    total = {r["entity_id"]: r["t"] for r in phi.groupBy("entity_id").agg(F.sum("phi").alias("t")).collect()}
    at_centre = model.score(spark.createDataFrame([(-1, -1.0, 0.0)], "entity_id int, a double, b double")).first()["p"]
    assert total == pytest.approx({r["entity_id"]: r["p"] - at_centre for r in model.score(df).collect()})


def test_base_models_come_from_the_stored_trials(spark, tmp_path):
    from cohortlens.sources.trials import TRIALS_SCHEMA, read_trials, write_trials

    rows = [("GNB", 3, {"var_smoothing": "1e-09"}, 0.7, 0.5, "ok", 0), ("GNB", 1, {"var_smoothing": "0.5"}, 0.6, 0.5, "ok", 1),
            ("XGBoost", 0, {"max_depth": "4", "learning_rate": "0.2", "ACC": "0.9"}, 0.8, 0.4, "ok", 0),
            ("ET", 5, {"max_depth": "4"}, None, None, "failed", 0)]
    write_trials(spark.createDataFrame(rows, TRIALS_SCHEMA), str(tmp_path / "trials"))
    models = fusion.models_from_trials(read_trials(spark, str(tmp_path / "trials")), {"GNB": [1, 0, 9], "XGBoost": [0]})
    assert models == {"GNB_Top1": ("GNB", {"var_smoothing": 1e-9}), "GNB_Top2": ("GNB", {"var_smoothing": 0.5}),
                      "XGBoost_Top1": ("XGBoost", {"max_depth": 4, "learning_rate": 0.2})}
    for family in ("ET", "LDA"):
        with pytest.raises(ValueError, match=family):
            fusion.models_from_trials(read_trials(spark, str(tmp_path / "trials")), {family: [0]})
