import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import bayes, linear, metrics
from cohortlens.operators.learners import FITTERS, UNWEIGHTED, make_learner, native_importance
from cohortlens.operators.preprocess import FULL
from cohortlens.plans.validation import FoldedData, oof_one_pass

FEATURES = ["a", "b", "c"]
PARAMS = {
    "XGBoost": {"n_estimators": 4, "max_depth": 3, "reg_lambda": 1.0}, "LightGBM": {"n_estimators": 4, "num_leaves": 7, "max_depth": -1},
    "HGB": {"max_iter": 4, "max_depth": 2, "early_stopping": True}, "CatBoost": {"iterations": 3, "depth": 2}, "GBC": {"n_estimators": 3, "max_depth": 2},
    "AdaBoost": {"n_estimators": 4}, "RF": {"n_estimators": 8, "max_depth": 4}, "ET": {"n_estimators": 8, "max_depth": 4},
    "DT": {"max_depth": 3, "min_samples_split": 5}, "LR": {"C": 1.0, "penalty": "l1", "max_iter": 20}, "ENLR": {"C": 1.0, "l1_ratio": 0.3, "max_iter": 20},
    "MLP": {"hidden": 4, "max_iter": 15}, "Ridge": {"alpha": 1.0}, "LDA": {"solver": "svd"}, "GNB": {}, "BNB": {"binarize": 0.5},
    "KNN": {"n_neighbors": 20, "weights": "distance"},
}


@pytest.fixture(scope="module")
def split(folded):
    return FoldedData(folded, FEATURES).split(FULL)


@pytest.mark.parametrize("family", list(FITTERS))
def test_every_family_finds_the_signal(split, family):
    train, target = split
    learner = make_learner(family, PARAMS[family], FEATURES)
    model = learner.fit(train)
    scored = model.score(target)
    assert scored.count() == 200 and set(target.columns) <= set(scored.columns)
    assert metrics.auc(scored.select("label", "p"), []).first()["auc"] > 0.65
    assert set(learner.dropped) == {k for k in PARAMS[family] if k in ("min_samples_split", "solver")}
    if family in ("DT", "LR", "AdaBoost", "Ridge", "LDA"):
        rows = {r["feature"]: r["importance"] for r in native_importance(model, train, family).collect()}
        assert max(rows, key=rows.get) == "a"


@pytest.mark.parametrize("family", ["RF", "Ridge"])
def test_equal_seed_gives_equal_scores(split, family):
    train, target = split
    fit = lambda: {r["entity_id"]: r["p"] for r in make_learner(family, PARAMS[family], FEATURES).fit(train).score(target).collect()}
    assert fit() == pytest.approx(fit())


def test_cost_sensitive_weights(split):
    train, _ = split
    n = {r["label"]: r["n"] for r in metrics.class_profile(train, []).collect()}
    weighted, column = make_learner("XGBoost", {}, FEATURES)._weighted(train)
    assert np.isclose(weighted.where("label = 1").first()[column], n[0] / n[1])
    for family in UNWEIGHTED:
        assert make_learner(family, {}, FEATURES)._weighted(train)[1] is None
    assert make_learner("DT", {}, FEATURES, cost_sensitive=False)._weighted(train)[1] is None
    with pytest.raises(ValueError):
        make_learner("SVC", {}, FEATURES)


def gaussian(train, rows, smoothing=0.0, own=False):
    logs = []
    overall = train[FEATURES].var(ddof=0)
    extra = smoothing * (overall if own else overall.max())
    for y in (0, 1):
        t = train[train.label == y]
        m, v = t[FEATURES].mean(), t[FEATURES].var(ddof=0) + extra
        logs.append(np.log(len(t)) - 0.5 * (np.log(2 * np.pi * v) + (rows[FEATURES] - m) ** 2 / v).sum(axis=1))
    return 1 / (1 + np.exp(logs[0] - logs[1]))


@pytest.mark.parametrize("own", [False, True])
def test_gaussian_nb(folded, own):
    frame = folded.toPandas().set_index("entity_id")
    model = bayes.fit_gaussian_nb(folded, FEATURES, {0: 0.0, 1: 0.2}, standardise=own)
    got = model.score(folded).toPandas()
    for trial, smoothing in ((0, 0.0), (1, 0.2)):
        p = got[got.trial_id == trial].set_index("entity_id")["p"]
        for fold in (2, None):
            mine = frame.fold.isna() if fold is None else frame.fold == fold
            want = gaussian(frame[frame.fold.notna() & ~mine], frame[mine], smoothing, own)
            assert np.allclose(p.reindex(want.index), want)


@pytest.mark.parametrize("scaled", [False, True])
def test_bernoulli_nb(folded, scaled):
    frame = folded.toPandas().set_index("entity_id")
    alpha, cut = 0.5, 0.3
    got = bayes.fit_bernoulli_nb(folded, FEATURES, {0: (alpha, cut)}, standardise=scaled).score(folded).toPandas().set_index("entity_id")["p"]
    mine = frame.fold == 1
    train = frame[frame.fold.notna() & ~mine]
    at = train[FEATURES].mean() + cut * train[FEATURES].std(ddof=0) if scaled else cut
    logs = []
    for y in (0, 1):
        q = ((train[train.label == y][FEATURES] > at).sum() + alpha) / ((train.label == y).sum() + 2 * alpha)
        on = frame[mine][FEATURES] > at
        logs.append(np.log((train.label == y).sum()) + (on * np.log(q) + ~on * np.log(1 - q)).sum(axis=1))
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert np.allclose(got.reindex(want.index), want)


@pytest.mark.parametrize("family,params", [("GNB", {"var_smoothing": 0.1}), ("BNB", {"binarize": -0.2, "alpha": 0.5})])
def test_one_pass_equals_a_fit_per_fold_with_gaps(folded, family, params):
    gaps = folded.withColumn("a", F.when(F.col("entity_id") % 4 != 0, F.col("a")))
    data = FoldedData(gaps, FEATURES)
    once = {r["entity_id"]: r["p"] for r in oof_one_pass(data, family, {0: params}).collect()}
    for fold in (0, 5):
        train, valid = data.split(fold)
        slow = {r["entity_id"]: r["p"] for r in make_learner(family, params, FEATURES).fit(train).score(valid).collect()}
        assert {k: once[k] for k in slow} == pytest.approx(slow)


def test_one_class_training_is_an_error(folded):
    with pytest.raises(ValueError, match="one class"):
        bayes.fit_gaussian_nb(folded.where("label = 0"), FEATURES)


def test_cross_products_and_ridge(folded):
    frame = folded.toPandas()
    sums = linear.cross_products(folded, ["a", "b"], "label")
    for y in (0, 1):
        x = np.column_stack([np.ones((frame.label == y).sum()), frame[frame.label == y][["a", "b"]]])
        assert np.allclose(sums[y], x.T @ x)
    w, b = linear.solve_ridge(sums[0] + sums[1], 2.0)  # a -> b
    x, t = frame["a"] - frame["a"].mean(), frame["b"] - frame["b"].mean()
    assert np.isclose(w[0], (x @ t) / (x @ x + 2.0)) and np.isclose(b, frame["b"].mean() - w[0] * frame["a"].mean())


def test_calibration_is_at_its_optimum(folded):
    model = linear.fit_calibrated_ridge(folded.where("fold IS NOT NULL"), FEATURES)
    scored = model.score(folded.where("fold IS NOT NULL"))
    row = scored.agg(F.avg("p").alias("p"), F.avg("label").alias("y")).first()
    assert abs(row["p"] - row["y"]) < 0.02 and len(model.parts) == 3


def test_spaces_have_a_learner():
    assert set(K.BASE_SPACES) <= set(FITTERS) and set(K.FUSION_METHODS) <= set(FITTERS)


def test_adaboost_takes_the_stumps_of_mllib(split):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    from cohortlens.operators.boosting import fit_adaboost
    train, target = split
    weighted = train.withColumn("w", F.when(F.col("label") == 1, 3.0).otherwise(0.7))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(weighted).select("_x", F.col("label").cast("double").alias("_y"), F.col("w").alias("_w"))
    tree, alphas, votes = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=1), [], []
    for _ in range(4):
        model = tree.fit(rows)
        judged = model.transform(rows)
        miss = F.col("prediction") != F.col("_y")
        bad, total = judged.agg(F.sum(F.when(miss, F.col("_w")).otherwise(0.0)), F.sum("_w")).first()
        alphas.append(float(np.log((1 - bad / total) / (bad / total))))
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(target)).toPandas().sort_values("entity_id")
        votes.append(2 * scored.prediction.to_numpy() - 1)
        rows = judged.withColumn("_w", F.col("_w") / total * F.when(miss, float(np.exp(alphas[-1]))).otherwise(1.0)).select("_x", "_y", "_w").localCheckpoint()
    want = 1 / (1 + np.exp(-sum(a * v for a, v in zip(alphas, votes)) / sum(alphas)))
    model = fit_adaboost(weighted, FEATURES, n_estimators=4, weight="w")
    assert len(model.stumps) == 4 and np.allclose(model.alphas, alphas)
    assert np.allclose(model.score(target).toPandas().sort_values("entity_id").p, want)
    one = fit_adaboost(train.where("label = 1"), FEATURES).score(target).agg(F.min("p"), F.max("p")).first()
    assert one[0] == one[1] > 0.7
    with pytest.raises(ValueError, match="miss a value"):
        fit_adaboost(train.withColumn("a", F.when(F.col("entity_id") > 5, F.col("a"))), FEATURES)


def test_gradient_boosting_is_that_of_mllib(split):
    from pyspark.ml.classification import GBTClassifier

    from cohortlens.operators.learners import Learner, _vector_fit
    train, target = split
    learner = make_learner("GBC", {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.2}, FEATURES)
    weighted, weight = learner._weighted(train)
    want = _vector_fit(Learner("GBC", {}, FEATURES), weighted, weight, GBTClassifier(maxIter=6, stepSize=0.2, maxDepth=3, maxBins=64, seed=42))
    scores = [m.score(target).toPandas().sort_values("entity_id").p.to_numpy() for m in (learner.fit(train), want)]
    assert np.allclose(*scores, atol=1e-9) and np.ptp(scores[0]) > 0.2


def test_cuts_are_bounded_where_a_feature_has_many_values(spark, monkeypatch):
    from cohortlens.operators import splits
    rows = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    assert [len(c) for c in splits.value_cuts(rows, ["a", "b"])] == [999, 2]
    assert [len(c) for c in splits.share_cuts(rows, ["a", "b"], 8)] == [7, 2]
    monkeypatch.setattr(splits, "VALUES", 100)
    monkeypatch.setattr(splits, "FINE", 50)
    assert [len(c) for c in splits.value_cuts(rows, ["a", "b"])] == [49, 2]
    assert np.array_equal(splits.equal_shares(np.ones(9), 2), [2, 5])


@pytest.mark.parametrize("family", ["GBC", "RF", "AdaBoost"])
def test_missing_labels_raise(split, family):
    holed = split[0].withColumn("label", F.when(F.col("entity_id") % 50 != 0, F.col("label")))
    with pytest.raises(ValueError, match="rows have no label"):
        make_learner(family, PARAMS[family], FEATURES).fit(holed)
