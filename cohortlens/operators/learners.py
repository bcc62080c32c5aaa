"""Registry of learners: a family name and its parameters give something with fit and score.

XGBoost, LightGBM, HGB and CatBoost are the growth rules of ``histogram_trees`` (level-wise, leaf-wise
and symmetric trees, second order, with penalties and early stopping), GBC that of MLlib's GBT there; ET and RF are the
forests of ``extra_trees``, DT is MLlib's tree. Parameters without a
counterpart (solvers, tolerance) are dropped and listed in ``Learner.dropped``. Cost-sensitive training is one weight column for every family that takes
weights; naive Bayes, KNN, LDA and the perceptron train unweighted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators.bayes import fit_bernoulli_nb, fit_gaussian_nb
from cohortlens.operators.boosting import fit_adaboost
from cohortlens.operators.extra_trees import fit_extra_trees, fit_random_forest
from cohortlens.operators.histogram_trees import Growth, fit_boosted
from cohortlens.operators.linear import fit_calibrated_ridge, fit_discriminant
from cohortlens.operators.metrics import balanced_weights, positive_weight
from cohortlens.operators.neighbors import knn_join, neighbor_vote
from cohortlens.operators.perceptron import fit_perceptron
from cohortlens.operators.splits import share_cuts

MAX_DEPTH = 30  # the deepest tree MLlib grows
WEIGHT = "_weight"
UNWEIGHTED = ("GNB", "BNB", "KNN", "LDA", "MLP")
#: Rows x hidden units of a perceptron up to which MLlib fits it; beyond, the same search costs less on arrays.
MLLIB_CELLS = 1 << 24


@dataclass
class Learner:
    """A family with its parameters. ``fit`` returns a model with ``score(df) -> df with p``."""

    family: str
    params: dict
    features: Sequence[str]
    label: str = "label"
    key: str = "entity_id"
    cost_sensitive: bool = True
    dropped: tuple[str, ...] = field(default=())

    def fit(self, train: DataFrame):
        weighted, weight = self._weighted(train)
        return FITTERS[self.family](self, weighted, weight)

    def _weighted(self, train: DataFrame) -> tuple[DataFrame, str | None]:
        if not self.cost_sensitive or self.family in UNWEIGHTED:
            return train, None
        if self.family in K.POSITIVE_WEIGHT_FAMILIES:
            return positive_weight(train, self.label, WEIGHT), WEIGHT
        return balanced_weights(train, [], self.label, WEIGHT), WEIGHT


def make_learner(family: str, params: Mapping, features: Sequence[str], **options) -> Learner:
    if family not in FITTERS:
        raise ValueError(f"unknown model family {family!r}")
    used = USED_PARAMS.get(family, ())
    dropped = tuple(sorted(k for k in params if k not in used))
    return Learner(family, {k: v for k, v in params.items() if k in used}, list(features), dropped=dropped, **options)


@dataclass(frozen=True)
class VectorScore:
    """A fitted MLlib classifier over assembled features."""

    model: object
    features: tuple[str, ...]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        vectors = VectorAssembler(inputCols=list(self.features), outputCol="_x").transform(df)
        scored = self.model.transform(vectors)
        p = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
        return scored.withColumn(out, p).drop("_x", "prediction", "rawPrediction", "probability")

    def in_arrays(self) -> Callable[[np.ndarray], np.ndarray] | None:
        """Scores of an array of rows, as a function for tasks; None where the model has none."""
        if not isinstance(self.model, MultilayerPerceptronClassificationModel):
            return None
        return Perceptron(tuple(self.model.getLayers()), np.array(self.model.weights.toArray()))

    def importances(self) -> dict[str, float]:
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
        else:
            values = abs(self.model.coefficients.toArray())
        return dict(zip(self.features, map(float, values)))


#: Rows that a perceptron scores at a time, so that a layer stays in the cache.
SCORED_ROWS = 512


@dataclass(frozen=True)
class Perceptron:
    """MLlib's perceptron on arrays: sigmoid layers and a softmax on top; the score of class 1."""

    layers: tuple[int, ...]
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._scores(x[i:i + SCORED_ROWS]) for i in range(0, len(x), SCORED_ROWS)] or [np.zeros(0)])

    def _scores(self, x: np.ndarray) -> np.ndarray:
        at, last = 0, len(self.layers) - 2
        for i, (n_in, n_out) in enumerate(zip(self.layers, self.layers[1:])):
            end = at + n_in * n_out
            x = x @ self.weights[at:end].reshape(n_in, n_out)
            x += self.weights[end:end + n_out]
            at = end + n_out
            if i < last:
                x = expit(x)
        top = np.exp(x - x.max(axis=1, keepdims=True))
        return top[:, 1] / top.sum(axis=1)


def expit(z: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
        np.exp(np.negative(z, out=z), out=z)
    z += 1.0
    return np.reciprocal(z, out=z)


@dataclass(frozen=True)
class KeyedScore:
    """A learner that scores by a rule over the rows to score (a join with its training rows, say)."""

    rule: Callable[[DataFrame], DataFrame]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return self.rule(df).withColumnRenamed("p", out)


def _vector_fit(learner: Learner, train: DataFrame, weight: str | None, estimator, extra: Sequence[str] = ()) -> VectorScore:
    vectors = VectorAssembler(inputCols=list(learner.features), outputCol="_x").transform(train)
    kept = vectors.select("_x", F.col(learner.label).cast("double").alias(learner.label),
                          *([weight] if weight else []), *extra)
    estimator = estimator.setFeaturesCol("_x").setLabelCol(learner.label)
    if weight:
        estimator = estimator.setWeightCol(weight)
    return VectorScore(estimator.fit(kept), tuple(learner.features))


def _refuse_unlabelled(train: DataFrame, label: str) -> None:
    """Families that follow MLlib's refuse a missing label as MLlib does."""
    y = F.col(f"`{label}`").cast("double")
    bad = train.agg(F.count_if(y.isNull() | F.isnan(y))).first()[0]
    if bad:
        raise ValueError(f"{bad} training rows have no {label}")


def _depth(params: Mapping, default: int) -> int:
    depth = params.get("max_depth", default)
    depth = MAX_DEPTH if depth is None or depth < 0 else depth
    return max(1, min(int(depth), MAX_DEPTH))


def growth_of(family: str, params: Mapping) -> Growth:
    """The growth rule that a boosted family and its parameters stand for."""
    p = params
    depth = p.get("max_depth", {"XGBoost": 6, "CatBoost": p.get("depth", 6)}.get(family))
    depth = None if depth is None or depth <= 0 else int(depth)
    own = {
        "XGBoost": dict(shape="level", reg_lambda=1.0, min_hessian=float(p.get("min_child_weight", 1.0)), learning_rate=0.3),
        "LightGBM": dict(shape="leaf", max_leaves=int(p.get("num_leaves", 31)), reg_lambda=0.0, min_hessian=1e-3,
                         min_rows=int(p.get("min_child_samples", 20))),
        "HGB": dict(shape="leaf", max_leaves=31, reg_lambda=0.0, min_hessian=1e-3, min_rows=int(p.get("min_samples_leaf", 20)),
                    tolerance=1e-7),
        "CatBoost": dict(shape="symmetric", reg_lambda=3.0, learning_rate=0.03),
    }[family]
    given = {
        "learning_rate": p.get("learning_rate"), "min_gain": p.get("gamma"),
        "reg_lambda": p.get("reg_lambda", p.get("lambda_l2", p.get("l2_regularization", p.get("l2_leaf_reg")))),
        "reg_alpha": p.get("reg_alpha", p.get("lambda_l1")),
        "row_share": p.get("subsample", p.get("bagging_fraction")),
        "feature_share": p.get("colsample_bytree", p.get("feature_fraction")),
    }
    patience = p.get("early_stopping_rounds", K.STOPPING_ROUNDS[family])
    if family == "HGB" and not p.get("early_stopping"):
        patience = None
    return Growth(**{**own, **{k: float(v) for k, v in given.items() if v is not None}}, max_depth=depth, patience=patience,
                  rounds=int(p.get("n_estimators", p.get("max_iter", p.get("iterations", 100)))),
                  seed=int(p.get("random_state", K.SEED)))


def _histogram_trees(learner: Learner, train: DataFrame, weight: str | None):
    return fit_boosted(train, learner.features, learner.label, learner.key, growth_of(learner.family, learner.params), weight)


def _gradient_boosting(learner: Learner, train: DataFrame, weight: str | None):
    """MLlib's GBT as a growth rule: half the log odds are added up, from targets of -1 and 1 in the first round and four times
    the gap to the probability in the others."""
    _refuse_unlabelled(train, learner.label)
    p = learner.params
    rate = float(p.get("learning_rate", 0.1))
    growth = Growth(rounds=int(p.get("n_estimators", 100)), learning_rate=4 * rate, first_rate=2.0, newton=False, link=2.0, base_score=0.5,
                    max_depth=_depth(p, 3), reg_lambda=0.0, min_rows=max(1, int(p.get("min_samples_leaf", 1))),
                    row_share=float(p.get("subsample", 1.0)), seed=int(p.get("random_state", K.SEED)))
    cuts = dict(zip(learner.features, share_cuts(train, learner.features, 64, weight)))
    return fit_boosted(train, learner.features, learner.label, learner.key, growth, weight, cuts)


def _forest(learner: Learner, train: DataFrame, weight: str | None):
    _refuse_unlabelled(train, learner.label)
    p = learner.params
    return fit_random_forest(
        train, learner.features, learner.label, learner.key, int(p.get("n_estimators", 100)), _depth(p, MAX_DEPTH),
        max(1, int(p.get("min_samples_leaf", 1))), p.get("max_features", "sqrt"), bool(p.get("bootstrap", True)), weight,
        int(p.get("random_state", K.SEED)))


def _extra_trees(learner: Learner, train: DataFrame, weight: str | None):
    p = learner.params
    depth = p.get("max_depth")
    return fit_extra_trees(
        train, learner.features, learner.label, learner.key, int(p.get("n_estimators", 100)), None if depth is None else int(depth),
        int(p.get("min_samples_leaf", 1)), int(p.get("min_samples_split", 2)), p.get("max_features", "sqrt"),
        bool(p.get("bootstrap", False)), weight, int(p.get("random_state", K.SEED)))


def _tree(learner: Learner, train: DataFrame, weight: str | None) -> VectorScore:
    p = learner.params
    estimator = DecisionTreeClassifier(
        maxDepth=_depth(p, MAX_DEPTH), minInstancesPerNode=max(1, int(p.get("min_samples_leaf", 1))),
        maxMemoryInMB=512, seed=int(p.get("random_state", K.SEED)))
    return _vector_fit(learner, train, weight, estimator)


def _logistic(learner: Learner, train: DataFrame, weight: str | None) -> VectorScore:
    p = learner.params
    total = train.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    mix = {"l1": 1.0, "l2": 0.0}.get(p.get("penalty"), float(p.get("l1_ratio", 0.5 if learner.family == "ENLR" else 0.0)))
    estimator = LogisticRegression(
        regParam=1.0 / (float(p.get("C", 1.0)) * float(total)), elasticNetParam=mix,
        standardization=False, maxIter=int(p.get("max_iter", 100)))
    return _vector_fit(learner, train, weight, estimator)


def _perceptron(learner: Learner, train: DataFrame, weight: str | None) -> VectorScore:
    p = learner.params
    layers = [len(learner.features), int(p.get("hidden", 100)), 2]
    estimator = MultilayerPerceptronClassifier(layers=layers, maxIter=int(p.get("max_iter", 200)), seed=int(p.get("random_state", K.SEED)))
    if train.count() * layers[1] <= MLLIB_CELLS:
        return _vector_fit(learner, train, None, estimator)
    # no step over two rows gives MLlib's first weights by the seed, and a model of given weights
    few = train.sparkSession.createDataFrame(
        [(*[0.0] * layers[0], y) for y in (0.0, 1.0)], ", ".join(f"`{c}` double" for c in (*learner.features, learner.label)))
    still = estimator.copy().setMaxIter(0)
    start = _vector_fit(learner, few, None, still).model.weights.toArray()
    found = fit_perceptron(train, learner.features, learner.label, layers[1], start, estimator.getMaxIter())
    return _vector_fit(learner, few, None, still.setInitialWeights(Vectors.dense(found)))


def _adaboost(learner: Learner, train: DataFrame, weight: str | None):
    _refuse_unlabelled(train, learner.label)
    p = learner.params
    return fit_adaboost(train, learner.features, learner.label, int(p.get("n_estimators", 50)),
                        float(p.get("learning_rate", 1.0)), weight, int(p.get("random_state", K.SEED)))


def _ridge(learner: Learner, train: DataFrame, weight: str | None):
    return fit_calibrated_ridge(train, learner.features, learner.label, float(learner.params.get("alpha", 1.0)),
                                weight, learner.key)


def _discriminant(learner: Learner, train: DataFrame, weight: str | None):
    return fit_discriminant(train, learner.features, learner.label)


def _naive_bayes(learner: Learner, train: DataFrame, weight: str | None) -> KeyedScore:
    p, rows = learner.params, train.withColumn("_fold", F.lit(0))
    if learner.family == "GNB":
        model = fit_gaussian_nb(rows, learner.features, {0: float(p.get("var_smoothing", 1e-9))}, "_fold", learner.label)
    else:
        model = fit_bernoulli_nb(
            rows, learner.features, {0: (float(p.get("alpha", 1.0)), float(p.get("binarize", 0.0)))}, "_fold", learner.label)
    unseen = lambda df: df.withColumn("_fold", F.lit(None).cast("int"))
    return KeyedScore(lambda df: model.score(unseen(df), "_fold").drop("_fold", "trial_id"))


def _neighbors(learner: Learner, train: DataFrame, weight: str | None) -> KeyedScore:
    p = learner.params
    k, weights, power = int(p.get("n_neighbors", 5)), p.get("weights", "uniform"), int(p.get("p", 2))

    def rule(df: DataFrame) -> DataFrame:
        near = knn_join(df, train, learner.features, k, learner.key, None, power, [learner.label])
        return df.join(neighbor_vote(near, k, weights, learner.key, learner.label), learner.key)

    return KeyedScore(rule)


FITTERS: dict[str, Callable] = {
    "XGBoost": _histogram_trees, "LightGBM": _histogram_trees, "HGB": _histogram_trees,
    "CatBoost": _histogram_trees, "GBC": _gradient_boosting, "AdaBoost": _adaboost, "RF": _forest,
    "ET": _extra_trees, "DT": _tree, "LR": _logistic, "ENLR": _logistic, "MLP": _perceptron,
    "Ridge": _ridge, "LDA": _discriminant, "GNB": _naive_bayes, "BNB": _naive_bayes, "KNN": _neighbors,
}

# The parameters each family has a counterpart for.
USED_PARAMS = {
    "XGBoost": ("n_estimators", "learning_rate", "max_depth", "gamma", "subsample", "colsample_bytree",
                "min_child_weight", "reg_lambda", "reg_alpha", "early_stopping_rounds", "random_state"),
    "LightGBM": ("n_estimators", "learning_rate", "max_depth", "num_leaves", "min_child_samples", "lambda_l1", "lambda_l2",
                 "feature_fraction", "bagging_fraction", "early_stopping_rounds", "random_state"),
    "HGB": ("max_iter", "learning_rate", "max_depth", "min_samples_leaf", "l2_regularization", "early_stopping",
            "early_stopping_rounds", "random_state"),
    "CatBoost": ("iterations", "learning_rate", "depth", "l2_leaf_reg", "early_stopping_rounds", "random_state"),
    "GBC": ("n_estimators", "learning_rate", "max_depth", "subsample", "min_samples_leaf", "random_state"),
    "AdaBoost": ("n_estimators", "learning_rate", "random_state"),
    "RF": ("n_estimators", "max_depth", "min_samples_leaf", "max_features", "bootstrap", "random_state"),
    "ET": ("n_estimators", "max_depth", "min_samples_leaf", "min_samples_split", "max_features", "bootstrap", "random_state"),
    "DT": ("max_depth", "min_samples_leaf", "random_state"),
    "LR": ("C", "penalty", "l1_ratio", "max_iter", "random_state"),
    "ENLR": ("C", "l1_ratio", "max_iter", "random_state"),
    "MLP": ("hidden", "max_iter", "random_state"),
    "Ridge": ("alpha",),
    "LDA": (),
    "GNB": ("var_smoothing",),
    "BNB": ("alpha", "binarize"),
    "KNN": ("n_neighbors", "weights", "p"),
}


def native_importance(model, df: DataFrame, model_id: str) -> DataFrame:
    """Impurity or |coefficient| importances of a fitted model as rows (model_id, feature, importance)."""
    rows = [(model_id, f, v) for f, v in model.importances().items()]
    return df.sparkSession.createDataFrame(rows, "model_id string, feature string, importance double")
