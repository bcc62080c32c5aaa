"""Boosted histogram trees against a slow, independent booster."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import histogram_trees as ht
from cohortlens.operators.histogram_trees import BoostedTrees, Growth, fit_boosted, quantile_cuts
from cohortlens.operators.learners import growth_of, make_learner

FEATURES = ["a", "b", "c"]


@pytest.fixture(autouse=True)
def by_passes(monkeypatch):
    """Few rows as they are, the tests hold the passes that a large table takes; one compares both ways."""
    monkeypatch.setattr(ht, "ONE_TASK_BYTES", 0)


def soft(g, alpha):
    return math.copysign(max(abs(g) - alpha, 0.0), g)


class Slow:
    """Plain recursion over row sets, all splits tried one by one."""

    def __init__(self, x, y, w, cuts, growth):
        self.x, self.y, self.w, self.cuts, self.growth = x, y, w, cuts, growth
        p = np.sum(w * y) / np.sum(w) if growth.base_score is None else growth.base_score
        self.margin = np.full(len(y), math.log(p / (1 - p)))

    def worth(self, rows):
        g, h = self.g[rows].sum(), self.h[rows].sum()
        return soft(g, self.growth.reg_alpha) ** 2 / (h + self.growth.reg_lambda) if h + self.growth.reg_lambda > 0 else 0.0

    def best(self, rows, every=None):
        """(gain, feature, cut, missing left); with ``every`` the sum over these row sets."""
        found = (-np.inf,)
        for f, cuts in enumerate(self.cuts):
            for cut in cuts:
                for missing_left in (False, True):
                    total, able = 0.0, False
                    for part in every or [rows]:
                        left, right = self.split(part, f, cut, missing_left)
                        g = self.growth
                        if min(len(left), len(right)) < max(1, g.min_rows) or min(self.h[left].sum(), self.h[right].sum()) < g.min_hessian:
                            continue
                        able = True
                        total += self.worth(left) + self.worth(right) - self.worth(part)
                    if able and total > found[0] + 1e-9:
                        found = (total, f, cut, missing_left)
        return found if found[0] > self.growth.min_gain else None

    def split(self, rows, f, cut, missing_left):
        v = self.x[rows, f]
        left = np.where(np.isnan(v), missing_left, v <= cut)
        return rows[left], rows[~left]

    def leaves(self):
        growth, root = self.growth, np.arange(len(self.y))
        if growth.shape == "symmetric":
            parts = [root]
            for _ in range(growth.max_depth):
                cut = self.best(None, [p for p in parts if len(p)])
                if cut is None:
                    break
                out = []
                for part in parts:  # a part that cannot be split stays as it is
                    left, right = self.split(part, *cut[1:])
                    out += [left, right] if len(left) and len(right) else [part]
                parts = out
            return parts
        done, open_ = [], [(root, 0, self.best(root))]
        while open_:
            if growth.shape == "leaf":
                open_.sort(key=lambda n: -(n[2][0] if n[2] else -np.inf))
            rows, depth, cut = open_.pop(0)
            if cut is None or depth >= (growth.max_depth or 99) or (growth.max_leaves and len(done) + len(open_) + 1 >= growth.max_leaves):
                done.append(rows)
                continue
            for part in self.split(rows, *cut[1:]):
                open_.append((part, depth + 1, self.best(part)))
        return done

    def round(self):
        p = 1 / (1 + np.exp(-self.margin))
        self.g, self.h = self.w * (p - self.y), self.w * p * (1 - p)
        for rows in self.leaves():
            total = self.h[rows].sum() + self.growth.reg_lambda
            self.margin[rows] -= self.growth.learning_rate * soft(self.g[rows].sum(), self.growth.reg_alpha) / total if total > 0 else 0.0


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] * x[:, 2])))).astype(int)
    x[rng.random((n, 3)) < 0.1] = np.nan
    w = np.where(y == 1, 1.7, 0.6)
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), int(y[i]), float(w[i])) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id long, a double, b double, c double, label int, w double").repartition(3), x, y, w


@pytest.mark.parametrize("growth", [
    Growth(rounds=4, max_depth=3, learning_rate=0.5), Growth(rounds=3, max_depth=4, reg_lambda=0.3, reg_alpha=1.5, min_hessian=2.0, min_gain=0.4),
    Growth(rounds=3, shape="leaf", max_depth=None, max_leaves=7, reg_lambda=0.1, min_rows=12),
    Growth(rounds=2, shape="leaf", max_depth=3, max_leaves=31, reg_lambda=0.1, min_rows=5),
    Growth(rounds=3, shape="symmetric", max_depth=3, reg_lambda=3.0, learning_rate=0.8), Growth(rounds=2, max_depth=2, base_score=0.5)])
@pytest.mark.parametrize("weight", [None, "w"])
def test_scores_equal_the_slow_booster(frame, growth, weight):
    df, x, y, w = frame
    cuts = {f: np.unique(x[:, i][~np.isnan(x[:, i])])[::4] for i, f in enumerate(FEATURES)}
    slow = Slow(x, y.astype(float), w if weight else np.ones(len(y)), [cuts[f] for f in FEATURES], growth)
    for _ in range(growth.rounds):
        slow.round()
    model = fit_boosted(df, FEATURES, growth=growth, weight=weight, cuts=cuts)
    got = {r["entity_id"]: r["p"] for r in model.score(df).select("entity_id", "p").collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-slow.margin)), atol=1e-7)
    assert abs(sum(model.importances().values()) - 1) < 1e-9


def same(a: BoostedTrees, b: BoostedTrees) -> bool:
    return len(a.trees) == len(b.trees) and all(
        np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and np.array_equal(s.value, t.value) for s, t in zip(a.trees, b.trees))


def test_partitions_passes_and_stagings_change_nothing(frame, monkeypatch):
    df, growth = frame[0], Growth(rounds=6, max_depth=3, row_share=0.7, feature_share=0.7, patience=50)
    model = fit_boosted(df, FEATURES, growth=growth)
    monkeypatch.setattr(ht, "STAGE_EVERY", 2)
    monkeypatch.setattr(ht, "PASS_CELLS", 1)
    monkeypatch.setattr(ht, "DIRECT_CELLS", 0)
    assert same(model, fit_boosted(df.repartition(1), FEATURES, growth=growth))
    assert not same(model, fit_boosted(df, FEATURES, growth=Growth(rounds=6, max_depth=3, row_share=0.7, feature_share=0.7, patience=50, seed=1)))


@pytest.mark.parametrize("shape", ["level", "leaf", "symmetric"])
@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_rows_that_no_split_tells_apart_are_one(spark, monkeypatch, shape, one_task):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (3000, 3)).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] * x[:, 2] / 2)))).astype(int)
    x[rng.random((3000, 3)) < 0.1] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), int(t), 1.7 if t else 0.6) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "entity_id long, a double, b double, c double, label int, w double").repartition(3)
    growth = Growth(rounds=8, max_depth=4, max_leaves=9, shape=shape, learning_rate=0.5, patience=5)
    packed, bin_rows = [], ht._bin_rows
    monkeypatch.setattr(ht, "ONE_TASK_BYTES", one_task)
    monkeypatch.setattr(ht, "_bin_rows", lambda *a: packed.append(bin_rows(*a)) or packed[-1])
    model = fit_boosted(df, FEATURES, growth=growth, weight="w")
    assert packed[0].n_rows < 500
    monkeypatch.setattr(ht.math, "prod", lambda _: 1 << 30)
    plain = fit_boosted(df, FEATURES, growth=growth, weight="w")
    assert packed[1].n_rows == 3000
    assert same(model, plain) and model.losses == plain.losses and model.base == plain.base
    assert all(np.array_equal(s.rows, t.rows) and np.array_equal(s.hessian, t.hessian) for s, t in zip(model.trees, plain.trees))


@pytest.mark.parametrize("shape", ["level", "leaf", "symmetric"])
@pytest.mark.parametrize("patience", [None, 3])
def test_one_task_grows_the_same_trees(frame, monkeypatch, shape, patience):
    df = frame[0]
    growth = Growth(rounds=12, max_depth=5, max_leaves=9, shape=shape, learning_rate=0.6, row_share=0.8, feature_share=0.7, patience=patience)
    monkeypatch.setattr(ht, "STAGE_EVERY", 5)
    model = fit_boosted(df, FEATURES, growth=growth, weight="w")
    monkeypatch.setattr(ht, "ONE_TASK_BYTES", 1 << 20)
    one = fit_boosted(df, FEATURES, growth=growth, weight="w")
    assert same(model, one) and model.losses == one.losses and model.base == one.base
    assert (len(one.losses) > 0) == (patience is not None) and len(one.trees) > 0


@pytest.mark.parametrize("shape", ["level", "leaf", "symmetric"])
def test_patience_keeps_the_best_round(frame, shape):
    df = frame[0]
    growth = Growth(rounds=40, max_depth=6, max_leaves=31, shape=shape, learning_rate=0.9, reg_lambda=0.1, patience=3)
    model = fit_boosted(df, FEATURES, growth=growth)
    best = int(np.argmin(model.losses))
    assert len(model.trees) == best and best + 3 == len(model.losses) - 1 < 40  # the best round lies before the last
    whole = fit_boosted(df, FEATURES, growth=Growth(rounds=best, max_depth=6, max_leaves=31, shape=shape, learning_rate=0.9, reg_lambda=0.1, patience=99))
    assert same(model, whole) and whole.losses[-1] == model.losses[best]


def test_held_out_rows_do_not_train(frame):
    df = frame[0]
    growth = Growth(rounds=1, max_depth=1, patience=5)
    model = fit_boosted(df, FEATURES, growth=growth)
    held = df.where(F.shiftright(F.xxhash64(F.lit(growth.seed), "entity_id"), 32) + 2**31 < int(ht.VALIDATION_SHARE * 2**32))
    assert 0 < held.count() < 100 and model.trees[0].rows[0] == df.count() - held.count()


def test_one_class_no_rows_and_absent_features_are_errors(frame):
    df = frame[0]
    with pytest.raises(ValueError, match="one class"):
        fit_boosted(df.where("label = 0"), FEATURES)
    with pytest.raises(ValueError, match="no training rows"):
        fit_boosted(df.limit(0), FEATURES)
    model = fit_boosted(df, FEATURES, growth=Growth(rounds=1, max_depth=1))
    with pytest.raises(ValueError, match="'b'"):
        model.score(df.drop("b"))
    with pytest.raises(ValueError, match="'c'"):
        model.score(df.withColumn("c", F.lit("x")))


def test_families_differ_in_growth():
    xgb, lgb = growth_of("XGBoost", {"reg_alpha": 2, "reg_lambda": 5, "gamma": 1}), growth_of("LightGBM", {"num_leaves": 9, "max_depth": -1, "lambda_l1": 0.5})
    assert (xgb.shape, xgb.reg_alpha, xgb.reg_lambda, xgb.min_gain, xgb.max_depth, xgb.patience) == ("level", 2, 5, 1, 6, 300)
    assert (lgb.shape, lgb.max_leaves, lgb.max_depth, lgb.reg_alpha, lgb.reg_lambda, lgb.min_rows) == ("leaf", 9, None, 0.5, 0, 20)
    hgb = growth_of("HGB", {"max_iter": 50, "l2_regularization": 1.5, "early_stopping": True})
    assert (hgb.rounds, hgb.reg_lambda, hgb.patience, growth_of("HGB", {}).patience) == (50, 1.5, 10, None)
    assert growth_of("CatBoost", {"iterations": 7, "depth": 4}) == Growth(rounds=7, shape="symmetric", max_depth=4, reg_lambda=3.0, learning_rate=0.03, patience=20)
    assert make_learner("XGBoost", {"reg_lambda": 1.0, "tree_method": "hist"}, FEATURES).dropped == ("tree_method",)


def test_few_splits_are_one_lookup_and_slopes_are_computed_once_a_round(frame, monkeypatch):
    df, rng = frame[0], np.random.default_rng(8)
    calls, slopes = [], ht._slopes
    growth = Growth(rounds=6, max_depth=5, shape="symmetric", learning_rate=0.5, min_rows=8, patience=50)
    packed, bin_rows = [], ht._bin_rows
    monkeypatch.setattr(ht, "_bin_rows", lambda *a: packed.append(bin_rows(*a)) or packed[-1])
    monkeypatch.setattr(ht, "unstage", lambda _: None)
    model = fit_boosted(df, FEATURES, growth=growth, weight="w")
    monkeypatch.setattr(ht, "_slopes", lambda *a: calls.append(1) or slopes(*a))
    trees, losses = ht._boost(packed[0], growth, ht._Held(packed[0], [tuple(r) for r in packed[0].table.collect()]))
    assert tuple(losses) == model.losses and len(calls) == growth.rounds + 1  # a question per level before
    x = rng.normal(size=(500, 3))
    x[rng.random((500, 3)) < 0.2] = np.nan
    x[::50, 1] = -np.inf
    for tree in model.trees:
        assert len(tree.outcomes[0]) <= 5
        walked = tree.leaf(x, tree.cut, ~np.isfinite(x), np.zeros(len(x), np.int64))
        assert np.array_equal(tree.leaf(x, tree.cut, ~np.isfinite(x)), walked)
    assert fit_boosted(df, FEATURES, growth=Growth(rounds=1, max_depth=8), weight="w").trees[0].outcomes is None
