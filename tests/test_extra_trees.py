"""Extremely randomised trees against plain recursion with the same draws."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import attribution, extra_trees
from cohortlens.operators.extra_trees import _uniform, fit_extra_trees, fit_random_forest

FEATURES = ["a", "b", "c"]


def slow(x, y, w, seed, tree, k, max_depth, min_leaf, min_split):
    """Score of every row under one tree."""
    out = np.zeros(len(y))

    def gini(rows):
        p = (w[rows] * y[rows]).sum()
        total = w[rows].sum()
        return (p**2 + (total - p) ** 2) / total

    def grow(rows, path):
        p = (w[rows] * y[rows]).sum() / w[rows].sum()
        best = None
        if len(path) < max_depth and len(rows) >= max(min_split, 2 * min_leaf) and 0 < p < 1:
            picked = sorted(range(3), key=lambda f: md5(f"{seed}:pick:{tree}:{path}:{FEATURES[f]}".encode()).digest())[:k]
            for f in sorted(picked):
                v = x[rows, f]
                lo, hi = np.nanmin(v), np.nanmax(v)
                cut = lo + _uniform(seed, tree, path, FEATURES[f]) * (hi - lo)
                left, right = rows[v <= cut], rows[~(v <= cut)]
                if lo < hi and min(len(left), len(right)) >= min_leaf:
                    gain = gini(left) + gini(right) - gini(rows)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, left, right)
        if best is None:
            out[rows] = p
        else:
            grow(best[1], path + "L")
            grow(best[2], path + "R")

    grow(np.arange(len(y)), "")
    return out


@pytest.mark.parametrize("k,depth,leaf,split", [(1, 4, 2, 2), (2, 6, 5, 15), (3, 3, 1, 2)])
def test_scores_equal_plain_recursion(spark, k, depth, leaf, split, monkeypatch):
    monkeypatch.setattr(extra_trees, "PASS_CELLS", 10)
    rng = np.random.default_rng(4)
    n = 300
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    x[rng.random((n, 3)) < 0.05] = np.nan
    w = np.where(y == 1, 2.5, 0.5)
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in x[i]), int(y[i]), float(w[i])) for i in range(n)],
                               "entity_id long, a double, b double, c double, label int, w double").repartition(3)
    model = fit_extra_trees(df, FEATURES, n_trees=4, max_depth=depth, min_leaf=leaf, min_split=split, max_features=k / 3 + 1e-6, weight="w", seed=9)
    got = {r["entity_id"]: r["p"] for r in model.score(df).collect()}
    want = np.mean([slow(x, y, w, 9, t, k, depth, leaf, split) for t in range(4)], axis=0)
    assert np.allclose([got[i] for i in range(n)], want)
    again = fit_extra_trees(df.repartition(1), FEATURES, n_trees=4, max_depth=depth, min_leaf=leaf, min_split=split, max_features=k / 3 + 1e-6, weight="w", seed=9)
    assert all(np.array_equal(a.cut, b.cut) and np.array_equal(a.value, b.value) for a, b in zip(model.trees, again.trees))
    start = attribution.expected_value(model.paths())
    phi = attribution.tree_attribution(df.dropna(), model, FEATURES).groupBy("entity_id").agg(F.sum("phi").alias("s")).collect()
    assert all(abs(r["s"] + start - got[r["entity_id"]]) < 1e-9 for r in phi)


def test_bootstrap_trees_differ_and_repeat(cohort):
    fit = lambda rows: fit_extra_trees(rows, FEATURES, n_trees=2, max_depth=2, max_features=None, bootstrap=True)
    first, again = fit(cohort), fit(cohort.repartition(7))
    assert first.trees[0].rows[0] != first.trees[1].rows[0] and 0.5 < first.trees[0].rows[0] / cohort.count() < 0.75
    assert all(np.array_equal(a.cut, b.cut) and np.array_equal(a.rows, b.rows) for a, b in zip(first.trees, again.trees))
    with pytest.raises(ValueError, match="no training rows"):
        fit(cohort.limit(0))


def same_trees(first, second):
    return all(np.array_equal(a.cut, b.cut) and np.array_equal(a.value, b.value) and np.array_equal(a.rows, b.rows)
               for a, b in zip(first.trees, second.trees, strict=True))


def test_equal_rows_are_one_row_and_trees_grow_in_tasks(cohort, monkeypatch):
    rows = cohort.withColumns({c: F.round(c) for c in FEATURES})
    rows = rows.unionByName(rows.withColumn("entity_id", F.col("entity_id") + 1000))
    held, kept = [], extra_trees._grown_in_tasks
    monkeypatch.setattr(extra_trees, "_grown_in_tasks", lambda table, *args: held.append(table.agg(F.sum(F.length("n"))).first()[0] // 8) or kept(table, *args))
    fit = lambda: fit_extra_trees(rows, FEATURES, n_trees=5, max_depth=4, max_features=None)
    forest = lambda: fit_random_forest(rows, FEATURES, n_trees=5, max_depth=4, bootstrap=False)
    first, second = fit(), forest()
    assert first.trees[0].rows[0] == 1600 and held[0] == rows.select("label", *FEATURES).distinct().count() < 1600
    monkeypatch.setattr(extra_trees, "TASK_BYTES", -1)
    assert same_trees(first, fit()) and same_trees(second, forest()) and len(held) == 2


def test_a_forest_of_one_whole_tree_is_the_tree_of_mllib(cohort):
    from pyspark.ml.classification import DecisionTreeClassifier

    from cohortlens.operators.learners import Learner, _vector_fit
    weighted = cohort.withColumn("w", F.when(F.col("label") == 1, 2.5).otherwise(0.5))
    got = fit_random_forest(weighted, FEATURES, n_trees=1, max_depth=5, min_leaf=3, max_features="all", bootstrap=False, weight="w")
    want = _vector_fit(Learner("DT", {}, FEATURES), weighted, "w", DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=3))
    scores = [model.score(weighted).select("entity_id", "p").toPandas().sort_values("entity_id").p.to_numpy() for model in (got, want)]
    assert np.allclose(*scores, atol=1e-9) and np.ptp(scores[0]) > 0.5


def test_random_forest_draws_rows_alike_in_any_order(cohort):
    rows = cohort.withColumns({c: F.round(c) for c in FEATURES})
    fit = lambda df: fit_random_forest(df, FEATURES, n_trees=3, max_depth=6)
    first = fit(rows)
    assert same_trees(first, fit(rows.repartition(5))) and first.trees[0].rows[0] != first.trees[1].rows[0]
    assert 700 < first.trees[0].rows[0] < 900  # 800 rows, drawn about once each
    with pytest.raises(ValueError, match="1 rows miss a value"):
        fit(rows.withColumn("a", F.when(F.col("entity_id") > 0, F.col("a"))))
