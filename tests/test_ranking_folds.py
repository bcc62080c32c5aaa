import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlens.operators import folds, ranking
from cohortlens.operators.joins import attach, _salted


def md5(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def skewed(spark, n=3000):
    """A third of the rows share one group and one value."""
    rng = np.random.default_rng(0)
    g = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 6, n))
    v = np.where(rng.random(n) < 1 / 3, 7.0, np.round(rng.normal(size=n) * 10, 1))
    frame = pd.DataFrame({"k": np.arange(n), "g": g, "v": v})
    return frame, spark.createDataFrame(frame)


def test_hash_rank_is_the_group_order_of_md5(spark):
    frame, df = skewed(spark)
    got = ranking.hash_rank(df, ["g"], "k").toPandas().set_index("k")
    frame["h"] = [md5(k) for k in frame.k]
    want = frame.sort_values(["h", "k"]).groupby("g").cumcount()
    assert (got["rank"].reindex(frame.k).to_numpy() == want.sort_index().to_numpy()).all()
    assert (got["group_rows"] == got.groupby("g")["v"].transform("size")).all()


def test_hash_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "k int, g int")
    got = ranking.hash_rank(df, ["g"], "k").collect()
    assert sorted(r["rank"] for r in got if r["g"] is None) == [0, 1]


def test_ranks_within_a_hot_group(spark):
    frame, df = skewed(spark)
    cuts = ranking.range_cuts(df, "v", 16)
    assert 7.0 in cuts
    got = ranking.ranks_within(df.withColumn("w", F.lit(1)), ["g"], "v", "w", "k", cuts).toPandas().set_index("k")
    want = frame.groupby("g")["v"].rank(method="min") - 1
    assert (got["before"].reindex(frame.k).to_numpy() == want.to_numpy()).all()
    assert (got["all"].reindex(frame.k).to_numpy() == frame.groupby("g")["v"].transform("size").to_numpy()).all()


def test_exact_median(spark):
    frame, df = skewed(spark)
    got = ranking.exact_median(df, ["g"], "v").toPandas().set_index("g")["median"]
    assert got.sort_index().equals(frame.groupby("g")["v"].median().rename("median"))
    gaps = spark.createDataFrame([(None,), (1.0,), (5.0,)], "v double")
    assert ranking.exact_median(gaps, [], "v").first()["median"] == 3.0


def test_order_positions_with_many_equal_values(spark):
    frame, df = skewed(spark)
    got = ranking.order_positions(df, "v", "k", cuts=ranking.range_cuts(df, "v", 16)).toPandas().set_index("k")
    frame["h"] = [md5(k) for k in frame.k]
    want = frame.sort_values(["v", "h", "k"]).k.tolist()
    assert got.sort_values("position").index.tolist() == want
    assert set(got["n_rows"]) == {len(frame)}


def test_attach_small_and_salted_agree(spark):
    frame, df = skewed(spark)
    table = df.groupBy("g").agg(F.sum("v").alias("s"))
    small = attach(df, table, ["g"], ["k"]).toPandas().sort_values("k").reset_index(drop=True)
    large = _salted(df, table, ["g"], ["k"]).toPandas()[small.columns].sort_values("k").reset_index(drop=True)
    forced = attach(df, table, ["g"], ["k"], max_rows=2).toPandas()[small.columns].sort_values("k").reset_index(drop=True)
    assert np.allclose(small, large) and np.allclose(small, forced) and len(small) == len(frame)


def test_folds_halve_every_cohort_and_class(cohort):
    source = cohort.where("cohort < 2023")
    got = folds.assign_folds(source, [2019, 2020, 2021, 2022]).toPandas()
    assert sorted(got.fold.unique()) == [2, 3, 4, 5, 6, 7]  # 2019 is absent, its folds stay reserved
    halves = got.groupby(["cohort", "label", "fold"]).size().groupby(level=[0, 1]).agg(["min", "max"])
    assert (halves["max"] - halves["min"] <= 1).all()
    again = folds.assign_folds(source.repartition(7), [2019, 2020, 2021, 2022]).toPandas()
    assert got.set_index("entity_id").fold.sort_index().equals(again.set_index("entity_id").fold.sort_index())


def test_one_positive_cannot_be_halved(spark):
    df = spark.createDataFrame([(i, 2020, int(i == 0)) for i in range(9)], "entity_id int, cohort int, label int")
    got = folds.assign_folds(df, [2020]).groupBy("label", "fold").count().collect()
    assert sorted((r["label"], r["fold"], r["count"]) for r in got) == [(0, 0, 4), (0, 1, 4), (1, 0, 1)]


def test_stratified_holdout_and_sample(cohort):
    kfold = folds.stratified_folds(cohort, 10).groupBy("label", "fold").count().toPandas()
    spread = kfold.groupby("label")["count"].agg(["min", "max"])
    assert (spread["max"] - spread["min"] <= 1).all()
    parts = folds.holdout_split(cohort).toPandas()
    n = parts.groupby("label").size()
    assert (parts[parts.part == "valid"].groupby("label").size() == np.floor(n * 0.2 + 0.5)).all()
    assert folds.sample_rows(cohort, 50).count() == 50


def test_time_series_folds(cohort):
    got = folds.time_series_folds(cohort, "a", 7).toPandas().sort_values("a")
    sizes = got.groupby("fold").size()
    assert sizes[0] == 100 and sizes[-1] == 100 and len(sizes) == 8
    assert (np.diff(got.fold) >= 0).all()


def test_unlisted_cohorts_are_one_group_without_a_fold(spark):
    from cohortlens.operators.folds import assign_folds

    rows = spark.range(3000).selectExpr("id AS entity_id", "CAST(id % 1500 AS int) AS cohort", "CAST(id % 3 = 0 AS int) AS label")
    folded = assign_folds(rows, [7, 8])
    assert folded.columns == ["entity_id", "cohort", "label", "fold"]
    assert {(r["cohort"], r["fold"]) for r in folded.where("fold IS NOT NULL").collect()} <= {(7, 0), (7, 1), (8, 2), (8, 3)}
    assert folded.where("fold IS NOT NULL").count() == 4 and folded.count() == 3000
