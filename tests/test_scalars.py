import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators.dynamics import motivation

CELLS = [
    # name, cell, strict, lenient
    ("max_depth", "None", None, None), ("max_depth", "nan", None, None), ("max_depth", "7.9", 7, 7),
    ("max_depth", "-1.0", -1, -1), ("max_depth", "abc", None, "abc"), ("bootstrap", "TRUE", True, True),
    ("bootstrap", "no", False, False), ("bootstrap", "0.0", False, False), ("bootstrap", "abc", None, "abc"),
    ("learning_rate", "0.1", 0.1, 0.1), ("learning_rate", "x", None, "x"), ("C", "2", "2", 2.0),
    ("random_state", "3.0", "3.0", 3), ("criterion", "gini", "gini", "gini"), ("n_estimators", None, None, None),
]


@pytest.mark.parametrize("lenient", [False, True])
def test_decode_param(spark, lenient):
    rows = [(i, n, c) for i, (n, c, *_) in enumerate(CELLS)]
    df = spark.createDataFrame(rows, "i int, name string, cell string")
    got = df.withColumn("v", scalars.decode_param("name", "cell", lenient)).orderBy("i").collect()
    pick = {"int": "i", "float": "d", "bool": "b", "str": "s"}
    values = [None if r["v"] is None else r["v"][pick[r["v"]["kind"]]] for r in got]
    wanted = [row[3 if lenient else 2] for row in CELLS]
    assert values == wanted and [type(v) for v in values] == [type(w) for w in wanted]


def test_losses_match_numpy(spark):
    z, y = np.array([-40.0, -1.0, 0.0, 2.5, 700.0]), np.array([0, 1, 0, 1, 0])
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(z, y))], "i int, z double, y int")
    got = df.select("i", scalars.bce_with_logits("z", "y").alias("b"), scalars.focal_loss("z", "y").alias("f")).orderBy("i").collect()
    bce = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    focal = (0.75 * y + 0.25 * (1 - y)) * (1 - np.exp(-bce)) ** 2 * bce
    assert np.allclose([r["b"] for r in got], bce) and np.allclose([r["f"] for r in got], focal)


def test_decision_is_strict_and_rejects_nan(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5000001), (2, float("nan"))], "i int, p double")
    assert [r["d"] for r in df.select("i", scalars.hard_decision("p", 0.5).alias("d")).orderBy("i").collect()] == [0, 1, None]


def test_names_maps_and_motivation(spark):
    df = spark.createDataFrame([("LightGBM2", {"a": "1", "b": "2"}, {"b": "3"})], "m string, f map<string,string>, t map<string,string>")
    row = df.select(
        scalars.base_name("m").alias("n"), scalars.matches_keyword("m", "lightgbm").alias("k"),
        scalars.merge_params("f", "t").alias("p"),
        motivation(F.lit(0.5), F.lit(4.0), F.lit(1.0), F.lit(3.0)).alias("v")).first()
    assert (row["n"], row["k"], row["p"], row["v"]) == ("LightGBM", True, {"a": "1", "b": "3"}, 0.5)


def test_grids():
    assert len(scalars.BASE_GRID) == 200 and scalars.BASE_GRID[-1] == 0.99
    assert len(scalars.DENSE_LOW_GRID) == 300 and scalars.DENSE_LOW_GRID[199:201] == [0.4, 0.41]
