import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortlens.operators import learners, perceptron
from cohortlens.operators.learners import make_learner

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """1,000 rows in three files, so that the last blocks of partitions are short."""
    rng = np.random.default_rng(5)
    y = (rng.random(1000) < 0.3).astype(int)
    frame = pd.DataFrame({"entity_id": np.arange(1000), "label": y, "a": rng.normal(size=1000) + y, "b": rng.normal(size=1000) * 2,
                          "c": rng.normal(size=1000) - 0.5 * y})
    path = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame(frame).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(autouse=True)
def many(monkeypatch):
    """A thousand rows are many."""
    monkeypatch.setattr(learners, "MLLIB_CELLS", 0)


def weights(rows, hidden, max_iter):
    return make_learner("MLP", {"hidden": hidden, "max_iter": max_iter}, FEATURES).fit(rows).model.weights.toArray()


@pytest.mark.parametrize("hidden,max_iter", [(7, 0), (7, 1), (7, 20), (150, 8)])
def test_weights_are_those_of_mllib(rows, monkeypatch, hidden, max_iter):
    monkeypatch.setattr(perceptron, "DIRECT_NUMBERS", 1 << 21 if hidden < 100 else 0)  # the driver adds up, or tasks do
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
    theirs = MultilayerPerceptronClassifier(layers=[3, hidden, 2], maxIter=max_iter, seed=42, featuresCol="_x", labelCol="label").fit(vectors)
    assert np.allclose(weights(rows, hidden, max_iter), theirs.weights.toArray(), rtol=0, atol=1e-9)


def test_many_rows_are_not_given_to_mllib(rows, monkeypatch):
    seen, fit = [], MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    large = weights(rows, 4, 3)
    assert seen == [2, 2]
    monkeypatch.setattr(learners, "MLLIB_CELLS", 4000)
    assert np.allclose(weights(rows, 4, 3), large) and seen == [2, 2, 1000]


def test_gradient_is_the_slope_of_the_loss(rows):
    d, hidden = 3, 6
    records = perceptron._packed(rows, FEATURES, "label", 2).collect()
    at = lambda theta: perceptron._objective(perceptron._sums(records, theta, d, hidden), theta, d, hidden)
    theta = np.random.default_rng(1).normal(size=(d + 1) * hidden + 2 * (hidden + 1))
    slopes = [(at(theta + step)[0] - at(theta - step)[0]) / 2e-6 for step in 1e-6 * np.eye(len(theta))]
    assert np.allclose(at(theta)[1], slopes, atol=1e-8)


def test_a_block_counts_as_the_mean_of_its_rows(rows):
    d, hidden, theta = 3, 4, np.random.default_rng(2).normal(size=26)
    packed = perceptron._packed(rows.coalesce(1), FEATURES, "label", 1).collect()
    assert [(len(y), block) for _, y, block in packed] == [(896, 128), (104, 104)]
    value, _ = perceptron._objective(perceptron._sums(packed, theta, d, hidden), theta, d, hidden)
    frame = rows.coalesce(1).toPandas()
    into, out, bias = perceptron._layers(theta, d, hidden)
    margin = 1 / (1 + np.exp(-(frame[FEATURES].to_numpy() @ into[:, :d].T + into[:, d]))) @ out + bias
    loss = np.logaddexp(0, np.where(frame.label == 1, -margin, margin))
    assert value == pytest.approx(np.mean([loss[i:i + 128].mean() for i in range(0, 1000, 128)]))


def test_search_finds_a_narrow_valley_and_gives_up_where_there_is_nothing():
    def valley(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2 + 1, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert np.allclose(perceptron.minimise(valley, np.array([-1.2, 1.0]), 200, 1e-12), [1, 1], atol=1e-5)
    start = np.array([3.0, 4.0])
    assert np.array_equal(perceptron.minimise(lambda x: (np.nan, np.full(2, np.nan)), start, 200), start)


@pytest.mark.parametrize("column,value,said", [("a", None, "miss a value"), ("b", float("inf"), "infinite"), ("label", None, "label is missing"), ("label", 2, "neither 0 nor 1")])
def test_odd_rows_are_refused(rows, column, value, said):
    odd = rows.withColumn(column, F.when(F.col("entity_id") == 9, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(Exception, match=said):
        weights(odd, 4, 5)


def test_no_rows_are_refused(rows):
    with pytest.raises(ValueError, match="no training rows"):
        perceptron.fit_perceptron(rows.where("entity_id < 0"), FEATURES, "label", 4, np.zeros(26), 5)
