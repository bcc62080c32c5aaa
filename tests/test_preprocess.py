import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import preprocess as P


@pytest.fixture(scope="module")
def gaps(folded):
    return folded.withColumns({
        "b": F.when(F.col("entity_id") % 5 != 0, F.col("b")), "const": F.lit(4.0), "empty": F.lit(None).cast("double")})


def test_training_statistics_equal_recomputation(gaps):
    frame = gaps.toPandas()
    got = P.fold_moments(gaps, ["a", "b"], label="label")
    for left_out in [*range(6), P.FULL]:
        rows = frame[frame.fold.notna() & (frame.fold != left_out)]
        for y in (0, 1):
            for f in ("a", "b"):
                x = rows[rows.label == y][f]
                m = got[left_out][(y, f)]
                assert (m.rows, m.vals) == (len(x), x.count())
                assert np.isclose(m.mean, x.mean(), rtol=1e-12) and np.isclose(m.variance, x.var(ddof=0), rtol=1e-9)


def test_past_only_statistics(gaps):
    frame = gaps.toPandas()
    got = P.fold_moments(gaps, ["a"], past_only=True)
    assert got[0][("a",)].rows == 0
    assert got[5][("a",)].rows == (frame.fold < 4).sum()


def test_fold_standardise(gaps):
    frame = gaps.toPandas().set_index("entity_id")
    got = P.fold_standardise(gaps, ["a", "b", "const", "empty"]).toPandas().set_index("entity_id")
    assert "empty" not in got.columns and (got["const"] == 0).all()
    for fold in [0, 3, None]:
        mine = frame.fold.isna() if fold is None else frame.fold == fold
        train = frame[frame.fold.notna() & ~mine]["b"]
        filled = train.fillna(train.mean())
        want = (frame[mine]["b"].fillna(train.mean()) - filled.mean()) / filled.std(ddof=0)
        assert np.allclose(got.loc[want.index, "b"], want)
    leaky = P.fold_standardise(gaps, ["a"], leaky=True).toPandas().set_index("entity_id")["a"]
    source = frame[frame.fold.notna()]["a"]
    assert np.allclose(leaky, ((frame["a"] - source.mean()) / source.std(ddof=0)).reindex(leaky.index))


@pytest.mark.parametrize("strategy", ["mean", "median"])
def test_standardiser(gaps, strategy):
    frame = gaps.toPandas()
    names = ["a", "b", "const", "empty"]
    fitted = P.fit_standardiser(gaps, names, strategy)
    got = P.apply_standardiser(gaps, fitted, names).toPandas()
    assert "empty" not in got.columns
    filled = frame["b"].fillna(getattr(frame["b"], strategy)())
    assert np.allclose(got["b"], (filled - filled.mean()) / filled.std(ddof=0)) and (got["const"] == 0).all()
    with pytest.raises(ValueError):
        P.fit_standardiser(gaps, names, "mode")
