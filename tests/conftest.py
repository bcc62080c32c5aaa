import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cohortlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def cohort(spark):
    """Three source cohorts of 200 rows and a target, 20 % positive, with a signal in ``a``."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 800
    y = (rng.random(n) < 0.2).astype(int)
    frame = pd.DataFrame({
        "entity_id": np.arange(n), "cohort": np.repeat([2020, 2021, 2022, 2023], 200), "label": y,
        "a": rng.normal(size=n) + 1.5 * y, "b": rng.normal(size=n) * 3 + 1, "c": rng.normal(size=n) - 0.5 * y,
    })
    return spark.createDataFrame(frame)


@pytest.fixture(scope="session")
def folded(cohort):
    """The cohort with folds (target: NULL), staged."""
    from pyspark.sql import functions as F

    from cohortlens.operators.folds import assign_folds
    from cohortlens.session import stage

    source = assign_folds(cohort.where("cohort < 2023"), [2020, 2021, 2022])
    return stage(source.unionByName(cohort.where("cohort = 2023").withColumn("fold", F.lit(None).cast("int"))))
