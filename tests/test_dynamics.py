import datetime as dt

import numpy as np
import pandas as pd

from cohortlens.operators import dynamics


def test_activity_and_acceleration(spark):
    day = lambda d: dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=d)
    events = spark.createDataFrame([(1, day(0), 2.0), (1, day(1), 3.0), (1, day(6), 1.0), (2, day(3), 4.0), (2, day(40), 9.0)],
                                   "u int, ts timestamp, v double")
    grid = dynamics.activity_grid(events, "u", dynamics.period_of("ts", "2024-01-01", 2), 4, "v")
    rows = {(r["u"], r["period"]): (r["x"], r["total"]) for r in grid.collect()}
    assert [rows[1, p] for p in range(4)] == [(2, 5.0), (0, 0.0), (0, 0.0), (1, 1.0)]
    assert [rows[2, p][0] for p in range(4)] == [0, 1, 0, 0]
    series = dynamics.acceleration(grid, "u")
    acc = {(r["u"], r["period"]): r["acceleration"] for r in series.collect()}
    assert [acc[1, p] for p in range(4)] == [None, None, 2, 1]
    f = {r["u"]: r for r in dynamics.acceleration_features(series, "u").collect()}
    assert (f[1]["acc_last"], f[1]["acc_mean"], f[1]["acc_min"], f[1]["slowing_share"]) == (1, 1.5, 1, 0.0)
    assert f[2]["slowing_share"] == 0.5


def test_short_series_has_no_acceleration(spark):
    grid = spark.createDataFrame([(1, 0, 3), (1, 1, 5)], "u int, period int, x long")
    row = dynamics.acceleration_features(dynamics.acceleration(grid, "u"), "u").first()
    assert row["acc_mean"] is None and row["slowing_share"] is None


def hot_task(n=900):
    """A third of the rows are one task, a third of those at one moment."""
    rng = np.random.default_rng(5)
    task = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 8, n))
    t = rng.integers(0, 200, n)
    t[(task == 0) & (rng.random(n) < 1 / 3)] = 50
    return pd.DataFrame({"u": rng.integers(0, 25, n), "task": task, "t": t})


def test_rank_form(spark):
    frame = pd.concat([hot_task(), pd.DataFrame({"u": [99], "task": [99], "t": [1]})])  # a task with one submitter
    got = dynamics.procrastination_rank(spark.createDataFrame(frame), "u", ["task"], "t").toPandas().set_index("u")["rpi"]
    size = frame.groupby("task")["t"].transform("size")
    frame["pr"] = ((frame.groupby("task")["t"].rank(method="min") - 1) / (size - 1)).fillna(0)
    want = frame.groupby("u")["pr"].mean()
    assert np.allclose(got.sort_index(), want) and got[99] == 0


def test_robust_form_skips_tasks_without_spread(spark):
    frame = pd.concat([hot_task(), pd.DataFrame({"u": [1, 2, 99], "task": [77, 77, 77], "t": [4, 4, 4]})])
    got = dynamics.procrastination_robust(spark.createDataFrame(frame), "u", ["task"], "t").toPandas().set_index("u")["rpi"]
    med = frame.groupby("task")["t"].transform("median")
    gap = (frame["t"] - med).abs()
    mad = gap.groupby(frame["task"]).transform("median")
    frame["z"] = (frame["t"] - med) / (1.4826 * mad + 1e-9)
    want = frame[mad > 0].groupby("u")["z"].mean()
    assert 99 not in got.index and np.allclose(got.sort_index(), want)


def test_penalty(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "a", 6.0), (4, "b", None)], "entity_id int, task string, d double")
    rows = {r["entity_id"]: (r["d"], r["was_missing"]) for r in dynamics.penalty_impute(df, ["task"], "d").collect()}
    assert rows == {1: (2.0, 0), 2: (9.0, 1), 3: (6.0, 0), 4: (None, 1)}


def test_the_window_covers_all_events(spark):
    events = spark.createDataFrame([(1, "2023-12-30 10:00:00"), (2, "2024-03-01 00:00:00"), (3, "2025-01-05 23:59:59")], "u int, t string")
    events = events.selectExpr("u", "CAST(t AS timestamp) AS t")
    start, periods = dynamics.window_of(events, "t", 7)
    assert (start, periods) == ("2023-12-30", 54)
    grid = dynamics.activity_grid(events, "u", dynamics.period_of("t", start, 7), periods)
    assert grid.count() == 3 * 54 and grid.agg({"x": "sum"}).first()[0] == 3
    start, periods = dynamics.window_of(events.limit(0), "t", 7)
    assert periods == 0 and dynamics.activity_grid(events.limit(0), "u", dynamics.period_of("t", start, 7), periods).isEmpty()
