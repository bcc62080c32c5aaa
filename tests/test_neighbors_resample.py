import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import neighbors, resample
from cohortlens.plans.validation import FoldedData, oof_one_pass


def brute(queries, points, features, k, exclude=None, p=2):
    points = points.sort_values("entity_id")
    out = {}
    for _, q in queries.iterrows():
        pool = points if exclude is None else points[points[exclude] != q[exclude]]
        gap = (pool[features] - q[features].astype(float)).abs()
        d = (gap**2).sum(axis=1) if p == 2 else gap.sum(axis=1)
        out[int(q.entity_id)] = pool.entity_id.to_numpy()[np.argsort(d.to_numpy(), kind="stable")[:k]].tolist()
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    n = 240
    xy = rng.integers(0, 12, (n, 2)).astype(float)
    xy[rng.random(n) < 1 / 3] = [5.0, 5.0]  # a third of the rows are copies of one point
    return pd.DataFrame({"entity_id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "fold": rng.integers(0, 3, n), "label": rng.integers(0, 2, n)})


@pytest.mark.parametrize("exclude,p,cell_rows,chunk_rows", [
    ("entity_id", 2, 4096, 4096), ("entity_id", 2, 25, 20), ("fold", 2, 40, 500), ("entity_id", 1, 40, 30), (None, 2, 60, 50)])
def test_join_equals_brute_force(spark, points, exclude, p, cell_rows, chunk_rows):
    df = spark.createDataFrame(points)
    got = neighbors.knn_join(df, df, ["x", "y"], 6, exclude=exclude, p=p, payload=["label"],
                             cell_rows=cell_rows, chunk_rows=chunk_rows).toPandas()
    lists = got.sort_values(["entity_id", "rank"]).groupby("entity_id")["neighbor"].apply(list).to_dict()
    assert lists == brute(points, points, ["x", "y"], 6, exclude, p)
    assert (got.merge(points, left_on="neighbor", right_on="entity_id")["label_x"] == got.merge(points, left_on="neighbor", right_on="entity_id")["label_y"]).all()


@pytest.mark.parametrize("exclude,p,cell_rows,chunk_rows", [("entity_id", 2, 4096, 4096), ("fold", 2, 50, 70), ("entity_id", 1, 40, 30), (None, 2, 60, 50)])
def test_tiles_equal_brute_force(spark, points, exclude, p, cell_rows, chunk_rows):
    df = spark.createDataFrame(points)
    got = neighbors.knn_join(df, df, ["x", "y"], 6, exclude=exclude, p=p, payload=["label"], cell_rows=cell_rows, chunk_rows=chunk_rows, method="tiles").toPandas()
    lists = got.sort_values(["entity_id", "rank"]).groupby("entity_id")["neighbor"].apply(list).to_dict()
    assert lists == brute(points, points, ["x", "y"], 6, exclude, p)
    joined = got.merge(points, left_on="neighbor", right_on="entity_id")
    assert (joined["label_x"] == joined["label_y"]).all()


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_tiles_of_many_dimensions(spark, offset):
    """Far from the origin the matrix product loses digits; the exact distances decide."""
    rng = np.random.default_rng(3)
    names = [f"x{i}" for i in range(40)]
    frame = pd.DataFrame(rng.normal(size=(150, 40)).round(3) + offset, columns=names).assign(entity_id=np.arange(150))
    frame.loc[100:110, names] = frame.loc[20, names].to_numpy()  # copies: ties go by key
    df = spark.createDataFrame(frame)
    got = neighbors.knn_join(df, df, names, 7, exclude="entity_id", cell_rows=40, chunk_rows=60).toPandas()
    lists = got.sort_values(["entity_id", "rank"]).groupby("entity_id")["neighbor"].apply(list).to_dict()
    x = frame[names].to_numpy()
    for i in range(150):
        raw = sum((x[i, j] - x[:, j]) ** 2 for j in range(40))
        raw[i] = np.inf
        assert lists[i] == np.lexsort((np.arange(150), raw))[:7].tolist()


def test_fewer_points_than_neighbours(spark, points):
    df = spark.createDataFrame(points.head(4))
    assert neighbors.knn_join(df, df, ["x", "y"], 9, exclude="entity_id").count() == 12
    with pytest.raises(ValueError):
        neighbors.knn_join(df, df, ["x"], 1, p=3)


def test_cells_split_copies_apart():
    tree = neighbors.grow_cells(np.array([[1.0]] * 6 + [[0.0], [2.0]]), 3)
    assert len(set(tree.locate(np.array([[0.0], [1.0], [2.0]])))) == 3


def test_distance_vote(spark):
    near = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 0.5, 0), (2, 1, 1.0, 1), (2, 2, 0.5, 0)], "entity_id int, rank int, distance double, label int")
    got = {r["entity_id"]: r["p"] for r in neighbors.neighbor_vote(near, 2, "distance").collect()}
    assert got == {1: 1.0, 2: pytest.approx(1 / 3)}


def test_out_of_fold_votes(folded):
    data = FoldedData(folded.where("fold IS NOT NULL"), ["a", "b"])
    got = oof_one_pass(data, "KNN", {0: {"n_neighbors": 7, "weights": "uniform"}, 1: {"n_neighbors": 3, "weights": "distance", "p": 1}}).toPandas()
    assert len(got) == 1200
    rows = data.scaled(4).toPandas()
    mine, others = rows[rows.fold == 4], rows[rows.fold != 4]
    near = brute(mine, others, ["a", "b"], 7)
    label = others.set_index("entity_id").label
    want = {e: label.loc[n].mean() for e, n in near.items()}
    votes = got[(got.trial_id == 0) & (got.fold == 4)].set_index("entity_id")["p"].to_dict()
    assert votes == pytest.approx(want)


def test_smote_levels_the_classes_on_segments(folded):
    train = folded.where("fold IS NOT NULL")
    made = resample.smote(train, ["a", "b"]).toPandas()
    frame = train.toPandas()
    n = frame.groupby("label").size()
    assert len(made) == n[0] - n[1] and set(made.label) == {1}
    near = brute(frame[frame.label == 1], frame[frame.label == 1], ["a", "b"], 5, "entity_id")
    xy = frame.set_index("entity_id")[["a", "b"]]
    for _, row in made.head(60).iterrows():
        base, point = xy.loc[int(row.entity_id)], row[["a", "b"]].astype(float)
        to = xy.loc[near[int(row.entity_id)]] - base
        u = ((point - base) * to).sum(axis=1) / (to**2).sum(axis=1)
        off = ((to.mul(u, axis=0) - (point - base)) ** 2).sum(axis=1)
        assert ((off < 1e-18) & (u > -1e-9) & (u < 1 + 1e-9)).any()
    again = resample.smote(train.repartition(5), ["a", "b"]).toPandas()
    key = ["entity_id", "copy"]
    assert made.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    both = resample.with_synthetic(train, resample.smote(train, ["a", "b"]))
    assert both.where("label = 1").count() == both.where("label = 0").count()


def test_borderline_bases_are_in_danger(folded):
    train = folded.where("fold IS NOT NULL")
    frame = train.toPandas()
    near = brute(frame[frame.label == 1], frame, ["a", "b"], 10, "entity_id")
    label = frame.set_index("entity_id").label
    want = {e for e, n in near.items() if 5 <= (label.loc[n] == 0).sum() < 10}
    assert {r["entity_id"] for r in resample.danger_rows(train, ["a", "b"]).collect()} == want
    made = resample.borderline_smote(train, ["a", "b"]).toPandas()
    assert set(made.entity_id) <= want and len(made) == (label == 0).sum() - (label == 1).sum()


def test_nothing_to_add(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, 1.0), (3, 0, 2.0)], "entity_id int, label int, a double")
    assert resample.smote(df, ["a"]).count() == 0


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_missing_features_raise(spark, bad):
    whole = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 0.0)], "entity_id int, x double, y double")
    holed = spark.createDataFrame([(1, 0.0, 1.0), (2, bad, 1.0), (3, 2.0, 0.0)], "entity_id int, x double, y double")
    for queries, points, what in ((holed, whole, "queries"), (whole, holed, "points")):
        with pytest.raises(ValueError, match=f"1 {what}"):
            neighbors.knn_join(queries, points, ["x", "y"], 1)


@pytest.mark.parametrize("positives", [0, 1, 5])
def test_too_few_positives_raise(spark, positives):
    df = spark.createDataFrame([(i, int(i < positives), float(i)) for i in range(20)], "entity_id int, label int, a double")
    for make in (resample.smote, resample.borderline_smote):
        with pytest.raises(ValueError, match=f"{positives} positives have no 5"):
            make(df, ["a"])


@pytest.mark.parametrize("offset,scale", [(0.0, 1.0), (1e6, 1e-3), (0.0, 1e-42), (0.0, 1e35), (-5.0, 1e200)])
@pytest.mark.parametrize("p", [1, 2])
def test_nearest_of_a_tile_equals_brute_force(monkeypatch, offset, scale, p):
    from cohortlens.operators import tiles
    rng, asked = np.random.default_rng(4), []
    if p == 2 and scale > 1e100:
        return  # squares are beyond the range of doubles
    y = offset + np.round(rng.normal(size=(150, 16)), 1) * scale
    ban, absolute = np.arange(150) // 2, tiles._absolute
    monkeypatch.setattr(tiles, "CACHED_PAIRS", 700)
    monkeypatch.setattr(tiles, "BLOCK_PAIRS", 4000)
    monkeypatch.setattr(tiles, "_absolute", lambda part, columns, longest: asked.append(columns.dtype) or absolute(part, columns, longest))
    row, col, raw = tiles.nearest(y, y, 7, p, ban, ban)
    exact = tiles.minkowski(y[:, None] - y, p)
    exact[ban[:, None] == ban] = np.inf
    want = np.argsort(exact, axis=1, kind="stable")[:, :7]
    assert np.array_equal(row, np.repeat(np.arange(150), 7)) and np.array_equal(col, want.ravel())
    assert np.array_equal(raw, np.take_along_axis(exact, want, 1).ravel())
    assert (np.dtype(np.float32) in asked) == (p == 1 and scale < 1e30)


def test_rows_at_the_same_place_ask_for_neighbours_once(folded, monkeypatch):
    from cohortlens.plans import validation
    rows = folded.withColumns({c: F.round(c) for c in ("a", "b")})
    data, asked, join = validation.FoldedData(rows, ["a", "b"]), [], validation.knn_join

    def counted(queries, *args):
        asked.append((queries.count(), queries.select("a", "b").distinct().count()))
        return join(queries, *args)

    monkeypatch.setattr(validation, "knn_join", counted)
    got = {r["entity_id"]: r["p"] for r in validation.oof_one_pass(data, "KNN", {0: {"n_neighbors": 7}}).collect()}
    assert len(got) == 600 and all(n == places for n, places in asked) and sum(n for n, _ in asked) < 400
    for fold in (0, 3):
        train, valid = data.split(fold)
        slow = neighbors.neighbor_vote(join(valid, train, ["a", "b"], 7, payload=["label"]), 7).collect()
        assert {r["entity_id"]: got[r["entity_id"]] for r in slow} == pytest.approx({r["entity_id"]: r["p"] for r in slow})


def test_a_tile_is_searched_in_bounded_memory():
    import tracemalloc

    from cohortlens.operators import tiles

    assert tiles.TILE_BYTES <= 16 << 20
    x, y = np.random.default_rng(4).normal(size=(128, 8)), np.random.default_rng(5).normal(size=(32768, 8))
    tracemalloc.start()
    row, col, _ = tiles.nearest(x, y, 3, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # before: several arrays of 32 MB
    assert len(row) == 3 * 128 and set(col[row == 7]) == set(np.argsort(((x[7] - y) ** 2).sum(axis=1))[:3])
