import pytest
from pyspark.sql import functions as F

from cohortlens.functions.columns import ColumnPolicy, clean_numeric, drop_all_missing, resolve_features
from cohortlens.operators.focal import load_model, save_model
from cohortlens.operators.linear import LinearScore
from cohortlens.sources import cohorts, reports, trials


def csv(path, text):
    path.write_text(text)
    return str(path)


def test_load_cohorts_keeps_the_index_of_a_missing_cohort(spark, tmp_path):
    a = csv(tmp_path / "a.csv", "SID,x,y,grade_label\n1,0.5,2,1\n2,inf,3,0\n")
    c = csv(tmp_path / "c.csv", "SID,x,grade_label\n3,1.5,0\n")
    t = csv(tmp_path / "t.csv", "SID,x,y,grade_label\n4,2.5,1,0\n")
    df = cohorts.load_cohorts(spark, {2020: a, 2021: str(tmp_path / "none.csv"), 2022: c}, (2023, t), "grade_label")
    rows = {r["SID"]: r for r in df.collect()}
    assert [(rows[i]["cohort"], rows[i]["cohort_index"], rows[i]["split"]) for i in (1, 3, 4)] == [
        (2020, 0, "source"), (2022, 2, "source"), (2023, 3, "target")]
    assert rows[3]["y"] is None and rows[1]["y"] == 2


def test_missing_label_and_overlapping_target_are_errors(spark, tmp_path):
    a = csv(tmp_path / "a.csv", "SID,x\n1,0.5\n")
    with pytest.raises(cohorts.MissingLabel):
        cohorts.load_cohorts(spark, [a], str(tmp_path / "t.csv"), "grade_label")
    with pytest.raises(ValueError):
        cohorts.load_cohorts(spark, {2020: a}, (2020, a), "grade_label")


def test_clean_numeric_and_all_missing(spark):
    df = spark.createDataFrame(
        [(1, float("inf"), None), (2, float("-inf"), None), (3, float("nan"), None), (4, 2.0, None)], "k int, x double, z double")
    cleaned = clean_numeric(df, ["x"])
    assert [r["x"] for r in cleaned.orderBy("k").collect()] == [None, None, None, 2.0]
    assert drop_all_missing(df, ["x", "z"]) == ["x"]


def test_policy_is_case_sensitive_and_keeps_source_order(spark):
    source = spark.createDataFrame([(1, 1, 1, 1, 1)], "b int, LAcc_1 int, lacc_2 int, grade int, a int")
    target = spark.createDataFrame([(1, 1, 1)], "a int, lacc_2 int, b int")
    policy = ColumnPolicy(("grade",), ("LAcc",))
    assert resolve_features(source, target, policy) == ["b", "lacc_2", "a"]
    assert resolve_features(source, None, policy, keep_out=("a",)) == ["b", "lacc_2"]


def test_trials_round_trip_and_selection(spark, tmp_path):
    rows = [("LightGBM", i, {"n_estimators": "100.0", "ACC": "0.9", "Top1_Contrib(%)": "3"}, v, 0.3, "ok", None)
            for i, v in enumerate([0.2, None, 0.5, 0.5, -0.7])]
    table = spark.createDataFrame(rows, trials.TRIALS_SCHEMA)
    ranked = trials.rank_trials(table)
    assert [(r["trial_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(2, 0), (3, 1), (0, 2), (4, 3)]
    trials.write_trials(ranked, str(tmp_path / "t"))
    back = trials.read_trials(spark, str(tmp_path / "t"))
    assert [r["trial_id"] for r in trials.select_trials(back, [1, 9]).collect()] == [3]
    assert trials.valid_trials(back, above=-0.5).count() == 3
    assert trials.select_by_keyword(back, "lightgbm", 2).first()["trial_id"] == 0
    assert trials.select_by_keyword(back, "xgb").count() == 0
    decoded = trials.decode_params(trials.select_trials(back, [0]), ["trial_id"]).collect()
    assert [(d["param"], d["i"]) for d in decoded] == [("n_estimators", 100)]


def test_report_sinks_and_model_file(spark, tmp_path):
    imp = spark.createDataFrame([("m", "f", 1.0), ("n", "f", 2.0)], "model_id string, feature string, importance double")
    reports.write_importance(imp, str(tmp_path / "imp"))
    assert {p.name for p in (tmp_path / "imp").iterdir() if p.is_dir()} == {"model_id=m", "model_id=n"}
    report = imp.withColumn("params", F.create_map(F.lit("k"), F.lit("v")))
    reports.write_report(report, str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep")).orderBy("model_id").first()["params"] == '{"k":"v"}'
    model = LinearScore({"a": 0.25, "b": -1.0}, 0.5)
    save_model(model, imp, str(tmp_path / "model"))
    assert load_model(spark, str(tmp_path / "model")) == model
