"""End-to-end flows on the smallest supplied tables."""

import pytest

from pyspark.sql import functions as F

from tabulon.operators import model as MD
from tabulon.plans.monitoring import score_and_monitor
from tabulon.plans.validation import validate_pair, write_outputs
from tabulon.roles import ColumnRoles
from tabulon.sources import supplied as SP

SF = "/root/testdata/sf0.001"


def test_validation_flow_writes_report_and_flag(spark, tmp_path):
    ref, cur = SP.reference_current(spark, SF, drifted=True)
    roles = ColumnRoles(numeric=("value",), categorical=("event_type",))
    v = validate_pair(ref.drop("event_id", "ts"), cur.drop("event_id", "ts"), roles)
    d = v.decision.first()
    assert d["dataset_drift"] and d["retrain_needed"]
    write_outputs(v, str(tmp_path))
    assert spark.read.text(str(tmp_path / "retrain_flag")).first()[0] == "true"
    assert spark.read.json(str(tmp_path / "validation_report")).count() == 1


def test_scoring_and_monitoring_flow(spark):
    ent = SP.entity_table(spark, SF).select("c_custkey", "c_acctbal", "n_orders", "c_mktsegment",
                                            F.col("churn").cast("double").alias("churn"), "last_order")
    ent = MD.balanced_weights(ent, "churn")
    spec = MD.fit_feature_spec(ent, ["c_acctbal", "n_orders"], ["c_mktsegment"])
    m = MD.fit_model(ent, spec, "logistic_regression", label="churn", key="c_custkey")
    mon = score_and_monitor(m, ent, "c_custkey", ts_col="last_order", every="30 days")
    n = ent.count()
    assert mon.scored.count() == n
    assert sum(r["n"] for r in mon.tiers.collect()) == n
    assert mon.windows.agg(F.sum("n_predictions")).first()[0] == n


def test_scoring_keeps_one_row_per_row_of_a_repeated_id(spark):
    ent = SP.entity_table(spark, SF).select("c_custkey", "c_acctbal", "n_orders", F.col("churn").cast("double").alias("churn"), "last_order")
    ent = MD.balanced_weights(ent, "churn")
    spec = MD.fit_feature_spec(ent, ["c_acctbal", "n_orders"], [])
    m = MD.fit_model(ent, spec, "logistic_regression", label="churn", key="c_custkey")
    twice = ent.unionByName(ent)
    mon = score_and_monitor(m, twice, "c_custkey", ts_col="last_order", every="30 days")
    assert mon.scored.count() == 2 * ent.count()
    assert mon.windows.agg(F.sum("n_predictions")).first()[0] == 2 * ent.count()


def test_failed_validation_writes_true_and_raises(spark, tmp_path):
    from tabulon.plans.validation import validate_and_write

    def broken():
        raise OSError("no reference")
    with pytest.raises(OSError):
        validate_and_write(spark, broken, broken, str(tmp_path))
    assert spark.read.text(str(tmp_path / "retrain_flag")).first()[0] == "true"


def test_best_run_tests_artifacts_before_choosing(spark):
    from tabulon.operators.runs import best_run
    m = spark.createDataFrame([(f"r{i:03d}", None, "auc", i / 100) for i in range(100)], "run_id string, parent_id string, key string, value double")
    art = spark.createDataFrame([("r003",), ("r001",)], "run_id string")
    assert best_run(m, art, "auc").first()["run_id"] == "r003"
    assert best_run(m, art.limit(0), "auc").first()["run_id"] == "r099"


def test_model_inputs_are_checked(spark):
    from tabulon.sources.tables import read_csv
    with pytest.raises(ValueError):
        MD.classifier("bagging", maxIter=3)
    with pytest.raises(FileNotFoundError):
        read_csv(spark, "/nowhere/at/all.csv")
    none = spark.createDataFrame([(float(i), None, float(i % 2)) for i in range(40)], "x double, c string, y double")
    spec = MD.fit_feature_spec(none, ["x"], ["c"])
    m = MD.fit_model(none.withColumn("class_weight", F.lit(1.0)), spec, "logistic_regression", label="y", key="x")
    got = {r["feature"] for r in MD.feature_importance(m, spec, spark).collect()}
    assert got == {"num__x", "cat__c_Unknown"}


def test_a_tuned_svm_has_probabilities(spark):
    from tabulon.plans.training import train_all, tune_best
    ent = SP.entity_table(spark, SF).select("c_custkey", "c_acctbal", "n_orders", "churn")
    t = train_all(ent, "churn", "c_custkey", ["c_acctbal", "n_orders"], [], families=("linear_svc",))
    fam, model, cmp = tune_best(t, "churn", "c_custkey", k=2, grid={"regParam": [0.01, 0.1]})
    assert fam == "linear_svc" and {r["model"] for r in cmp.collect()} == {"tuned", "untuned"}


def test_tune_best_reports_untuned_and_tuned(spark):
    from tabulon.plans.training import train_all, tune_best
    ent = SP.entity_table(spark, SF).select("c_custkey", "c_acctbal", "n_orders", "c_mktsegment", "churn")
    t = train_all(ent, "churn", "c_custkey", ["c_acctbal", "n_orders"], ["c_mktsegment"],
                  families=("logistic_regression",))
    fam, model, cmp = tune_best(t, "churn", "c_custkey", k=3)
    assert fam == "logistic_regression"
    assert {r["model"] for r in cmp.collect()} == {"tuned", "untuned"}
