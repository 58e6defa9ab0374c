"""Literal edge cases (FIXTURES C) for cleaning, validation and scalar functions."""

import math

from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.operators import clean, profile, validate
from tabulon.sources.tables import nan_to_null


def test_all_null_text_column_becomes_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "c string")
    vals = clean.mode_fill_values(df, ["c"])
    assert vals == {"c": "Unknown"}
    assert [r.c for r in clean.fill(df, vals).collect()] == ["Unknown", "Unknown"]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(x,) for x in "babac"], "c string")
    assert clean.mode_fill_values(df, ["c"]) == {"c": "a"}


def test_even_median_fill(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    vals = clean.median_fill_values(df, ["x"])
    assert vals == {"x": 1.5}
    assert sorted(r.x for r in clean.fill(df, vals).collect()) == [1.0, 1.5, 2.0]


def test_text_to_number(spark):
    df = spark.createDataFrame([(" ",), ("abc",), ("12.5 ",)], "t string")
    assert [r.n for r in df.select(S.to_number("t").alias("n")).collect()] == [None, None, 12.5]


def test_nan_becomes_null_at_scan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    vals = [r.x for r in nan_to_null(df).collect()]
    assert vals[0] is None and vals[1] is None and vals[2] == 1.0


def test_tiers_are_half_open(spark):
    df = spark.createDataFrame([(0.3,), (0.7,), (0.299,)], "p double")
    assert [r.t for r in df.select(S.risk_tier("p").alias("t")).collect()] == ["Medium", "High", "Low"]


def test_derived_total(spark):
    df = spark.createDataFrame([(None, 10.0, 3), (0.0, 10.0, 3), (5.0, 10.0, 3)], "t double, m double, n int")
    assert [r.x for r in df.select(S.derive_total("t", "m", "n").alias("x")).collect()] == [30.0, 30.0, 5.0]


def test_missing_listed_column_is_reported(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out, rep = clean.drop_listed(df, ["a", "zz"])
    assert out.columns == ["b"] and rep.dropped == ("a",) and rep.not_found == ("zz",)


def test_empty_table_statistics(spark):
    df = spark.createDataFrame([], "x double, c string")
    d = profile.describe(df, ["x"]).first()
    assert d["count"] == 0 and d["mean"] is None and d["p50"] is None
    v = validate.validate_table(df, min_rows=1, required=()).first()
    assert v["n_rows"] == 0 and v["is_valid"] is False
    from tabulon.operators.monitor import performance_snapshot
    df2 = spark.createDataFrame([], "churn_probability double")
    s = performance_snapshot(df2).first()
    assert s["n_predictions"] == 0 and s["status"] == "insufficient" and s["avg_confidence"] is None


def test_request_rules_and_counts(spark):
    rows = [("Yes", "Yes", "One year", 10.0, 3, 1.0, 30, 1.0, 3),
            (" ", "Yes", "One year", -1.0, 3, 1.0, 30, 1.0, 6)]
    df = spark.createDataFrame(rows, "phone_service string, internet_service string, contract string, "
                               "monthly_charges double, tenure_months long, cltv double, age long, "
                               "population double, satisfaction_score long")
    v = validate.violations(df, validate.request_rules()).collect()
    assert v[0]["violations"] == [] and v[0]["is_valid"]
    assert set(v[1]["violations"]) == {"phone_service_required", "monthly_charges_positive",
                                       "satisfaction_score_range"}
    counts = {r.rule: r.n_violations for r in validate.violation_counts(df, validate.request_rules()).collect()}
    assert counts["monthly_charges_positive"] == 1 and counts["age_non_negative"] == 0


def test_code_maps_unknown_to_zero(spark):
    from tabulon import config as C
    df = spark.createDataFrame([("Fiber optic",), ("DSL",), ("None",), (None,)], "t string")
    out = [r.c for r in df.select(S.code_map("t", C.INTERNET_TYPE_CODES, case_insensitive=True).alias("c")).collect()]
    assert out == [3, 2, 0, 0]


def test_short_list_text(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e", "f", "g"],), (["a"],)], "l array<string>")
    assert [r.s for r in df.select(S.short_list("l").alias("s")).collect()] == ["a, b, c, d, e and 2 more", "a"]


def test_histogram_keeps_empty_bins_and_max(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (10.0,)], "x double")
    h = profile.histogram(df, "x", 20).orderBy("bin").collect()
    assert len(h) == 20 and h[0]["n"] == 2 and h[-1]["n"] == 1 and sum(r["n"] for r in h) == 3


def test_no_data_guard(spark, tmp_path):
    from tabulon.sources.tables import read_or_no_data
    df = read_or_no_data(spark, str(tmp_path / "absent"), spark.range(1).schema)
    assert df.count() == 0 and "status" in df.columns


def test_decision_flag_defaults_to_true(spark):
    from tabulon.sources.sinks import decision_flag
    empty = spark.createDataFrame([], "retrain_needed boolean")
    assert decision_flag(empty).first()["retrain_flag"] == "true"
    no = spark.createDataFrame([(False,)], "retrain_needed boolean")
    assert decision_flag(no).first()["retrain_flag"] == "false"


def test_imputed_columns_have_no_nulls(spark):
    from tabulon.sources import supplied as SP
    ent = SP.entity_table(spark, "/root/testdata/sf0.001")
    num, cat = ["c_acctbal", "n_orders", "total_spend"], ["c_mktsegment"]
    assert ent.where(F.col("c_acctbal").isNull() | F.col("c_mktsegment").isNull()).count() > 0
    out, values = clean.impute(ent, num, cat)
    row = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in num + cat]).first()
    assert all(row[c] == 0 for c in num + cat)
    assert set(values) == set(num + cat)
