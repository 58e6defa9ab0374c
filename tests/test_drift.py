import math

"""Drift identities: a table against itself, and a drifted copy."""

from pyspark.sql import functions as F

from tabulon.operators import drift as D


def _t(spark):
    return spark.range(2000).select(((F.col("id") * 7919) % 1000 / 10.0).alias("x"),
                                    F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b")
                                    .otherwise("c").alias("c"))


def test_table_against_itself(spark):
    t = _t(spark)
    n = D.numeric_drift(t, t, ["x"]).first()
    assert n["ks"] == 0 and n["wasserstein"] == 0 and n["ks_p_value"] == 1.0
    c = D.categorical_drift(t, t, ["c"]).first()
    assert abs(c["jensen_shannon"]) < 1e-12 and abs(c["chi2"]) < 1e-12 and abs(c["chi2_p_value"] - 1) < 1e-9
    ds = D.dataset_drift(D.column_drift(t, t, ["x"], ["c"])).first()
    assert ds["n_drifted"] == 0 and ds["dataset_drift"] is False


def test_drifted_copy_fires(spark):
    t = _t(spark)
    cur = t.select((F.col("x") * 1.5 + 20).alias("x"), F.when(F.col("c") == "a", "b").otherwise(F.col("c")).alias("c"))
    cd = {r["column_name"]: r["drifted"] for r in D.column_drift(t, cur, ["x"], ["c"]).collect()}
    assert cd == {"x": True, "c": True}
    s = D.drift_summary(D.dataset_drift(D.column_drift(t, cur, ["x"], ["c"]))).first()
    assert s["action"] == "retrain" and s["drifted_preview"] == "c, x"


def test_the_caller_names_the_deciding_score(spark):
    from tabulon.config import DriftConfig
    t = _t(spark).limit(200)
    cur = t.select((F.col("x") + 30).alias("x"), "c")
    r = {x["column_name"]: x for x in D.column_drift(t, cur, ["x"], ["c"], DriftConfig(decide_by="p_value")).collect()}
    assert r["x"]["test"] == "ks" and r["x"]["drifted"]
    assert r["c"]["test"] == "chi_square" and not r["c"]["drifted"]
    for n in (200, 2000):       # the same test at every size
        d = {x["column_name"]: x for x in D.column_drift(_t(spark).limit(n), cur, ["x"], ["c"]).collect()}
        assert (d["x"]["test"], d["c"]["test"]) == ("wasserstein_norm", "jensen_shannon")


def test_a_column_without_values_is_reported(spark):
    t = _t(spark)
    none = t.select(F.lit(None).cast("double").alias("x"), "c")
    cd = D.column_drift(t, none, ["x"], ["c"])
    r = {x["column_name"]: x for x in cd.collect()}
    assert (r["x"]["status"], r["x"]["drifted"], r["c"]["status"]) == ("no_current_data", False, "ok")
    both = {x["column_name"]: x["status"] for x in D.column_drift(none, none, ["x"], ["c"]).collect()}
    assert both == {"x": "no_current_data", "c": "ok"}
    shifted = D.column_drift(t, none.select("x", F.lit("z").alias("c")), ["x"], ["c"])
    assert D.dataset_drift(shifted).first()["share_drifted"] == 1.0


def test_gamma_converges_at_many_degrees_of_freedom():
    for dof in (100_000, 1_000_000):
        assert abs(D._gammq(dof / 2, dof / 2) - (0.5 - 1 / (3 * math.sqrt(math.pi * dof)))) < 1e-5


def test_segments_are_all_compared(spark):
    ref = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "s string, v double")
    cur = spark.createDataFrame([("a", 1.0), ("new", 9.0)], "s string, v double")
    got = {r["column_name"]: (r["n_ref"], r["n_cur"]) for r in D.segment_drift(ref, cur, "v", "s").collect()}
    assert got == {"v_a": (1, 1), "v_b": (1, 0), "v_null": (1, 0), "v_new": (0, 1)}


def test_chi2_sf_known_values():
    # Q(k/2, x/2): chi2 sf(3.84146, 1) = 0.05, sf(9.48773, 4) = 0.05
    assert abs(D._gammq(0.5, 3.841459 / 2) - 0.05) < 1e-6
    assert abs(D._gammq(2.0, 9.487729 / 2) - 0.05) < 1e-6


def test_sample_gate_marks_small_segments(spark):
    t = _t(spark)
    small = t.limit(30)
    cd = D.with_sample_gate(D.column_drift(small, small.select((F.col("x") + 50).alias("x"), "c"), ["x"], []))
    r = cd.first()
    assert r["status"] == "insufficient" and r["drifted"] is False


def test_empty_current_table_does_not_fail(spark):
    t = _t(spark)
    empty = t.limit(0)
    n = D.numeric_drift(t, empty, ["x"]).collect()
    c = D.categorical_drift(t, empty, ["c"]).collect()
    assert len(n) == 1 and n[0]["n_cur"] == 0
    assert len(c) == 1 and c[0]["n_cur"] == 0
    ds = D.dataset_drift(D.with_sample_gate(D.column_drift(t, empty, ["x"], ["c"]))).first()
    assert ds["n_drifted"] == 0
