"""Drift and quality read their tables once, and survive large counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.config import DriftConfig
from tabulon.operators import drift as D
from tabulon.operators import quality as Q
from tabulon.operators.ordered import materialize, running_sums
from tabulon.plans.validation import validate_pair
from tabulon.roles import ColumnRoles
from test_counts import counted

BIG = 4_000_000_000


def pair(spark, n=300):
    rng = np.random.default_rng(8)
    make = lambda shift: spark.createDataFrame(
        [(float(x), str(c), int(t)) for x, c, t in zip(rng.normal(shift, 1, n).round(2), rng.choice(list("abc"), n), rng.integers(0, 2, n))],
        "x double, c string, y int")
    return make(0.0), make(1.0)


def test_counts_of_four_billion_rows_a_side(spark):
    rows = [("number", "x", 1.0, None, BIG, BIG // 2), ("number", "x", 2.0, None, BIG, 3 * BIG // 2),
            ("text", "c", None, "a", BIG, BIG // 2), ("text", "c", None, "b", BIG, 3 * BIG // 2)]
    counts = materialize(spark.createDataFrame(rows, "kind string, column_name string, num double, txt string, a long, b long"))
    n = D.numeric_drift_of(counts).first()
    assert (n.n_ref, n.n_cur) == (2 * BIG, 2 * BIG) and abs(n.ks - 0.25) < 1e-12 and n.ks_p_value == 0.0
    c = D.categorical_drift_of(counts).first()
    assert abs(c.chi2 / (BIG * 4 / 15) - 1) < 1e-9 and c.chi2_p_value < 1e-300        # 2 x 2 table, by hand
    for by in ("distance", "p_value"):
        got = D.column_drift(None, counts, ["x"], ["c"], DriftConfig(decide_by=by), counts).collect()
        assert all(r.drifted for r in got)


def test_drift_reads_each_table_once(spark):
    ref, cur = pair(spark)
    (a, read_a), (b, read_b) = counted(spark, ref), counted(spark, cur)
    D.dataset_drift(D.column_drift(a, b, ["x"], ["c", "y"])).collect()
    assert (read_a(), read_b()) == (300, 300)
    seen = D.pair_counts(a, b, ["x"], ["c", "y"])
    per = D.column_drift(a, b, ["x"], ["c"], counts=seen)
    summary = D.drift_summary(D.dataset_drift(per), seen).first()
    target = D.target_drift(a, b, "y", counts=seen).first()
    row = D.validation_summary(D.retrain_decision(D.dataset_drift(per), D.target_drift(a, b, "y", counts=seen), None), a, b, seen).first()
    assert (read_a(), read_b()) == (600, 600)
    assert (summary.reference_samples, row.current_rows, row.reference_columns) == (300, 300, 3) and target.column_name == "y"


def test_the_validation_flow_reads_the_reference_once(spark):
    ref, cur = pair(spark)
    a, read = counted(spark, ref)
    v = validate_pair(a, cur, ColumnRoles(numeric=("x",), categorical=("c",), target="y"))
    assert v.summary.first().reference_rows == 300 and v.dataset.first().n_columns == 2 and v.target.first().column_name == "y"
    assert read() == 300


def scored(spark, n=400, groups=3):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"model": rng.integers(0, groups, n), "label": rng.integers(0, 2, n), "score": rng.random(n).round(2)})
    pdf["prediction"] = (pdf["score"] >= 0.5).astype(int)
    return pdf, spark.createDataFrame(pdf.astype({"model": "int64", "label": "int32", "prediction": "int32"}))


@pytest.mark.parametrize("group", [(), ("model",)])
def test_an_evaluation_reads_the_scores_once(spark, group):
    pdf, df = scored(spark)
    df, read = counted(spark, df)
    got = Q.evaluation_report(df, group=list(group)).collect()
    assert read() == len(pdf) and len(got) == 7 * (3 if group else 1)
    for key, part in (pdf.groupby("model") if group else [(None, pdf)]):
        m = {r.metric: r.value for r in got if not group or r.model == key}
        pos, neg = part.loc[part.label == 1, "score"].to_numpy(), part.loc[part.label == 0, "score"].to_numpy()
        auc = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
        assert abs(m["roc_auc"] - auc) < 1e-12
        at = sorted(set(part.score), reverse=True)
        tp = np.array([((part.score >= t) & (part.label == 1)).sum() for t in at])
        n = np.array([(part.score >= t).sum() for t in at])
        assert abs(m["average_precision"] - (np.diff(np.r_[0, tp]) / tp[-1] * tp / n).sum()) < 1e-12
        assert abs(m["accuracy"] - (part.label == part.prediction).mean()) < 1e-12


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    from tabulon.operators import ordered
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 40)
    df = materialize(spark.range(200).select((F.col("id") % 50).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n")))
    few, many = (running_sums(df.where(c), "v", ["n"], ["g"], n_buckets=4, groups_bounded=None) for c in ("g < 5", "true"))
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(few) and "broadcast" not in plan(many)
    assert {(r.g, r.v): r.n_run for r in many.collect()} == {(v % 50, v): v // 50 + 1 for v in range(200)}
