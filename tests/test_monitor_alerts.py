"""Monitoring, alert rules and request decoding on literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.operators import alerts as A
from tabulon.operators import clean
from tabulon.operators import monitor as M
from tabulon.sources.tables import decode_requests


def test_batch_request_decoding_defaults(spark):
    body = '{"customers": [{"monthly_charges": 10.0, "contract": "One year"}, {"tenure_months": 3}]}'
    df = spark.createDataFrame([(1, body)], "req_id int, value string")
    rows = decode_requests(df, batch=True).orderBy("item_index").collect()
    assert [r.item_index for r in rows] == [0, 1]
    assert rows[0].monthly_charges == 10.0 and rows[0].multiple_lines == "No"
    assert rows[1].tenure_months == 3 and rows[1].contract is None


def test_unpivot_record_formats(spark):
    df = spark.createDataFrame([(1, 12.0, 3.14159, None, "x_y")], "id int, a double, b double, c double, d string")
    out = {r.feature: r.display_value for r in clean.unpivot_record(df, "id", ["a", "b", "c", "d"]).collect()}
    assert out == {"A": "12", "B": "3.14", "C": "Not Available", "D": "x_y"}


def test_rules_fire_and_must_be_boolean(spark):
    m = spark.createDataFrame([(1, 0.7, 0.05, 1200.0, "healthy", 0.9),
                               (2, 0.9, 0.20, 100.0, "down", 0.5)],
                              "w int, accuracy double, drift_score double, prediction_latency_ms double, "
                              "service_health string, avg_confidence double")
    fired = {(r.w, r.name) for r in A.rule_alerts(m, keys=["w"]).collect()}
    assert fired == {(1, "model_accuracy_drop"), (1, "high_prediction_latency"),
                     (2, "data_drift_detected"), (2, "service_unavailable"), (2, "low_prediction_confidence")}
    with pytest.raises(ValueError):
        A.evaluate_rules(m, [("bad", "accuracy + 1", "low", "x", ())])


def test_insufficient_window_suppresses_metric_alert(spark):
    w = spark.createDataFrame([(1, 0, None, "insufficient"), (2, 3, 0.6, "insufficient"), (3, 20, 0.6, "ok")],
                              "window_start int, n_predictions long, avg_confidence double, status string")
    got = {(r.window_start, r.type) for r in A.monitor_alerts(w).collect()}
    assert got == {(1, "NO_PREDICTIONS"), (3, "LOW_CONFIDENCE")}


def test_window_changes(spark):
    d = spark.createDataFrame([(1, 100, 0.9), (2, 160, 0.88), (3, 150, 0.8)], "day int, volume long, accuracy double")
    r = {x.day: x for x in M.window_changes(d, "day").collect()}
    assert r[1].volume_alert is False and r[2].volume_alert is True and r[3].volume_alert is False
    assert r[3].accuracy_alert is True and r[2].accuracy_alert is False


def test_sustained_low_confidence_needs_full_coverage(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=h), c) for h, c in [(0, 0.9), (1, 0.8), (2, 0.8), (4, 0.8)]]
    w = spark.createDataFrame(rows, "window_start timestamp, avg_confidence double")
    out = {r.window_start.hour: r.sustained_alert for r in A.sustained_low(w, every_minutes=60).collect()}
    assert out == {0: False, 1: False, 2: True, 4: False}


def test_feedback_asof_takes_first_truth(spark):
    t = dt.datetime(2024, 1, 1, 12)
    pred = spark.createDataFrame([(1, "u", t)], "pid int, user string, ts timestamp")
    truth = spark.createDataFrame([(10, "u", t + dt.timedelta(hours=5)), (11, "u", t + dt.timedelta(hours=2)),
                                   (12, "u", t + dt.timedelta(hours=30)), (13, "v", t)],
                                  "fid int, user string, feedback_ts timestamp")
    out = M.feedback_join(pred, truth, "user", "ts", "feedback_ts", 1, truth_id="fid").collect()
    assert [(r.pid, r.fid) for r in out] == [(1, 11)]
