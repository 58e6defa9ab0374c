"""Scoring and monitoring flow: a fitted pipeline scores
a table (or a stream, see ``streaming.jobs``), the scored rows form the
prediction log, and the log feeds windowed metrics, feedback accuracy and
alerts - all DataFrames, nothing kept in driver memory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.operators import alerts, monitor
from tabulon.operators.model import positive_probability
from tabulon.operators.score import scored_rows


@dataclass
class Monitoring:
    scored: DataFrame
    windows: DataFrame
    tiers: DataFrame
    alerts: DataFrame
    feedback: DataFrame | None
    accuracy: DataFrame | None


def score_and_monitor(model, table: DataFrame, id_col: str, ts_col: str | None = None,
                      every: str = C.MONITOR_WINDOW, truth: DataFrame | None = None,
                      truth_ts: str = "feedback_ts", horizon_days: int = 1,
                      model_version: str | None = None) -> Monitoring:
    p = positive_probability(model.transform(table))
    scored = scored_rows(p, model_version=model_version, id_col=id_col, ts=ts_col)
    win = monitor.windowed_metrics(scored.withColumnRenamed("churn_probability", "p"), ts="timestamp",
                                   prob="p", every=every)
    tiers = monitor.tier_distribution(scored, "churn_probability")
    al = alerts.monitor_alerts(win)
    fb = acc = None
    if truth is not None:
        pred = scored.select("customer_id", F.col("timestamp").alias("ts"),
                             (F.col("churn_prediction") == 1).alias("predicted_churn"),
                             F.xxhash64("customer_id", "timestamp").alias("prediction_id"))  # stable on recompute
        fb = monitor.feedback_join(pred, truth, "customer_id", "ts", truth_ts, horizon_days)
        acc = monitor.feedback_accuracy(fb)
    return Monitoring(scored, win, tiers, al, fb, acc)
