"""Queries: monitoring, feedback, alerts (AGG13-18, 20, 22, WIN6-7, JON1, FLT5,
ALR1-5, SCO2, STR3 batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.functions import scalar as S
from tabulon.operators import alerts as A
from tabulon.operators import monitor as M
from tabulon.operators import profile as P
from tabulon.plans.catalog import query, ts_text, ts_text_sql
from tabulon.sources import supplied as SP

PL = SP.PREDLOG_SQL
RL = SP.REQLOG_SQL
TIER_SQL = ("CASE WHEN churn_probability < 0.3 THEN 'Low' WHEN churn_probability < 0.7 THEN 'Medium' "
            "ELSE 'High' END")
CONF_SQL = "greatest(churn_probability, 1.0 - churn_probability)"


@query("agg13_tier_distribution", f"""WITH {PL},
t AS (SELECT unnest(['Low', 'Medium', 'High']) AS risk_level),
c AS (SELECT {TIER_SQL} AS risk_level, count(*) AS n FROM predlog GROUP BY 1)
SELECT t.risk_level, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS share
FROM t LEFT JOIN c ON t.risk_level = c.risk_level""")
def agg13_tier_distribution(spark, sf):
    """AGG13: risk-tier counts and shares, zero rows for absent tiers."""
    return M.tier_distribution(SP.prediction_log(spark, sf))


@query("agg13_tier_by_event_type", f"""WITH {PL},
t AS (SELECT DISTINCT event_type, unnest(['Low', 'Medium', 'High']) AS risk_level FROM predlog),
c AS (SELECT event_type, {TIER_SQL} AS risk_level, count(*) AS n FROM predlog GROUP BY 1, 2)
SELECT t.event_type, t.risk_level, coalesce(n, 0) AS n,
  round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY t.event_type), 6) AS share
FROM t LEFT JOIN c ON t.risk_level = c.risk_level AND t.event_type = c.event_type""")
def agg13_tier_by_event_type(spark, sf):
    """AGG13 per group: tier distribution of every event type."""
    return M.tier_distribution(SP.prediction_log(spark, sf), group=["event_type"])


@query("agg14_performance_snapshot", f"""WITH {PL}
SELECT count(*) AS n_predictions, round(avg({CONF_SQL}), 6) AS avg_confidence,
  count(*) FILTER (WHERE churn_probability < 0.3) AS n_low,
  count(*) FILTER (WHERE churn_probability >= 0.3 AND churn_probability < 0.7) AS n_medium,
  count(*) FILTER (WHERE churn_probability >= 0.7) AS n_high, 'ok' AS status FROM predlog""")
def agg14_performance_snapshot(spark, sf):
    """AGG14 + FLT5: average confidence and tier counts with the sample gate."""
    return M.performance_snapshot(SP.prediction_log(spark, sf))


@query("agg16_latency_summary", f"""WITH {RL}
SELECT count(*) AS total_requests, count(*) FILTER (WHERE status = 'success') AS successful_requests,
  count(*) FILTER (WHERE status <> 'success') AS failed_requests,
  round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_rate,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS requests_per_second,
  round(min(duration_ms) FILTER (WHERE status = 'success'), 6) AS min_ms,
  round(max(duration_ms) FILTER (WHERE status = 'success'), 6) AS max_ms,
  round(avg(duration_ms) FILTER (WHERE status = 'success'), 6) AS mean_ms,
  round(quantile_cont(duration_ms, 0.5) FILTER (WHERE status = 'success'), 6) AS median_ms,
  round(quantile_cont(duration_ms, 0.95) FILTER (WHERE status = 'success'), 6) AS p95_ms,
  round(quantile_cont(duration_ms, 0.99) FILTER (WHERE status = 'success'), 6) AS p99_ms FROM reqlog""")
def agg16_latency_summary(spark, sf):
    """AGG16: load-test style latency summary over the request log."""
    return M.latency_summary(SP.request_log(spark, sf))


@query("agg17_level_summary", f"""WITH {RL}
SELECT level, count(*) AS total_requests, count(*) FILTER (WHERE status = 'success') AS successful_requests,
  round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_rate,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS requests_per_second,
  100.0 * count(*) FILTER (WHERE status = 'success') / count(*) > 95.0 AS passed
FROM reqlog GROUP BY level""")
def agg17_level_summary(spark, sf):
    """AGG17: success rate and rate per concurrency level with the 95 % gate."""
    return M.level_summary(SP.request_log(spark, sf))


def _feedback(spark, sf):
    """Predictions (views) matched with the first later truth (purchase) of the same user within a day."""
    log = SP.prediction_log(spark, sf)
    pred = log.where(F.col("event_type") == "view").select(
        "prediction_id", "ts", "entity_id", (F.col("churn_probability") >= 0.5).alias("predicted_churn"))
    truth = log.where(F.col("event_type") == "purchase").select(
        F.col("prediction_id").alias("feedback_id"), F.col("ts").alias("feedback_ts"), "entity_id",
        (F.col("churn_probability") >= 0.5).alias("actual_churn"))
    j = M.feedback_join(pred, truth, "entity_id", "ts", "feedback_ts", 1, truth_id="feedback_id")
    return j.select("entity_id", "prediction_id", "feedback_id", "ts", "feedback_ts",
                    "predicted_churn", "actual_churn")


FEEDBACK_SQL = f"""{PL},
fbp AS (SELECT p.entity_id, p.prediction_id, a.prediction_id AS feedback_id, p.ts, a.ts AS feedback_ts,
   p.churn_probability >= 0.5 AS predicted_churn, a.churn_probability >= 0.5 AS actual_churn,
   row_number() OVER (PARTITION BY p.prediction_id ORDER BY a.ts, a.prediction_id) AS rn
  FROM predlog p JOIN predlog a ON p.entity_id = a.entity_id
  WHERE p.event_type = 'view' AND a.event_type = 'purchase'
    AND a.ts >= p.ts AND a.ts <= p.ts + INTERVAL 1 DAY),
fb AS (SELECT entity_id, prediction_id, feedback_id, ts, feedback_ts, predicted_churn, actual_churn
  FROM fbp WHERE rn = 1)"""


@query("jon1_feedback_join", f"""WITH {FEEDBACK_SQL}
SELECT entity_id, prediction_id, feedback_id, {ts_text_sql('ts')} AS ts, {ts_text_sql('feedback_ts')} AS feedback_ts,
  predicted_churn, actual_churn FROM fb""")
def jon1_feedback_join(spark, sf):
    """JON1: each prediction joined with its first later ground truth within a day
    (as-of match over day buckets; at most one row per prediction)."""
    return _feedback(spark, sf).withColumn("ts", ts_text("ts")).withColumn("feedback_ts", ts_text("feedback_ts"))


@query("agg20_feedback_accuracy", f"""WITH {FEEDBACK_SQL}
SELECT count(*) AS n_feedback, round(avg(CAST(predicted_churn = actual_churn AS INTEGER)), 6) AS accuracy FROM fb""")
def agg20_feedback_accuracy(spark, sf):
    """AGG20: accuracy of predictions against received feedback."""
    return M.feedback_accuracy(_feedback(spark, sf))


_DAILY_SQL = f"""{FEEDBACK_SQL},
dt AS (SELECT date_trunc('day', ts) AS day, count(*) AS volume, avg({CONF_SQL}) AS avg_confidence,
   avg(CASE WHEN churn_probability >= 0.7 THEN 1 ELSE 0 END) AS high_risk_share FROM predlog GROUP BY 1),
fa AS (SELECT date_trunc('day', feedback_ts) AS day, avg(CAST(predicted_churn = actual_churn AS INTEGER)) AS accuracy
   FROM fb GROUP BY 1),
daily AS (SELECT dt.*, fa.accuracy FROM dt LEFT JOIN fa ON dt.day = fa.day)"""


def _daily(spark, sf):
    fb = _feedback(spark, sf)
    return M.daily_trend(SP.prediction_log(spark, sf), feedback=fb, feedback_ts="feedback_ts")


@query("agg22_daily_trend", f"""WITH {_DAILY_SQL}
SELECT {ts_text_sql('day')} AS day, volume, round(avg_confidence, 6) AS avg_confidence,
  round(high_risk_share, 6) AS high_risk_share, round(accuracy, 6) AS accuracy FROM daily""")
def agg22_daily_trend(spark, sf):
    """AGG22: daily volume, confidence, high-risk share and feedback accuracy."""
    return _daily(spark, sf).withColumn("day", ts_text("day"))


@query("win6_win7_window_changes", f"""WITH {_DAILY_SQL},
c AS (SELECT *, (volume - lag(volume) OVER (ORDER BY day)) / lag(volume) OVER (ORDER BY day) AS volume_change,
   first_value(accuracy IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS accuracy_baseline
   FROM daily)
SELECT {ts_text_sql('day')} AS day, volume, round(avg_confidence, 6) AS avg_confidence,
  round(high_risk_share, 6) AS high_risk_share, round(accuracy, 6) AS accuracy,
  round(volume_change, 6) AS volume_change, coalesce(abs(volume_change) > 0.5, false) AS volume_alert,
  round(accuracy_baseline, 6) AS accuracy_baseline, round(accuracy_baseline - accuracy, 6) AS accuracy_drop,
  coalesce(accuracy_baseline - accuracy > 0.05, false) AS accuracy_alert FROM c""")
def win6_win7_window_changes(spark, sf):
    """WIN6 + WIN7: volume change vs previous day and accuracy drop vs baseline."""
    return M.window_changes(_daily(spark, sf), "day").withColumn("day", ts_text("day"))


def _checks(spark, sf):
    from tabulon.plans.q_drift import LI_CAT, LI_NUM, _moved_pair
    from tabulon.operators import drift as D
    ref, cur = _moved_pair(spark, sf)
    cd = D.column_drift(ref, cur, LI_NUM, LI_CAT)
    return cd.select(F.concat(F.lit("no_drift_"), "column_name").alias("test_name"),
                     F.when(F.col("drifted"), "FAIL").otherwise("SUCCESS").alias("status"))


def _checks_sql():
    from tabulon.plans.q_drift import LI_CAT, LI_NUM, _MOVED_SQL, _column_drift_sql
    return _column_drift_sql(_MOVED_SQL, LI_NUM, LI_CAT)


@query("agg18_check_rollup", _checks_sql() + """
SELECT count(*) AS total_checks, count(*) FILTER (WHERE NOT drifted) AS passed,
  count(*) FILTER (WHERE drifted) AS failed,
  round(100.0 * count(*) FILTER (WHERE NOT drifted) / count(*), 6) AS success_rate FROM coldrift""")
def agg18_check_rollup(spark, sf):
    """AGG18: roll-up of a check-result table (per-column drift checks)."""
    return M.check_rollup(_checks(spark, sf))


@query("flt3_failed_checks", _checks_sql() + """
SELECT concat('no_drift_', column_name) AS test_name, 'FAIL' AS status FROM coldrift WHERE drifted""")
def flt3_failed_checks(spark, sf):
    """FLT3: checks whose status is not SUCCESS."""
    from tabulon.operators.clean import not_success
    return not_success(_checks(spark, sf))


def _windows(spark, sf, every="1 hour"):
    log = SP.prediction_log(spark, sf).withColumn("is_error_event", F.col("event_type") == "error")
    return M.windowed_metrics(log, every=every, error_col="is_error_event")


def _windows_sql(seconds: int) -> str:
    return f"""{PL},
w AS (SELECT to_timestamp(floor(epoch(ts) / {seconds}) * {seconds}) AS window_start, * FROM predlog),
agg AS (SELECT window_start, count(*) AS n_predictions, avg({CONF_SQL}) AS avg_confidence,
   count(*) FILTER (WHERE churn_probability < 0.3) AS n_low,
   count(*) FILTER (WHERE churn_probability >= 0.3 AND churn_probability < 0.7) AS n_medium,
   count(*) FILTER (WHERE churn_probability >= 0.7) AS n_high,
   avg(CAST(event_type = 'error' AS INTEGER)) AS error_rate FROM w GROUP BY 1),
grid AS (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL {seconds} SECOND)) AS window_start FROM agg),
win AS (SELECT g.window_start, coalesce(n_predictions, 0) AS n_predictions, avg_confidence,
   coalesce(n_low, 0) AS n_low, coalesce(n_medium, 0) AS n_medium, coalesce(n_high, 0) AS n_high, error_rate,
   CASE WHEN coalesce(n_predictions, 0) >= 10 THEN 'ok' ELSE 'insufficient' END AS status
   FROM grid g LEFT JOIN agg a ON g.window_start = a.window_start)"""


@query("str3_windowed_metrics", f"""WITH {_windows_sql(3600)}
SELECT strftime(window_start AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, n_predictions,
  round(avg_confidence, 6) AS avg_confidence, n_low, n_medium, n_high, round(error_rate, 6) AS error_rate, status FROM win""")
def str3_windowed_metrics(spark, sf):
    """STR3 (batch form) + FLT5: hourly count, tiers, confidence, error rate,
    zero-filled windows and the minimum-sample status."""
    return _windows(spark, sf).withColumn("window_start", ts_text("window_start"))


@query("alr3_monitor_alerts", f"""WITH {_windows_sql(3600)}
SELECT strftime(window_start AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, type, severity, message, round(metric_value, 6) AS metric_value FROM (
  SELECT window_start, 'LOW_CONFIDENCE' AS type, 'warning' AS severity,
    concat('Average model confidence is low: ', printf('%.2f%%', avg_confidence * 100)) AS message,
    avg_confidence AS metric_value FROM win WHERE avg_confidence < 0.7 AND status <> 'insufficient'
  UNION ALL SELECT window_start, 'NO_PREDICTIONS', 'info', 'No recent predictions detected', NULL FROM win
    WHERE n_predictions = 0)""")
def alr3_monitor_alerts(spark, sf):
    """ALR3: monitor alerts per hourly window (low confidence, no predictions, drift)."""
    return A.monitor_alerts(_windows(spark, sf)).withColumn("window_start", ts_text("window_start"))


_ALR3_SQL = f"""{_windows_sql(3600)},
alerts AS (
  SELECT window_start, 'LOW_CONFIDENCE' AS type, 'warning' AS severity FROM win
    WHERE avg_confidence < 0.7 AND status <> 'insufficient'
  UNION ALL SELECT window_start, 'NO_PREDICTIONS', 'info' FROM win WHERE n_predictions = 0)"""


@query("alr4_alert_summary", f"""WITH {_ALR3_SQL}
SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity IN ('warning', 'error')) AS active_alerts,
  strftime(max(window_start) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_alert FROM alerts""")
def alr4_alert_summary(spark, sf):
    """ALR4: totals and last alert time of the monitor alerts."""
    s, _ = A.active_alerts(A.monitor_alerts(_windows(spark, sf)))
    return s.withColumn("last_alert", ts_text("last_alert"))


@query("alr4_recent_alerts", f"""WITH {_ALR3_SQL}
SELECT strftime(window_start AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, type, severity FROM alerts
WHERE severity IN ('warning', 'error') ORDER BY window_start DESC, type DESC LIMIT 10""")
def alr4_recent_alerts(spark, sf):
    """ALR4 + FLT2: the last 10 active (warning / error) alerts."""
    _, r = A.active_alerts(A.monitor_alerts(_windows(spark, sf)))
    return r.select(ts_text("window_start").alias("window_start"), "type", "severity")


@query("alr5_sustained_low_confidence", f"""WITH {_windows_sql(3600)},
s AS (SELECT window_start, avg_confidence,
   max(avg_confidence) OVER (ORDER BY epoch(window_start) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS mx,
   count(avg_confidence) OVER (ORDER BY epoch(window_start) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS cov
   FROM win)
SELECT strftime(window_start AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, round(avg_confidence, 6) AS avg_confidence,
  coalesce(mx < 0.85 AND cov >= 2, false) AS sustained_alert FROM s""")
def alr5_sustained_low_confidence(spark, sf):
    """ALR5: confidence below 0.85 for two hours running (full coverage required)."""
    w = _windows(spark, sf).select("window_start", "avg_confidence")
    out = A.sustained_low(w, every_minutes=60)
    return out.select(ts_text("window_start").alias("window_start"), "avg_confidence",
                      F.coalesce("sustained_alert", F.lit(False)).alias("sustained_alert"))


def _by_type(spark, sf):
    """Daily volume and confidence of every event type."""
    log = SP.prediction_log(spark, sf)
    return log.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(
        F.count(F.lit(1)).alias("volume"), F.avg(S.confidence("churn_probability")).alias("avg_confidence"))


_BY_TYPE_SQL = f"""{PL},
bt AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS volume, avg({CONF_SQL}) AS avg_confidence FROM predlog GROUP BY 1, 2)"""


@query("win6_win7_by_event_type", f"""WITH {_BY_TYPE_SQL},
c AS (SELECT *, lag(volume) OVER w AS prev, first_value(avg_confidence IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base
      FROM bt WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, {ts_text_sql('day')} AS day, volume, round(avg_confidence, 6) AS avg_confidence,
  round((volume - prev) / prev, 6) AS volume_change, coalesce(abs((volume - prev) / prev) > 0.5, false) AS volume_alert,
  round(base, 6) AS accuracy_baseline, round(base - avg_confidence, 6) AS accuracy_drop,
  coalesce(base - avg_confidence > 0.05, false) AS accuracy_alert FROM c""")
def win6_win7_by_event_type(spark, sf):
    """WIN6 + WIN7 per entity: changes between the days of every event type."""
    out = M.window_changes(_by_type(spark, sf), "day", accuracy="avg_confidence", group=["event_type"])
    return out.withColumn("day", ts_text("day"))


@query("alr5_sustained_by_event_type", f"""WITH {_BY_TYPE_SQL}
SELECT event_type, {ts_text_sql('day')} AS day, round(avg_confidence, 6) AS avg_confidence,
  coalesce(max(avg_confidence) OVER w < 0.7 AND count(avg_confidence) OVER w >= 3, false) AS sustained_alert
FROM bt WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)""")
def alr5_sustained_by_event_type(spark, sf):
    """ALR5 per entity: confidence below 0.7 for three days running."""
    out = A.sustained_low(_by_type(spark, sf).select("event_type", "day", "avg_confidence"), "day", below=0.7, hours=72, every_minutes=1440,
                          group=["event_type"])
    return out.select("event_type", ts_text("day").alias("day"), "avg_confidence", F.coalesce("sustained_alert", F.lit(False)).alias("sustained_alert"))


def _volume_sql(keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""b AS (SELECT *, min(day) OVER ({part}) AS first_day,
   sum(volume) OVER ({part}ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS s FROM v),
m AS (SELECT *, CASE WHEN date_diff('day', first_day, day) >= 7 THEN coalesce(s, 0) / 7.0 END AS baseline FROM b)
SELECT {cols}{ts_text_sql('day')} AS day, volume, round(baseline, 6) AS baseline, round((volume - baseline) / nullif(baseline, 0), 6) AS above_baseline,
  coalesce((volume - baseline) / nullif(baseline, 0) > 0.15, false) AS volume_alert FROM m"""


@query("alr5_volume_above_baseline", f"""WITH {PL}, v AS (SELECT date_trunc('day', ts) AS day, count(*) AS volume FROM predlog GROUP BY 1), {_volume_sql('')}""")
def alr5_volume_above_baseline(spark, sf):
    """ALR5: days whose volume exceeds the mean of the seven days before by 15 %."""
    daily = SP.prediction_log(spark, sf).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("volume"))
    return A.volume_above_baseline(daily).withColumn("day", ts_text("day"))


@query("alr5_volume_by_user", f"""WITH {PL},
v AS (SELECT entity_id, date_trunc('day', ts) AS day, count(*) AS volume FROM predlog WHERE entity_id IS NOT NULL GROUP BY 1, 2), {_volume_sql('entity_id')}""")
def alr5_volume_by_user(spark, sf):
    """ALR5 per entity: the volume rule for every user of the log."""
    daily = (SP.prediction_log(spark, sf).where("entity_id is not null")
             .groupBy("entity_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("volume")))
    return A.volume_above_baseline(daily, group=["entity_id"]).withColumn("day", ts_text("day"))


def _daily_metrics(spark, sf):
    """One metrics row per day for the rule engine."""
    log = SP.prediction_log(spark, sf)
    g = log.agg(F.avg("value").alias("_mu"), F.stddev_samp("value").alias("_sd")).withColumn("_k", F.lit(0))
    day = F.date_trunc("day", F.col("ts")).alias("day")
    err = (F.col("event_type") == "error")
    dm = log.withColumn("_k", F.lit(0)).join(F.broadcast(g), "_k").groupBy(day).agg(
        F.avg(S.confidence("churn_probability")).alias("avg_confidence"),
        F.avg(F.when(~err, F.col("value"))).alias("prediction_latency_ms"),
        F.when(F.avg(err.cast("int")) < 0.25, "healthy").otherwise("degraded").alias("service_health"),
        F.try_divide(F.abs(F.avg("value") - F.first("_mu")), F.first("_sd")).alias("drift_score"))
    fa = M.feedback_accuracy(_feedback(spark, sf).withColumn("day", F.date_trunc("day", "feedback_ts")),
                             group=["day"]).select("day", "accuracy")
    return dm.join(fa, "day", "left")


_DM_SQL = f"""{FEEDBACK_SQL},
g AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM predlog),
dm AS (SELECT date_trunc('day', ts) AS day, avg({CONF_SQL}) AS avg_confidence,
   avg(CASE WHEN event_type <> 'error' THEN value END) AS prediction_latency_ms,
   CASE WHEN avg(CAST(event_type = 'error' AS INTEGER)) < 0.25 THEN 'healthy' ELSE 'degraded' END AS service_health,
   abs(avg(value) - any_value(mu)) / any_value(sd) AS drift_score FROM predlog, g GROUP BY 1),
fa AS (SELECT date_trunc('day', feedback_ts) AS day, avg(CAST(predicted_churn = actual_churn AS INTEGER)) AS accuracy
   FROM fb GROUP BY 1),
metrics AS (SELECT dm.*, fa.accuracy FROM dm LEFT JOIN fa ON dm.day = fa.day)"""


def _rules_sql() -> str:
    parts = []
    for name, cond, sev, desc, ch in C.ALERT_RULES:
        metric = A.metric_of(cond)
        mv = "NULL" if metric == "service_health" else f"round({metric}, 6)"
        parts.append(f"SELECT day, '{name}' AS name, '{sev}' AS severity, '{desc}' AS description, "
                     f"'{','.join(ch)}' AS notification_channels, {mv} AS metric_value FROM metrics WHERE {cond}")
    return " UNION ALL ".join(parts)


@query("alr1_rule_alerts", f"""WITH {_DM_SQL}
SELECT {ts_text_sql('day')} AS day, name, severity, description, notification_channels, metric_value
FROM ({_rules_sql()})""")
def alr1_rule_alerts(spark, sf):
    """ALR1 / JON6: configured alert rules evaluated on daily metrics."""
    return A.rule_alerts(_daily_metrics(spark, sf), keys=["day"]).withColumn("day", ts_text("day"))


@query("alr2_report_alerts", f"""WITH {_DM_SQL},
miss AS (SELECT date_trunc('day', ts) AS day, avg(CAST(event_id % 10 < day(ts) % 3 AS INTEGER)) AS missing_values_percentage FROM events GROUP BY 1),
m2 AS (SELECT metrics.day, accuracy, prediction_latency_ms, missing_values_percentage FROM metrics JOIN miss ON miss.day = metrics.day)
SELECT {ts_text_sql('day')} AS day, type, severity, message, metric_value FROM (
  SELECT day, 'performance' AS type, 'high' AS severity, 'Model accuracy below acceptable threshold (80%)' AS message,
    round(accuracy, 6) AS metric_value FROM m2 WHERE accuracy < 0.80
  UNION ALL SELECT day, 'data_quality', 'medium', 'High percentage of missing values detected',
    round(missing_values_percentage, 6) FROM m2 WHERE missing_values_percentage > 0.10
  UNION ALL SELECT day, 'system', 'medium', 'High prediction latency detected', round(prediction_latency_ms, 6)
    FROM m2 WHERE prediction_latency_ms > 500)""")
def alr2_report_alerts(spark, sf):
    """ALR2: built-in report alerts on daily metrics (values are missing in up to a
    fifth of a day's events)."""
    log = SP.prediction_log(spark, sf).withColumn("value", F.when(F.col("prediction_id") % 10 >= F.dayofmonth("ts") % 3, F.col("value")))
    gone = log.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg(F.isnull("value").cast("int")).alias("missing_values_percentage"))
    m = _daily_metrics(spark, sf).join(gone, "day")
    return A.report_alerts(m, keys=["day"]).withColumn("day", ts_text("day"))


@query("agg15_probability_histogram", f"""WITH {PL},
r AS (SELECT min(churn_probability) AS lo, max(churn_probability) AS hi FROM predlog),
b AS (SELECT least(floor((churn_probability - lo) * 20 / (hi - lo)) + 1, 20) AS bin, count(*) AS n FROM predlog, r GROUP BY 1),
g AS (SELECT unnest(range(1, 21)) AS bin, lo, hi FROM r)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + (g.bin - 1) * (hi - lo) / 20, 6) AS bin_start,
  round(lo + g.bin * (hi - lo) / 20, 6) AS bin_end, coalesce(n, 0) AS n FROM g LEFT JOIN b ON g.bin = b.bin""")
def agg15_probability_histogram(spark, sf):
    """AGG15 / SCO2: 20-bin histogram of the scored probabilities, empty bins kept."""
    return P.histogram(SP.prediction_log(spark, sf), "churn_probability", 20)


def _daily_drift_windows(spark, sf, bins=20):
    """Daily windows of the log with a drift flag: Jensen-Shannon of the day's
    binned values against the reference histogram (bins fixed from the reference)."""
    from tabulon.operators.drift import binned, binned_drift
    ref, _ = SP.reference_current(spark, sf)
    r = ref.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()   # two scalars
    lo, hi = float(r["lo"]), float(r["hi"])
    ref_hist = ref.groupBy(binned(ref, "value", lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    log = SP.prediction_log(spark, sf).withColumn("window_start", F.date_trunc("day", "ts"))
    hist = log.groupBy("window_start", binned(log, "value", lo, hi, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    dr = binned_drift(hist, ref_hist, bins).select("window_start", "jensen_shannon")
    win = M.windowed_metrics(SP.prediction_log(spark, sf), every="1 day", zero_fill=False)
    return (win.join(dr, "window_start", "left")
            .withColumn("drift_detected", F.coalesce(F.col("jensen_shannon") >= C.DRIFT_THRESHOLD, F.lit(False))))


_DAILY_DRIFT_SQL = f"""{PL},
ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{SP.DRIFT_SPLIT_TS}'),
r AS (SELECT min(value) AS lo, max(value) AS hi FROM ref),
rb AS (SELECT CAST(least(greatest(floor((value - lo) * 20 / (hi - lo)) + 1, 1), 20) AS INTEGER) AS bin, count(*) AS n
       FROM ref, r GROUP BY 1),
rp AS (SELECT bin, n / sum(n) OVER () AS p FROM rb),
h AS (SELECT date_trunc('day', ts) AS window_start,
        CAST(least(greatest(floor((value - lo) * 20 / (hi - lo)) + 1, 1), 20) AS INTEGER) AS bin, count(*) AS n
      FROM predlog, r GROUP BY 1, 2),
grid AS (SELECT DISTINCT window_start, unnest(range(1, 21)) AS bin FROM h),
c AS (SELECT g.window_start, g.bin, coalesce(h.n, 0) AS n FROM grid g LEFT JOIN h ON g.window_start = h.window_start AND g.bin = h.bin),
j AS (SELECT c.window_start, c.n, sum(c.n) OVER (PARTITION BY c.window_start) AS n_total, coalesce(rp.p, 0.0) AS p
      FROM c LEFT JOIN rp ON c.bin = rp.bin),
js AS (SELECT window_start, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + n / n_total) / 2)) ELSE 0 END
        + CASE WHEN n > 0 THEN n / n_total * log2((n / n_total) / ((p + n / n_total) / 2)) ELSE 0 END) / 2, 0)) AS jensen_shannon
      FROM j GROUP BY window_start),
win AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n_predictions, avg({CONF_SQL}) AS avg_confidence
        FROM predlog GROUP BY 1),
dw AS (SELECT win.*, CASE WHEN n_predictions >= 10 THEN 'ok' ELSE 'insufficient' END AS status,
        coalesce(js.jensen_shannon >= 0.1, false) AS drift_detected, js.jensen_shannon
       FROM win LEFT JOIN js ON win.window_start = js.window_start)"""


@query("alr3_daily_drift_alerts", f"""WITH {_DAILY_DRIFT_SQL}
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, type, severity, message, round(metric_value, 6) AS metric_value FROM (
  SELECT window_start, 'LOW_CONFIDENCE' AS type, 'warning' AS severity,
    concat('Average model confidence is low: ', printf('%.2f%%', avg_confidence * 100)) AS message,
    avg_confidence AS metric_value FROM dw WHERE avg_confidence < 0.7 AND status <> 'insufficient'
  UNION ALL SELECT window_start, 'NO_PREDICTIONS', 'info', 'No recent predictions detected', NULL FROM dw WHERE n_predictions = 0
  UNION ALL SELECT window_start, 'DATA_DRIFT_DETECTED', 'warning', 'Data drift detected in recent predictions', NULL
    FROM dw WHERE drift_detected)""")
def alr3_daily_drift_alerts(spark, sf):
    """ALR3 with all three monitor alerts: daily windows carry a drift flag
    (binned Jensen-Shannon vs the reference histogram)."""
    w = _daily_drift_windows(spark, sf)
    return A.monitor_alerts(w).withColumn("window_start", ts_text("window_start"))


@query("drf4_daily_binned_js", f"""WITH {_DAILY_DRIFT_SQL}
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, n_predictions, round(jensen_shannon, 6) AS jensen_shannon,
  drift_detected FROM dw""")
def drf4_daily_binned_js(spark, sf):
    """Per-day drift of the prediction log against the reference histogram
    (the batch form of the monitor's drift check)."""
    w = _daily_drift_windows(spark, sf)
    return w.select(ts_text("window_start").alias("window_start"), "n_predictions", "jensen_shannon", "drift_detected")


@query("agg14_recent_snapshot", f"""WITH {PL},
recent AS (SELECT * FROM predlog ORDER BY ts DESC, prediction_id DESC LIMIT {C.MONITOR_LAST_N})
SELECT count(*) AS n_predictions, round(avg({CONF_SQL}), 6) AS avg_confidence,
  count(*) FILTER (WHERE churn_probability < 0.3) AS n_low,
  count(*) FILTER (WHERE churn_probability >= 0.3 AND churn_probability < 0.7) AS n_medium,
  count(*) FILTER (WHERE churn_probability >= 0.7) AS n_high,
  CASE WHEN count(*) >= 10 THEN 'ok' ELSE 'insufficient' END AS status FROM recent""")
def agg14_recent_snapshot(spark, sf):
    """AGG14 + WIN1: tiers and average confidence of the most recent 100
    predictions (the monitor's view), with the 10-row gate."""
    from tabulon.operators.sample import last_n
    recent = last_n(SP.prediction_log(spark, sf), "ts", "prediction_id", C.MONITOR_LAST_N)
    return M.performance_snapshot(recent)
