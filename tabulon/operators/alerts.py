"""Rule-driven alerts (ALR1-5, JON6).

Rules are data: (name, condition, severity, description, channels).  The
conditions are SQL boolean expressions over named metric columns, parsed by
Spark (``F.expr``) and checked to be boolean before use.  All rules are
evaluated in a single pass over the metric rows: each row carries an array of
(rule, fired) structs that is exploded and filtered.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import config as C
from tabulon.operators.ordered import trailing
from tabulon.operators.sample import last_n


def _check_boolean(df: DataFrame, cond: str) -> Column:
    e = F.expr(cond)
    dt = df.select(e.alias("_c")).schema["_c"].dataType
    if not isinstance(dt, T.BooleanType):
        raise ValueError(f"alert condition is not boolean: {cond!r}")
    return e


def evaluate_rules(metrics: DataFrame, rules: Sequence[tuple], keys: Sequence[str] = (),
                   value_of: dict | None = None, status_col: str | None = None) -> DataFrame:
    """ALR1: alert rows (keys..., name, severity, description, channels, metric_value).

    ``rules`` are (name, condition, severity, description, channels) with
    conditions over columns of ``metrics``.  With ``status_col``, rows whose
    status is ``insufficient`` raise no metric alert (B18).
    """
    value_of = value_of or {}
    items = []
    for name, cond, severity, desc, channels in rules:
        fired = F.coalesce(_check_boolean(metrics, cond), F.lit(False))
        if status_col:
            fired = fired & (F.col(status_col) != "insufficient")
        metric = value_of.get(name)
        items.append(F.struct(
            F.lit(name).alias("name"), fired.alias("fired"), F.lit(severity).alias("severity"),
            F.lit(desc).alias("description"),
            F.lit(",".join(channels)).alias("notification_channels"),
            (F.col(metric).cast("double") if metric else F.lit(None).cast("double")).alias("metric_value")))
    out = metrics.select(*keys, F.inline(F.array(*items)))
    return out.where("fired").drop("fired")


def metric_of(cond: str) -> str:
    """The metric a simple ``metric <op> value`` condition tests."""
    return cond.split()[0]


def rule_alerts(metrics: DataFrame, keys: Sequence[str] = (), rules=C.ALERT_RULES) -> DataFrame:
    """ALR1 with the configured alert rules."""
    vals = {n: metric_of(c) for n, c, *_ in rules if metric_of(c) in metrics.columns
            and not isinstance(metrics.schema[metric_of(c)].dataType, T.StringType)}
    return evaluate_rules(metrics, rules, keys, vals)


def report_alerts(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ALR2: the built-in report alerts (accuracy, missing share, latency)."""
    rules = [(t, cond, sev, msg, ()) for t, cond, sev, msg, _ in C.REPORT_ALERTS]
    vals = {t: m for t, _, _, _, m in C.REPORT_ALERTS}
    out = evaluate_rules(metrics, rules, keys, vals)
    return out.select(*keys, F.col("name").alias("type"), "severity",
                      F.col("description").alias("message"), "metric_value")


def monitor_alerts(windows: DataFrame, keys: Sequence[str] = ("window_start",)) -> DataFrame:
    """ALR3: LOW_CONFIDENCE, NO_PREDICTIONS, DATA_DRIFT_DETECTED per window.

    An ``insufficient`` window raises no LOW_CONFIDENCE (its average is not
    trusted) but still raises NO_PREDICTIONS when empty."""
    rules = [(t, cond, sev, msg, ()) for t, cond, sev, msg in C.MONITOR_ALERTS]
    w = windows
    if "drift_detected" not in w.columns:
        w = w.withColumn("drift_detected", F.lit(False))
    suff = F.col("status") != "insufficient"
    items = []
    for name, cond, sev, msg, _ in rules:
        fired = F.coalesce(_check_boolean(w, cond), F.lit(False))
        if name == "LOW_CONFIDENCE":
            fired = fired & suff
            value = F.col("avg_confidence").cast("double")
            text = F.concat(F.lit(msg + ": "), F.format_string("%.2f%%", F.col("avg_confidence") * 100))
        else:
            value = F.lit(None).cast("double")
            text = F.lit(msg)
        items.append(F.struct(F.lit(name).alias("type"), fired.alias("fired"),
                              F.lit(sev).alias("severity"), text.alias("message"),
                              value.alias("metric_value")))
    out = w.select(*keys, F.inline(F.array(*items)))
    return out.where("fired").drop("fired")


def active_alerts(alerts: DataFrame, ts: str = "window_start", id_col: str = "type",
                  n: int = C.HEALTH_LAST_N) -> tuple[DataFrame, DataFrame]:
    """ALR4: (summary row: total, warning+error count, last alert time;
    the last ``n`` alerts of severity warning or error)."""
    from tabulon.operators.clean import keep_severities
    summary = alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                         F.count_if(F.col("severity").isin("warning", "error")).alias("active_alerts"),
                         F.max(ts).alias("last_alert"))
    recent = last_n(keep_severities(alerts), ts, id_col, n)
    return summary, recent


def _seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("long")


def sustained_low(windows: DataFrame, ts: str = "window_start", value: str = "avg_confidence",
                  below: float = 0.85, hours: int = 2, every_minutes: int = 5, group: Sequence[str] = ()) -> DataFrame:
    """ALR5: windows whose trailing ``hours`` all had ``value`` below ``below``
    (max over the range < cut) and the range is fully covered by windows, per
    ``group`` when given.

    The range frame runs over aggregated windows (one row per window) in buckets
    of days with halo rows (``ordered.trailing``)."""
    back = hours * 3600 - every_minutes * 60
    out = trailing(windows.withColumn("_o", _seconds(ts)), "_o", back, {"_mx": F.max(value), "_cov": F.count(value)}, group, 30 * 86400)
    need = hours * 60 // every_minutes
    return out.withColumn("sustained_alert", (F.col("_mx") < below) & (F.col("_cov") >= need)
                          ).drop("_mx", "_cov", "_o")


def volume_above_baseline(daily: DataFrame, ts: str = "day", volume: str = "volume", above: float = C.VOLUME_ABOVE_BASELINE,
                          days: int = C.BASELINE_DAYS, group: Sequence[str] = ()) -> DataFrame:
    """ALR5: a day's volume against its baseline, the mean of the ``days`` calendar
    days before it (days without rows count 0, the table's first day begins the
    history; no baseline before ``days`` of it), per ``group`` when given; flagged
    when the volume exceeds the baseline by more than ``above``."""
    g = list(group)
    d = daily.withColumn("_o", F.floor(_seconds(ts) / F.lit(86400)).cast("long"))
    start = d.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)]).agg(F.min("_o").alias("_from"))
    same = F.lit(True)
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = trailing(d, "_o", days, {"_sum": F.sum(volume)}, g, 365).join(start if g else F.broadcast(start), same)
    mean = (F.col("_sum") - F.col(volume)).cast("double") / F.lit(days)
    out = out.withColumn("baseline", F.when(F.col("_o") - F.col("_from") >= days, mean))
    out = out.withColumn("above_baseline", F.try_divide(F.col(volume) - F.col("baseline"), F.col("baseline")))
    out = out.withColumn("volume_alert", F.coalesce(F.col("above_baseline") > above, F.lit(False)))
    return out.drop("_o", "_from", "_sum", *[f"_g{i}" for i in range(len(g))])
