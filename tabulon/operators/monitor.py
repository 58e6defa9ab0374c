"""Monitoring of a prediction log and a request log (AGG13-18, AGG20, AGG22,
WIN6-7, JON1, FLT5, SCO2).

Windowed metrics are grouped aggregates; comparisons between windows run
over the aggregated windows (one row per window, bounded by the time span,
not by the data).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.functions import scalar as S
from tabulon.operators.ordered import exact_quantiles, first_after, lagged


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def tier_distribution(df: DataFrame, prob: str = "churn_probability",
                      group: Sequence[str] = ()) -> DataFrame:
    """AGG13: (risk_level, n, share) with a zero row for every absent tier."""
    g = list(group)
    counts = df.groupBy(*g, S.risk_tier(prob).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))
    tiers = F.array(*[F.lit(t) for t in C.TIERS])
    if g:
        keys = df.select(*g).distinct()
        grid = keys.select(*g, F.explode(tiers).alias("risk_level"))
    else:
        grid = df.sparkSession.range(1).select(F.explode(tiers).alias("risk_level"))
    j = grid.join(counts, g + ["risk_level"], "left").select(
        *g, "risk_level", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0)))
    return j.select(*g, "risk_level", "n", _div(F.col("n"), total).alias("share"))


def performance_snapshot(df: DataFrame, prob: str = "churn_probability",
                         min_rows: int = C.MIN_PERFORMANCE_SAMPLES) -> DataFrame:
    """AGG14 + FLT5: count, average confidence, tier counts and a status that is
    ``insufficient`` below ``min_rows`` (metrics then null) - one aggregate."""
    tier = S.risk_tier(prob)
    agg = df.agg(F.count(F.lit(1)).alias("n_predictions"),
                 F.avg(S.confidence(prob)).alias("avg_confidence"),
                 *[F.count_if(tier == t).alias(f"n_{t.lower()}") for t in C.TIERS])
    ok = F.col("n_predictions") >= min_rows
    return agg.select(
        "n_predictions",
        F.when(ok, F.col("avg_confidence")).alias("avg_confidence"),
        *[F.col(f"n_{t.lower()}") for t in C.TIERS],
        F.when(ok, "ok").otherwise("insufficient").alias("status"))


def latency_summary(log: DataFrame, duration: str = "duration_ms", status: str = "status",
                    ts: str = "ts", group: Sequence[str] = ()) -> DataFrame:
    """AGG16: totals, success %, requests per second over the logged span,
    min / max / mean / median / p95 / p99 of successful requests (exact,
    interpolated percentiles like NumPy)."""
    g = list(group)
    ok = F.col(status) == "success"
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp")))
            - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
    agg = log.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(ok).alias("successful_requests"),
        F.count_if(~ok).alias("failed_requests"), span.alias("duration_seconds"),
        F.min(F.when(ok, F.col(duration))).alias("min_ms"),
        F.max(F.when(ok, F.col(duration))).alias("max_ms"),
        F.avg(F.when(ok, F.col(duration))).alias("mean_ms"))
    succ = log.where(ok).select(*g, F.col(duration).cast("double").alias("v"))
    qs = exact_quantiles(succ, "v", [0.5, 0.95, 0.99], g, groups_bounded=None if g else True)
    qw = qs.groupBy(*g).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n)
                              for p, n in ((0.5, "median_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))])
    if g:
        j = agg.join(qw, g, "left")
    else:
        j = agg.withColumn("_k", F.lit(0)).join(qw.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")
    return j.select(*g, "total_requests", "successful_requests", "failed_requests",
                    (_div(F.col("successful_requests"), F.col("total_requests")) * 100).alias("success_rate"),
                    _div(F.col("total_requests"), F.col("duration_seconds")).alias("requests_per_second"),
                    "min_ms", "max_ms", "mean_ms", "median_ms", "p95_ms", "p99_ms")


def level_summary(log: DataFrame, level: str = "level", status: str = "status", ts: str = "ts",
                  pass_rate: float = C.LOAD_TEST_PASS_RATE) -> DataFrame:
    """AGG17: success % and rate per concurrency level, with the pass gate."""
    ok = F.col(status) == "success"
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp")))
            - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
    agg = log.groupBy(level).agg(F.count(F.lit(1)).alias("total_requests"),
                                 F.count_if(ok).alias("successful_requests"), span.alias("_span"))
    rate = _div(F.col("successful_requests"), F.col("total_requests")) * 100
    return agg.select(level, "total_requests", "successful_requests", rate.alias("success_rate"),
                      _div(F.col("total_requests"), F.col("_span")).alias("requests_per_second"),
                      (rate > pass_rate).alias("passed"))


def check_rollup(checks: DataFrame, status: str = "status", passed_value: str = "SUCCESS") -> DataFrame:
    """AGG18: total, passed, failed, success rate over check results."""
    ok = F.col(status) == passed_value
    agg = checks.agg(F.count(F.lit(1)).alias("total_checks"), F.count_if(ok).alias("passed"))
    return agg.select("total_checks", "passed", (F.col("total_checks") - F.col("passed")).alias("failed"),
                      (_div(F.col("passed"), F.col("total_checks")) * 100).alias("success_rate"))


def feedback_join(pred: DataFrame, truth: DataFrame, key: str, pred_ts: str, truth_ts: str,
                  horizon_days: int = 1, truth_id: str | None = None, per_range: int | None = None) -> DataFrame:
    """JON1: every prediction matched with the first truth of the same key at
    or after its time and within ``horizon_days`` (ties: smallest ``truth_id``).

    An as-of match, so the output has at most one row per prediction - no pairs
    are enumerated and no row is copied.  Both sides are tagged, unioned and
    scanned by ``ordered.first_after``, which cuts a heavy key into time ranges of
    equal row counts (``per_range`` fixes their size), so a key that owns a third of
    one day is spread like any other.  Rows without a key or a time match nothing.
    Result columns: the prediction's columns, then the truth's.
    """
    truth_id = truth_id or truth.columns[0]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    p_struct = F.struct(*[F.col(c) for c in pred.columns])
    a_struct = F.struct(micros(truth_ts).alias("t"), F.col(truth_id).alias("id"), F.struct(*[F.col(c) for c in truth.columns]).alias("a"))
    p_type, a_type = pred.select(p_struct.alias("s")).schema["s"].dataType, truth.select(a_struct.alias("s")).schema["s"].dataType
    p = pred.select(F.col(key).alias("_key"), micros(pred_ts).alias("_t"), p_struct.alias("_p"), F.lit(None).cast(a_type).alias("_a"))
    a = truth.select(F.col(key).alias("_key"), micros(truth_ts).alias("_t"), F.lit(None).cast(p_type).alias("_p"), a_struct.alias("_a"))
    m = first_after(p.unionByName(a), "_key", "_t", "_a", per_range)
    m = m.where(F.col("_p").isNotNull() & (F.col("first_after.t") - F.col("_t") <= horizon_days * 86_400_000_000))
    return m.select(*[F.col(f"_p.{c}").alias(c) for c in pred.columns],
                    *[F.col(f"first_after.a.{c}").alias(c) for c in truth.columns if c not in pred.columns])


def feedback_accuracy(matched: DataFrame, predicted: str = "predicted_churn",
                      actual: str = "actual_churn", group: Sequence[str] = ()) -> DataFrame:
    """AGG20: n matched and accuracy = avg(predicted == actual)."""
    return matched.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_feedback"),
        F.avg((F.col(predicted) == F.col(actual)).cast("int")).alias("accuracy"))


def daily_trend(log: DataFrame, ts: str = "ts", prob: str = "churn_probability",
                feedback: DataFrame | None = None, feedback_ts: str = "feedback_ts") -> DataFrame:
    """AGG22: per day volume, average confidence, high-risk share and (when
    feedback is given) accuracy of the feedback received that day."""
    day = F.date_trunc("day", F.col(ts)).alias("day")
    t = log.groupBy(day).agg(F.count(F.lit(1)).alias("volume"),
                             F.avg(S.confidence(prob)).alias("avg_confidence"),
                             F.avg((S.risk_tier(prob) == "High").cast("int")).alias("high_risk_share"))
    if feedback is not None:
        fa = feedback_accuracy(feedback.withColumn("day", F.date_trunc("day", F.col(feedback_ts))),
                               group=["day"])
        t = t.join(fa.select("day", "accuracy"), "day", "left")
    return t


#: hours of window rows that one task of a comparison between windows holds
COMPARISON_HOURS = 24 * 365


def window_changes(per_window: DataFrame, window_col: str, volume: str = "volume",
                   accuracy: str | None = "accuracy", volume_change: float = C.VOLUME_CHANGE,
                   accuracy_drop: float = C.ACCURACY_DROP, group: Sequence[str] = ()) -> DataFrame:
    """WIN6 + WIN7 over aggregated windows, per ``group`` when given: relative
    volume change vs the previous window (flag above 50 %) and accuracy drop vs
    the first window with an accuracy as baseline (flag above 0.05).

    Windows are compared in buckets of a year with a carry between them
    (``ordered.lagged``); the baseline is an aggregate, not a frame."""
    g = list(group)
    out = lagged(per_window.withColumn("_o", F.unix_micros(F.col(window_col).cast("timestamp"))), "_o", [volume], g,
                 COMPARISON_HOURS * 3_600_000_000)
    prev = F.col(f"previous_{volume}")
    change = F.try_divide((F.col(volume) - prev).cast("double"), prev.cast("double"))
    out = out.withColumn("volume_change", change).drop(f"previous_{volume}")
    out = out.withColumn("volume_alert", F.coalesce(F.abs("volume_change") > volume_change, F.lit(False)))
    if accuracy:
        known = F.col(accuracy).isNotNull()
        base = out.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)]).agg(
            F.min_by(accuracy, F.when(known, F.col("_o"))).alias("_base"), F.min(F.when(known, F.col("_o"))).alias("_from"))
        same = F.lit(True)
        for i, c in enumerate(g):
            same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
        out = out.join(base if g else F.broadcast(base), same, "left")                   # without groups: one row
        out = out.withColumn("accuracy_baseline", F.when(F.col("_o") >= F.col("_from"), F.col("_base")))
        out = out.withColumn("accuracy_drop", F.col("accuracy_baseline") - F.col(accuracy))
        out = out.withColumn("accuracy_alert",
                             F.coalesce(F.col("accuracy_drop") > accuracy_drop, F.lit(False)))
        out = out.drop("_base", "_from", *[f"_g{i}" for i in range(len(g))])
    return out.drop("_o")


def window_grid(df: DataFrame, ts: str, every: str = C.MONITOR_WINDOW) -> DataFrame:
    """All window starts between the first and last event (for zero-filled
    windows).  Size = time span / window length, independent of row count;
    generated by ``spark.range`` so it is spread over tasks."""
    rng = df.agg(F.unix_micros(F.min(F.window(F.col(ts), every).start)).alias("lo"),
                 F.unix_micros(F.max(F.window(F.col(ts), every).start)).alias("hi")).first()  # 2 scalars
    if rng["lo"] is None:
        return df.sparkSession.range(0).select(F.lit(None).cast("timestamp").alias("window_start"))
    step = duration_micros(every)
    n = (rng["hi"] - rng["lo"]) // step + 1
    return df.sparkSession.range(n).select(
        F.timestamp_micros(F.lit(rng["lo"]) + F.col("id") * F.lit(step)).alias("window_start"))


def duration_micros(every: str) -> int:
    """A fixed window length like '5 minutes' or '1 hour' in microseconds."""
    n, unit = every.split()[:2]
    per = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.lower().rstrip("s")]
    return int(float(n) * per * 1_000_000)


def windowed_metrics(log: DataFrame, ts: str = "ts", prob: str = "churn_probability",
                     every: str = C.MONITOR_WINDOW, min_rows: int = C.MIN_PERFORMANCE_SAMPLES,
                     error_col: str | None = None, zero_fill: bool = True) -> DataFrame:
    """STR3 batch form: per tumbling window count, tiers, avg confidence,
    error share; windows without rows appear with count 0 when ``zero_fill``."""
    t = log.withColumn("_t", F.col(ts).cast("timestamp"))
    tier = S.risk_tier(prob)
    aggs = [F.count(F.lit(1)).alias("n_predictions"), F.avg(S.confidence(prob)).alias("avg_confidence"),
            *[F.count_if(tier == x).alias(f"n_{x.lower()}") for x in C.TIERS]]
    if error_col:
        aggs.append(F.avg(F.col(error_col).cast("int")).alias("error_rate"))
    per = t.groupBy(F.window("_t", every).start.alias("window_start")).agg(*aggs)
    if zero_fill:
        grid = window_grid(t, "_t", every)
        per = grid.join(per, "window_start", "left").fillna(
            0, subset=["n_predictions"] + [f"n_{x.lower()}" for x in C.TIERS])
    return per.withColumn("status", F.when(F.col("n_predictions") >= min_rows, "ok")
                          .otherwise("insufficient"))
