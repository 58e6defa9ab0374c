"""Queries: streaming jobs (STR1-7).  Each stages a supplied table as files
arriving in order, runs the stream to completion (``availableNow``) with its
checkpoint in the shared folder, and returns the sink table.  Where the
result has a batch form, the oracle is that batch form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.functions import scalar as S
from tabulon.operators import alerts as A
from tabulon.operators import model as MD
from tabulon.operators import validate as V
from tabulon.operators.ordered import materialize
from tabulon.operators.score import request_features
from tabulon.plans import replay as R
from tabulon.plans.catalog import query, ts_text, ts_text_sql
from tabulon.plans.q_monitor import FEEDBACK_SQL
from tabulon.plans.q_prepare import REQ, _VIOL_SQL
from tabulon.sources import supplied as SP
from tabulon.sources.tables import decode_requests, read_table
from tabulon.streaming import jobs as J


def _staged_events(spark, sf, run, closed=False):
    ev = read_table(spark, sf, "events")
    path = R.stage_in_time_order(ev, "ts", run + "/source", slices=3, closing=R.closing_row(ev, "ts") if closed else None)
    return J.file_stream(spark, path, ev.schema, max_files=R.FILES)


def _predlog_stream(stream):
    return stream.select(F.col("event_id").alias("prediction_id"), "ts", F.col("user_id").alias("entity_id"),
                         "event_type", "value",
                         S.saturation("value", 50.0).alias("churn_probability"))


def _staged_requests(spark, sf, run):
    req = SP.request_table(spark, sf)
    path = R.stage_in_time_order(req, "customer_id", run + "/requests", slices=4, fmt="json")
    return J.file_stream(spark, path, req.schema, fmt="json", max_files=R.FILES, ts=None)


@query("str1_score_stream")
def str1_score_stream(spark, sf, _compare_with_batch=False):
    """STR1: requests arriving as JSON files are decoded, mapped to model
    columns and scored by a fitted pipeline; scored rows appended to a table."""
    run = J.new_run_dir(spark, "str1")
    batch_req = request_features(decode_requests(SP.request_table(spark, sf)))
    target = SP.entity_table(spark, sf).select(F.col("c_custkey").alias("customer_id"),
                                               F.col("churn").cast("double").alias("churn"))
    train = materialize(MD.balanced_weights(batch_req.join(target, "customer_id"), "churn"))
    num = ["Monthly Charge", "Total Charges", "Tenure in Months", "CLTV", "Age", "Satisfaction Score",
           "Phone Service", "Internet Type"]
    spec = MD.fit_feature_spec(train, num, ["Contract"])
    model = MD.fit_model(train, spec, "logistic_regression", label="churn", key="customer_id")
    stream = _staged_requests(spark, sf, run)
    scored = J.score_stream(stream, model, lambda s: request_features(decode_requests(s)), model_version="lr-1")
    w = (scored.drop("timestamp").writeStream.format("parquet").option("path", run + "/out")
         .option("checkpointLocation", run + "/ckpt").outputMode("append"))
    J.run_available(w)
    out = spark.read.parquet(run + "/out")
    if _compare_with_batch:
        from pyspark.ml.functions import vector_to_array
        batch = model.transform(batch_req).select(
            F.col("customer_id").cast("string").alias("customer_id"),
            vector_to_array("probability")[1].alias("p_batch"))
        return (out.join(batch, "customer_id", "full")
                .select(F.col("customer_id").cast("long").alias("customer_id"),
                        F.coalesce(F.abs(F.col("churn_probability") - F.col("p_batch")) < 1e-12, F.lit(False))
                        .alias("same")))
    return out


@query("str2_valid_quarantine_stream", f"""WITH {REQ}
SELECT CASE WHEN {_VIOL_SQL} = '' THEN 'valid' ELSE 'quarantine' END AS part, count(*) AS n FROM req GROUP BY 1""")
def str2_valid_quarantine_stream(spark, sf):
    """STR2: the request rules applied per micro-batch, valid and quarantined
    rows written to two sinks."""
    run = J.new_run_dir(spark, "str2")
    stream = decode_requests(_staged_requests(spark, sf, run))
    w = (stream.writeStream.foreachBatch(J.split_sink(V.request_rules(), run + "/valid", run + "/quarantine"))
         .option("checkpointLocation", run + "/ckpt"))
    J.run_available(w)
    valid = spark.read.parquet(run + "/valid").select(F.lit("valid").alias("part"))
    bad = spark.read.parquet(run + "/quarantine").select(F.lit("quarantine").alias("part"))
    return valid.unionByName(bad).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


_HOURLY_SQL = f"""{SP.PREDLOG_SQL},
w AS (SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600) AS window_start, * FROM predlog)
SELECT strftime(window_start AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_predictions,
  round(avg(greatest(churn_probability, 1 - churn_probability)), 6) AS avg_confidence,
  count(*) FILTER (WHERE churn_probability < 0.3) AS n_low,
  count(*) FILTER (WHERE churn_probability >= 0.3 AND churn_probability < 0.7) AS n_medium,
  count(*) FILTER (WHERE churn_probability >= 0.7) AS n_high,
  round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS error_rate FROM w GROUP BY window_start"""


@query("str3_window_metrics_stream", f"WITH {_HOURLY_SQL}")
def str3_window_metrics_stream(spark, sf):
    """STR3: hourly tumbling-window monitor over the event stream (append mode: a
    window is written once, when the watermark has closed it)."""
    run = J.new_run_dir(spark, "str3")
    s = _predlog_stream(_staged_events(spark, sf, run, closed=True)).withColumn("is_error", F.col("event_type") == "error")
    agg = J.window_metrics(s, every="1 hour", watermark="1 hour", error_col="is_error")
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", run + "/out")
         .option("checkpointLocation", run + "/ckpt"))
    J.run_available(w)
    return spark.read.parquet(run + "/out").withColumn("window_start", ts_text("window_start"))


def _alerts_of(spark, run, windows, upto):
    """Monitor alerts of the windows that a stream has closed; those after the
    table's last event belong to the closing row."""
    w = (windows.writeStream.outputMode("append").format("parquet").option("path", run + "/windows")
         .option("checkpointLocation", run + "/ckpt"))
    J.run_available(w, spark)
    last = F.broadcast(upto)                                                     # one row
    closed = spark.read.parquet(run + "/windows").join(last, F.col("window_start") <= F.col("last_ts"))
    return A.monitor_alerts(closed).select(ts_text("window_start").alias("window_start"), "type", "severity", "message", "metric_value")


#: a gap of half a day in the log, and a day and a half of values three times as large
GAP = ("2024-01-09 06:00:00", "2024-01-09 18:00:00")
SHIFT = ("2024-01-25 00:00:00", "2024-01-26 12:00:00")


def _staged_log(spark, sf, run, days):
    """The event log with a gap and a shift, staged in time order."""
    at = F.col("ts")
    ev = read_table(spark, sf, "events").where((at < F.lit(GAP[0]).cast("timestamp_ntz")) | (at >= F.lit(GAP[1]).cast("timestamp_ntz")))
    moved = (at >= F.lit(SHIFT[0]).cast("timestamp_ntz")) & (at < F.lit(SHIFT[1]).cast("timestamp_ntz"))
    ev = ev.withColumn("value", F.when(moved, F.col("value") * 3).otherwise(F.col("value")))
    path = R.stage_in_time_order(ev, "ts", run + "/source", slices=3, closing=R.closing_row(ev, "ts", days=days))
    return J.file_stream(spark, path, ev.schema, max_files=R.FILES), ev.agg(F.max("ts").cast("timestamp").alias("last_ts"))


_LOG_SQL = SP.PREDLOG_SQL.replace("FROM events", f"""FROM (SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '{SHIFT[0]}' AND ts < TIMESTAMP '{SHIFT[1]}'
   THEN value * 3 ELSE value END AS value) FROM events WHERE ts < TIMESTAMP '{GAP[0]}' OR ts >= TIMESTAMP '{GAP[1]}')""")


@query("str5_stream_alerts", f"""WITH {_LOG_SQL},
agg AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, avg(greatest(churn_probability, 1 - churn_probability)) AS c
        FROM predlog GROUP BY 1),
grid AS (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL 1 HOUR)) AS window_start FROM agg),
win AS (SELECT g.window_start, coalesce(n, 0) AS n, c FROM grid g LEFT JOIN agg a ON a.window_start = g.window_start)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, 'LOW_CONFIDENCE' AS type, 'warning' AS severity,
  concat('Average model confidence is low: ', printf('%.2f%%', c * 100)) AS message, round(c, 6) AS metric_value FROM win WHERE n >= 10 AND c < 0.7
UNION ALL SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S'), 'NO_PREDICTIONS', 'info', 'No recent predictions detected', NULL FROM win WHERE n = 0""")
def str5_stream_alerts(spark, sf):
    """STR5: alerts from closed hourly windows, also of the hours without rows (a
    gap of half a day is planted), which event-time timers close."""
    run = J.new_run_dir(spark, "str5")
    stream, last = _staged_log(spark, sf, run, days=1)
    windows = J.monitored_windows(_predlog_stream(stream), every="1 hour", watermark="1 hour")
    return _alerts_of(spark, run, windows, last)


@query("str5_stream_drift_alerts", f"""WITH {_LOG_SQL},
ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{SP.DRIFT_SPLIT_TS}'),
r AS (SELECT min(value) AS lo, max(value) AS hi FROM ref),
rb AS (SELECT CAST(least(greatest(floor((value - lo) * 20 / (hi - lo)) + 1, 1), 20) AS INTEGER) AS bin, count(*) AS n FROM ref, r GROUP BY 1),
p AS (SELECT bin, n / sum(n) OVER () AS p FROM rb),
h AS (SELECT date_trunc('day', ts) AS window_start, CAST(least(greatest(floor((value - lo) * 20 / (hi - lo)) + 1, 1), 20) AS INTEGER) AS bin,
        count(*) AS n FROM predlog, r GROUP BY 1, 2),
grid AS (SELECT DISTINCT window_start, unnest(range(1, 21)) AS bin FROM h),
j AS (SELECT g.window_start, coalesce(h.n, 0) / sum(coalesce(h.n, 0)) OVER (PARTITION BY g.window_start) AS q, coalesce(p.p, 0.0) AS p
      FROM grid g LEFT JOIN h ON h.window_start = g.window_start AND h.bin = g.bin LEFT JOIN p ON p.bin = g.bin),
js AS (SELECT window_start, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
         + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS d FROM j GROUP BY 1),
agg AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n, avg(greatest(churn_probability, 1 - churn_probability)) AS c FROM predlog GROUP BY 1),
days AS (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL 1 DAY)) AS window_start FROM agg),
win AS (SELECT g.window_start, coalesce(n, 0) AS n, c, d FROM days g LEFT JOIN agg a ON a.window_start = g.window_start
        LEFT JOIN js ON js.window_start = g.window_start)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, 'LOW_CONFIDENCE' AS type, 'warning' AS severity,
  concat('Average model confidence is low: ', printf('%.2f%%', c * 100)) AS message, round(c, 6) AS metric_value FROM win WHERE n >= 10 AND c < 0.7
UNION ALL SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S'), 'NO_PREDICTIONS', 'info', 'No recent predictions detected', NULL FROM win WHERE n = 0
UNION ALL SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S'), 'DATA_DRIFT_DETECTED', 'warning', 'Data drift detected in recent predictions', NULL
  FROM win WHERE d >= 0.1""")
def str5_stream_drift_alerts(spark, sf):
    """STR5 with drift: daily windows carry a histogram, whose Jensen-Shannon
    distance from the reference raises DATA_DRIFT_DETECTED (two shifted days are planted)."""
    run = J.new_run_dir(spark, "str5d")
    ref, lo, hi = _ref_range(spark, sf)
    counts = {r["bin"]: r["n"] for r in ref.groupBy(J.binned(ref, "value", lo, hi, _BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")).collect()}                                  # one number per bin
    shares = [counts.get(b + 1, 0) / sum(counts.values()) for b in range(_BINS)]
    stream, last = _staged_log(spark, sf, run, days=3)
    windows = J.monitored_windows(_predlog_stream(stream), every="1 day", watermark="1 hour", value="value", reference=shares, lo=lo, hi=hi)
    return _alerts_of(spark, run, windows, last)


_BINS = 20


def _ref_range(spark, sf):
    ref, _ = SP.reference_current(spark, sf)
    r = ref.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()   # two scalars
    return ref, float(r["lo"]), float(r["hi"])


@query("str4_sliding_drift", f"""WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{SP.DRIFT_SPLIT_TS}'),
r AS (SELECT min(value) AS lo, max(value) AS hi FROM ref),
rb AS (SELECT CAST(least(greatest(floor((value - lo) * {_BINS} / (hi - lo)) + 1, 1), {_BINS}) AS INTEGER) AS bin, count(*) AS n
       FROM ref, r GROUP BY 1),
rp AS (SELECT bin, n / sum(n) OVER () AS p FROM rb),
ev AS (SELECT ts, CAST(least(greatest(floor((value - lo) * {_BINS} / (hi - lo)) + 1, 1), {_BINS}) AS INTEGER) AS bin FROM events, r),
win AS (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS window_start, bin FROM ev, range(0, 7) t(k)),
h AS (SELECT window_start, bin, count(*) AS n FROM win GROUP BY 1, 2),
grid AS (SELECT DISTINCT window_start, unnest(range(1, {_BINS + 1})) AS bin FROM h),
c AS (SELECT g.window_start, g.bin, coalesce(h.n, 0) AS n FROM grid g LEFT JOIN h ON g.window_start = h.window_start AND g.bin = h.bin),
j AS (SELECT c.window_start, c.bin, c.n, sum(c.n) OVER (PARTITION BY c.window_start) AS n_total, coalesce(rp.p, 0.0) AS p
      FROM c LEFT JOIN rp ON c.bin = rp.bin),
k AS (SELECT *, n / n_total AS q,
        sum(p) OVER (PARTITION BY window_start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
        sum(n / n_total) OVER (PARTITION BY window_start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cq FROM j)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(any_value(n_total) AS BIGINT) AS n,
  round(max(abs(cp - cq)), 6) AS ks_binned,
  round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                         + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS jensen_shannon
FROM k GROUP BY window_start""")
def str4_sliding_drift(spark, sf):
    """STR4: 7-day windows sliding by 1 day; state is a histogram on bins fixed
    from the reference; binned KS and Jensen-Shannon per window."""
    run = J.new_run_dir(spark, "str4")
    ref, lo, hi = _ref_range(spark, sf)
    ref_hist = ref.groupBy(J.binned(ref, "value", lo, hi, _BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    s = _staged_events(spark, sf, run, closed=True)
    hist = J.sliding_histogram(s, "ts", "value", lo, hi, _BINS, watermark="2 days")
    # append mode: a closed window's bins are written once and leave the state;
    # the closing row's own windows stay open
    w = (hist.writeStream.outputMode("append").format("parquet").option("path", run + "/bins")
         .option("checkpointLocation", run + "/ckpt"))
    J.run_available(w)
    return J.binned_drift(spark.read.parquet(run + "/bins"), ref_hist, _BINS).withColumn("window_start", ts_text("window_start"))


@query("str6_stream_feedback_join", f"""WITH {FEEDBACK_SQL}
SELECT entity_id, prediction_id, feedback_id, {ts_text_sql('ts')} AS ts, {ts_text_sql('feedback_ts')} AS feedback_ts,
  predicted_churn, actual_churn FROM fb""")
def str6_stream_feedback_join(spark, sf):
    """STR6: each prediction matched with its first later feedback within a day,
    on the stream (state per user in map entries, settled by event-time timers; the
    closing row moves the watermark past the last horizon)."""
    run = J.new_run_dir(spark, "str6")
    s = _predlog_stream(_staged_events(spark, sf, run, closed=True))
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 0).otherwise(-1)
    both = s.where(F.col("event_type").isin("view", "purchase") | F.col("event_type").isNull()).select(
        "entity_id", "ts", kind.alias("kind"),
        F.col("prediction_id").alias("row_id"), (F.col("churn_probability") >= 0.5).alias("flag"))
    out = J.stream_feedback_match(both, "entity_id", "ts", "kind", "row_id", "flag", "1 day", "1 hour")
    w = (out.writeStream.format("parquet").option("path", run + "/out")
         .option("checkpointLocation", run + "/ckpt").outputMode("append"))
    J.run_available(w, spark)
    return (spark.read.parquet(run + "/out").withColumn("ts", ts_text("ts"))
            .withColumn("feedback_ts", ts_text("feedback_ts")))


@query("str6_out_of_order", f"""WITH {FEEDBACK_SQL}
SELECT entity_id, prediction_id, feedback_id, {ts_text_sql('ts')} AS ts, {ts_text_sql('feedback_ts')} AS feedback_ts,
  predicted_churn, actual_churn FROM fb""")
def str6_out_of_order(spark, sf):
    """STR6 on input that arrives by user and not by time, so truths come before
    their predictions and later truths before earlier ones; the watermark spans
    the table, and the result is that of the batch join."""
    run = J.new_run_dir(spark, "str6o")
    ev = read_table(spark, sf, "events")
    R.stage_in_time_order(ev.where("user_id is not null"), "user_id", run + "/source", slices=3)
    R.closing_row(ev, "ts", days=365).write.mode("append").parquet(run + "/source")
    s = _predlog_stream(J.file_stream(spark, run + "/source", ev.schema, max_files=R.FILES))
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 0).otherwise(-1)
    both = s.where(F.col("event_type").isin("view", "purchase") | F.col("event_type").isNull()).select(
        "entity_id", "ts", kind.alias("kind"), F.col("prediction_id").alias("row_id"), (F.col("churn_probability") >= 0.5).alias("flag"))
    out = J.stream_feedback_match(both, "entity_id", "ts", "kind", "row_id", "flag", "1 day", "200 days")
    J.run_available(out.writeStream.format("parquet").option("path", run + "/out")
                    .option("checkpointLocation", run + "/ckpt").outputMode("append"), spark)
    return (spark.read.parquet(run + "/out").withColumn("ts", ts_text("ts"))
            .withColumn("feedback_ts", ts_text("feedback_ts")))


@query("str7_latest_n", f"""{SP.PREDLOG_SQL.replace('predlog AS (', 'WITH predlog AS (', 1)}
SELECT prediction_id, {ts_text_sql('ts')} AS ts, entity_id, round(churn_probability, 6) AS churn_probability
FROM predlog ORDER BY ts DESC, prediction_id DESC LIMIT 1000""")
def str7_latest_n(spark, sf):
    """STR7: the bounded log of the newest 1000 predictions, maintained as a delta
    per micro-batch and snapshots that fold them."""
    run = J.new_run_dir(spark, "str7")
    s = _predlog_stream(_staged_events(spark, sf, run)).select(
        "prediction_id", "ts", "entity_id", "churn_probability")
    w = (s.writeStream.foreachBatch(J.latest_n_sink(run + "/log", "ts", "prediction_id", C.LOG_CAPACITY, compact_every=2))
         .option("checkpointLocation", run + "/ckpt"))
    J.run_available(w)
    return J.latest_n(spark, run + "/log", "ts", "prediction_id", C.LOG_CAPACITY).withColumn("ts", ts_text("ts"))


@query("str1_stream_equals_batch", "SELECT c_custkey AS customer_id, true AS same FROM customer")
def str1_stream_equals_batch(spark, sf):
    """STR1 vs batch: every request scored on the stream gets exactly the
    probability the same fitted pipeline gives it in batch."""
    return str1_score_stream(spark, sf, _compare_with_batch=True)
