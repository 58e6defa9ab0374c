"""Streams: out-of-order input, and handlers that meet an epoch twice."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tabulon.streaming import jobs as J

T0 = datetime(2024, 1, 10, 12, 0)
SCHEMA = "entity_id long, ts timestamp, kind int, row_id long, flag boolean"


def _at(minutes):
    return T0 + timedelta(minutes=minutes)


def _feed(spark, run, files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(run + "/in")
    s = J.file_stream(spark, run + "/in", spark.createDataFrame([], SCHEMA).schema)
    out = J.stream_feedback_match(s, "entity_id", "ts", "kind", "row_id", "flag", "1 day", "1 hour")
    J.run_available(out.writeStream.format("parquet").option("path", run + "/out").option("checkpointLocation", run + "/ckpt"), spark)
    return sorted((r.prediction_id, r.feedback_id) for r in spark.read.parquet(run + "/out").collect())


def test_feedback_in_any_order(spark):
    run = J.new_run_dir(spark, "t6")
    files = [
        [(7, _at(30), 0, 100, True), (8, _at(50), 0, 201, True)],                       # truths first
        [(7, _at(10), 1, 1, True), (8, _at(20), 1, 2, False)],                          # their predictions
        [(8, _at(30), 0, 200, True), (9, _at(0), 1, 3, True), (9, _at(60 * 25), 0, 300, True)],   # an earlier truth; one too late
        [(9, _at(60 * 24 - 1), 0, 299, True), (5, _at(40), 1, 4, True), (5, _at(40), 0, 400, True)],
        [(1, _at(60 * 24 * 30), -1, 0, None)],                                          # closes
    ]
    assert _feed(spark, run, files) == [(1, 100), (2, 200), (3, 299), (4, 400)]


def test_a_busy_user_is_cut_by_time(spark):
    run = J.new_run_dir(spark, "t6b")
    rows = [(1, _at(m), m % 3 == 0, m, True) for m in range(0, 1400)]
    rows = [(e, t, 1 if k else 0, i, f) for e, t, k, i, f in rows]
    want = sorted((m, m + 1) for m in range(0, 1399, 3))
    assert _feed(spark, run, [rows, [(2, _at(60 * 24 * 30), -1, 0, None)]]) == want


def test_repeated_epochs_change_nothing(spark):
    run = J.new_run_dir(spark, "t2")
    batch = spark.createDataFrame([(i, _at(i), i) for i in range(12)], "id long, ts timestamp, n_predictions long")
    windows = batch.select(F.col("ts").alias("window_start"), F.lit(50).alias("n_predictions"), F.lit(0.6).alias("avg_confidence"))
    alerts = J.alert_sink(run + "/alerts")
    latest = J.latest_n_sink(run + "/log", "ts", "id", 5)
    whole = J.overwrite_sink(run + "/whole")
    split = J.split_sink([("small", F.col("id") < 4)], run + "/valid", run + "/bad")

    def state():
        return (spark.read.parquet(run + "/alerts").count(), sorted(r.id for r in J.latest_n(spark, run + "/log", "ts", "id", 5).collect()),
                spark.read.parquet(J.latest_version(spark, run + "/whole")).count(),
                spark.read.parquet(run + "/valid").count(), spark.read.parquet(run + "/bad").count())
    for handler, rows in ((alerts, windows), (latest, batch), (whole, batch), (split, batch)):
        handler(rows.where("1 = 1"), 0)
        handler(rows, 1)
    once = state()
    for handler, rows in ((alerts, windows), (latest, batch), (whole, batch), (split, batch)):
        handler(rows, 1)
    assert state() == once
    # a failed write of a later version leaves the readers the last complete one
    assert J.latest_version(spark, run + "/whole", below=1).endswith("v00000000")


def test_the_log_is_deltas_that_are_folded_and_retired(spark):
    run = J.new_run_dir(spark, "t7")
    sink = J.latest_n_sink(run, "ts", "id", 5, compact_every=3)
    rows = spark.createDataFrame([(i, _at(i)) for i in range(60)], "id long, ts timestamp")
    assert J.latest_n(spark, run, "ts", "id", 5) is None
    for epoch in range(12):
        sink(rows.where(F.col("id").between(epoch * 4, epoch * 4 + 3)), epoch)
        newest = list(range(max(0, epoch * 4 - 1), epoch * 4 + 4))
        assert sorted(r.id for r in J.latest_n(spark, run, "ts", "id", 5).collect()) == newest
    # epochs 3, 6 and 9 folded what lay below them; all before the last but one snapshot is gone
    assert J._complete(spark, run + "/snapshots", "v") == [6, 9]
    assert J._complete(spark, run + "/deltas", "d") == [6, 7, 8, 9, 10, 11]
    assert spark.read.parquet(run + "/deltas/d00000011").count() == 4              # a batch rewrites no more than itself
    sink(rows.where(F.col("id").between(36, 39)), 9)                                 # a repeated epoch
    assert sorted(r.id for r in J.latest_n(spark, run, "ts", "id", 5).collect()) == [43, 44, 45, 46, 47]


def _closed(spark, files, **kw):
    run = J.new_run_dir(spark, "t5")
    schema = "entity_id long, ts timestamp, value double, churn_probability double"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(run + "/in")
    s = J.file_stream(spark, run + "/in", spark.createDataFrame([], schema).schema)
    w = J.monitored_windows(s, every="1 hour", watermark="10 minutes", **kw)
    J.run_available(w.writeStream.format("parquet").option("path", run + "/out").option("checkpointLocation", run + "/ckpt").outputMode("append"), spark)
    return spark.read.parquet(run + "/out").orderBy("monitor", "window_start").collect()


def test_windows_without_rows_are_closed_by_timers(spark):
    files = [[(1, _at(m), 5.0, 0.9) for m in range(0, 60, 5)], [(1, _at(250), 5.0, 0.8)], [(None, _at(500), None, None)]]
    got = _closed(spark, files)
    assert [(r.window_start, r.n_predictions, r.status) for r in got] == [
        (_at(60 * h), n, "ok" if n >= 10 else "insufficient") for h, n in enumerate([12, 0, 0, 0, 1, 0, 0, 0])]
    assert got[1].avg_confidence is None and abs(got[4].avg_confidence - 0.8) < 1e-12


def test_drift_of_windows_by_monitor(spark):
    files = [[(e, _at(m), v, 0.9) for e, v in ((1, 0.5), (2, 3.5)) for m in range(12)], [(None, _at(300), None, None)]]
    got = _closed(spark, files, value="value", reference=[0.5, 0.5, 0.0, 0.0], lo=0.0, hi=4.0, key="entity_id")
    first = {r.monitor: r for r in got if r.n_predictions}
    assert set(first) == {"1", "2"} and all(r.drift_detected == (r.n_predictions > 0) for r in got)
    assert abs(first["2"].jensen_shannon - 1.0) < 1e-12                             # no common bin
    assert abs(first["1"].jensen_shannon - (0.5 * (0.5 * __import__("math").log2(0.5 / 0.75) + 0.5) + 0.5 * __import__("math").log2(1 / 0.75)) ** 0.5) < 1e-12
    assert all(r.jensen_shannon is None for r in got if not r.n_predictions)


def test_state_grows_by_buckets_and_not_by_users(spark):
    from tabulon.streaming.state import KEY_BUCKETS
    run = J.new_run_dir(spark, "t6u")
    schema = "entity_id string, ts timestamp, kind int, row_id string, flag boolean"
    n = 3000
    first = [(f"u{i}", _at(i % 50), 1, f"p{i}", None if i % 3 else True) for i in range(n)]
    then = [(f"u{i}", _at(50 + i % 9), 0, f"t{i}{x}", i % 2 == 0) for i in range(0, n, 2) for x in "ba"] + first[:5]
    for rows in (first, then, [("z", _at(60 * 24 * 30), -1, "z", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(run + "/in")
    s = J.file_stream(spark, run + "/in", spark.createDataFrame([], schema).schema)
    out = J.stream_feedback_match(s, "entity_id", "ts", "kind", "row_id", "flag", "1 day", "1 hour")
    q = J.run_available(out.writeStream.format("parquet").option("path", run + "/out").option("checkpointLocation", run + "/ckpt"), spark)
    got = {(r.entity_id, r.prediction_id, r.feedback_id, r.predicted_churn, r.actual_churn) for r in spark.read.parquet(run + "/out").collect()}
    assert got == {(f"u{i}", f"p{i}", f"t{i}a", None if i % 3 else True, True) for i in range(0, n, 2)}
    states = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert 0 < max(states) <= 6 * KEY_BUCKETS                       # blocks, their count and timers of one slice
