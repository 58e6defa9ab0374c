"""Structured Streaming jobs (STR1-7) built on the batch operators.

Every job reads with ``readStream`` (file source here; any source works),
keeps its state in a checkpoint under the shared checkpoint folder, and writes
to files, so a restarted query resumes exactly where it stopped.  ``foreachBatch``
handlers write one folder per epoch with overwrite, so a repeated epoch replaces
its own rows; results that are replaced as a whole are versions, of which
readers take the newest complete one.
"""

from __future__ import annotations

import os
import uuid
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import config as C
from tabulon.functions import scalar as S
from tabulon.operators import alerts as A
from tabulon.operators import sample as SM
from tabulon.operators import validate as V
from tabulon.operators.drift import binned, binned_drift  # noqa: F401  (used by callers too)
from tabulon.operators.monitor import duration_micros
from tabulon.session import scratch_path
from tabulon.streaming.state import filled_windows, first_truths


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one streaming run."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int = 1, ts: str | None = "ts") -> DataFrame:
    """A file-source stream; ``ts`` is cast to TIMESTAMP (session zone UTC)
    because watermarks reject TIMESTAMP_NTZ."""
    s = (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path))
    if ts and ts in s.columns:
        s = s.withColumn(ts, F.col(ts).cast("timestamp"))
    return s


#: The state store of operators with map state and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream_writer, spark: SparkSession | None = None):
    """Run a ``DataStreamWriter`` over everything available, to its end; a
    failed stream raises.

    With ``spark`` the query keeps its state in RocksDB, as the operators of
    ``streaming.state`` need (a deployment sets ``STATE_STORE``), in at most two
    partitions per core: every one of them starts a store and a Python worker in
    each micro-batch."""
    parts = "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (STATE_STORE, parts)} if spark else {}
    try:
        if spark:
            spark.conf.set(STATE_STORE, ROCKSDB)
            spark.conf.set(parts, str(min(int(before[parts]), 2 * spark.sparkContext.defaultParallelism)))
        q = stream_writer.trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def after_clock(stream: DataFrame, ts: str, keep: Column) -> DataFrame:
    """Rows with an event time that satisfy ``keep``, chosen after the watermark
    has seen all rows: a condition that names the event time is not pushed below."""
    return stream.where(F.when(F.col(ts).isNotNull(), keep).otherwise(False))


def duration_millis(every: str) -> int:
    return duration_micros(every) // 1000


def epoch_path(base: str, epoch: int) -> str:
    """The folder of one micro-batch; written with overwrite, so a repeated
    epoch replaces its own rows.  Reading ``base`` gives an ``epoch`` column."""
    return os.path.join(base, f"epoch={epoch}")


# --- STR1 / STR2 ----------------------------------------------------------------

def score_stream(requests: DataFrame, model, features: Callable[[DataFrame], DataFrame],
                 prob_col: str = "churn_probability", model_version: str | None = None) -> DataFrame:
    """STR1: decoded requests → model features → fitted pipeline → scored rows."""
    from pyspark.ml.functions import vector_to_array
    from tabulon.operators.score import scored_rows
    scored = model.transform(features(requests))
    scored = scored.withColumn(prob_col, vector_to_array(F.col("probability"))[1])
    return scored_rows(scored, prob_col, model_version)


def split_sink(rules, valid_path: str, quarantine_path: str):
    """STR2: a ``foreachBatch`` handler writing valid rows and quarantined rows
    (with their violations) to two tables, one folder per epoch."""
    def handle(batch: DataFrame, epoch: int):
        checked = V.violations(batch, rules).persist()
        (checked.where("is_valid").drop("violations", "is_valid")
         .write.mode("overwrite").parquet(epoch_path(valid_path, epoch)))
        (checked.where(~F.col("is_valid")).drop("is_valid")
         .withColumn("violations", F.array_join("violations", ","))
         .write.mode("overwrite").parquet(epoch_path(quarantine_path, epoch)))
        checked.unpersist()
    return handle


# --- STR3 / STR5 ----------------------------------------------------------------

def window_metrics(stream: DataFrame, ts: str = "ts", prob: str = "churn_probability",
                   every: str = C.MONITOR_WINDOW, watermark: str = "10 minutes",
                   error_col: str | None = None) -> DataFrame:
    """STR3: tumbling-window count, tiers, average confidence, error rate.

    In ``append`` mode (production) a window is emitted once the watermark
    passes its end and its state is dropped; ``complete`` mode keeps every
    window and is used only to compare a finished stream with the batch form."""
    tier = S.risk_tier(prob)
    aggs = [F.count(F.lit(1)).alias("n_predictions"), F.avg(S.confidence(prob)).alias("avg_confidence"),
            *[F.count_if(tier == t).alias(f"n_{t.lower()}") for t in C.TIERS]]
    if error_col:
        aggs.append(F.avg(F.col(error_col).cast("int")).alias("error_rate"))
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, every).alias("w")).agg(*aggs)
            .select(F.col("w.start").alias("window_start"), *[a for a in
                    ["n_predictions", "avg_confidence", "n_low", "n_medium", "n_high"]
                    + (["error_rate"] if error_col else [])]))


def overwrite_sink(path: str, post: Callable[[DataFrame], DataFrame] | None = None):
    """``foreachBatch`` handler for a result that every batch replaces: one
    version per epoch; readers take ``latest_version(path)``, which is complete
    even when a later write fails."""
    def handle(batch: DataFrame, epoch: int):
        out = post(batch) if post else batch
        out.write.mode("overwrite").parquet(version_path(path, epoch))
    return handle


def alert_sink(path: str, min_rows: int = C.MIN_PERFORMANCE_SAMPLES):
    """STR5: closed windows (append mode) → monitor alerts, one folder per epoch."""
    def handle(batch: DataFrame, epoch: int):
        w = batch.withColumn("status", F.when(F.col("n_predictions") >= min_rows, "ok").otherwise("insufficient"))
        A.monitor_alerts(w).write.mode("overwrite").parquet(epoch_path(path, epoch))
    return handle


def monitored_windows(stream: DataFrame, ts: str = "ts", prob: str = "churn_probability", every: str = C.MONITOR_WINDOW,
                      watermark: str = "10 minutes", value: str | None = None, reference: Sequence[float] | None = None,
                      lo: float = 0.0, hi: float = 1.0, key: str | None = None, min_rows: int = C.MIN_PERFORMANCE_SAMPLES,
                      drift_cut: float = C.DRIFT_THRESHOLD) -> DataFrame:
    """STR5 input, in append mode: every window from a key's first one on, also
    those without rows, with its status and drift flag.

    Two stateful steps: the windowed aggregate (counts, confidence, and with
    ``value`` its histogram over the bins of ``reference``, shares of a reference
    table between ``lo`` and ``hi``), then ``streaming.state.filled_windows``, whose
    event-time timers emit a window of zeros when no rows came for it.  The
    Jensen-Shannon distance of the window's bins decides ``drift_detected``.  Without
    ``key`` the whole stream is one monitor."""
    bins = len(reference) if reference else 0
    who = F.col(key).cast("string") if key else F.lit("all")
    s = stream.withWatermark(ts, watermark)
    of = binned(s, value, lo, hi, bins) if bins else None
    aggs = [F.count(F.lit(1)).alias("n_predictions"), F.avg(S.confidence(prob)).alias("avg_confidence"),
            *[F.count_if(of == b + 1).alias(f"_b{b}") for b in range(bins)]]
    closed = after_clock(s, ts, F.col(prob).isNotNull()).groupBy(F.window(ts, every).alias("w"), who.alias("monitor")).agg(*aggs)
    closed = closed.select("monitor", F.window_time("w").alias("event_time"), F.unix_millis(F.col("w.start")).alias("start"), "n_predictions",
                           "avg_confidence", F.array(*[F.col(f"_b{b}") for b in range(bins)]).cast("array<long>").alias("bins"))
    full = filled_windows(closed, duration_millis(every)).withColumn("window_start", F.timestamp_millis("start"))
    full = full.withColumn("status", F.when(F.col("n_predictions") >= min_rows, "ok").otherwise("insufficient"))
    if not bins:
        return full.select("monitor", "window_start", "n_predictions", "avg_confidence", "status")
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x)
    plogp = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    pairs = F.arrays_zip(F.col("bins").alias("n"), F.array(*[F.lit(float(p)) for p in reference]).alias("p"))
    def part(x):
        q, p = F.try_divide(x["n"].cast("double"), total.cast("double")), x["p"]
        return plogp(p, (p + q) / 2) + plogp(q, (p + q) / 2)
    js = F.sqrt(F.greatest(F.aggregate(F.transform(pairs, part), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))
    full = full.withColumn("jensen_shannon", F.when(total > 0, js))
    full = full.withColumn("drift_detected", F.coalesce(F.col("jensen_shannon") >= drift_cut, F.lit(False)))
    return full.select("monitor", "window_start", "n_predictions", "avg_confidence", "status", "jensen_shannon", "drift_detected")


# --- STR4 ------------------------------------------------------------------------

def sliding_histogram(stream: DataFrame, ts: str, value: str, lo: float, hi: float, bins: int = 20,
                      length: str = "7 days", slide: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """STR4 state: per sliding window and bin, a count (the state is a
    histogram, not rows; every row enters length/slide windows).  The
    watermark bounds how long a window's bins stay in state outside
    ``complete`` mode."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, length, slide).alias("w"), binned(stream, value, lo, hi, bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "bin", "n"))


# --- STR6 ------------------------------------------------------------------------

def seconds_of(interval: str) -> int:
    """Seconds of an interval like '1 day', '36 hours' or '10 minutes'."""
    n, unit = interval.split()[:2]
    return int(float(n) * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit.lower().rstrip("s")])


def stream_feedback_match(events: DataFrame, key: str, ts: str, kind_col: str, id_col: str, flag_col: str,
                          horizon: str = "1 day", watermark: str = "1 hour", slice_length: str = "7 days") -> DataFrame:
    """STR6: predictions (kind 1) matched with the first later truth (kind 0)
    of the same key within ``horizon`` (ties: smallest id); other kinds only move
    the clock.

    State is the waiting predictions and the truths that may still be needed, in
    RocksDB, as packed blocks of a bucket of keys: an entry per row, with a state
    per key, costs a call from Python for each.  An event-time timer wakes a bucket
    when its next prediction may be settled: once the watermark has passed its
    first truth, or its horizon.  So rows may arrive in any order within
    ``watermark``, on either side.  A bucket is split by time into slices: a truth
    goes to its own slice and, when it lies within the horizon of an earlier slice's
    end, to that one too (slices at least as long as the horizon: one copy at most).
    Rows without a key, a time or an id match nothing; rows of one kind, time and
    id are the same row."""
    h, sl = seconds_of(horizon) * 1_000_000, seconds_of(slice_length) * 1_000_000
    s = after_clock(events.withWatermark(ts, watermark), ts, F.col(key).isNotNull() & F.col(id_col).isNotNull() & F.col(kind_col).isin(0, 1))
    t = F.unix_micros(F.col(ts))
    own, reach = F.floor(t / F.lit(sl)).cast("long"), F.floor((t - h) / F.lit(sl)).cast("long")
    s = s.select(F.col(key).alias("entity_id"), F.explode(F.when(F.col(kind_col) == 0, F.sequence(reach, own)).otherwise(F.array(own))).alias("slice"),
                 F.col(ts).alias("ts"), t.alias("micros"), F.col(kind_col).cast("int").alias("kind"),
                 F.col(id_col).alias("row_id"), F.col(flag_col).alias("flag"))
    return first_truths(s, h)


# --- STR7 ------------------------------------------------------------------------

def version_path(base: str, epoch: int) -> str:
    return os.path.join(base, f"v{epoch:08d}")


def latest_n_sink(base: str, ts: str, id_col: str, n: int = C.LOG_CAPACITY, compact_every: int = 8):
    """STR7: keep the newest ``n`` rows.  Each micro-batch writes its own newest
    ``n`` (TakeOrderedAndProject) as a delta of its epoch and rewrites nothing else;
    readers (``latest_n``) take the newest ``n`` of the last snapshot and the deltas
    after it.

    Every ``compact_every`` epochs the snapshot and the deltas *below* the epoch are
    folded into a new snapshot.  A snapshot that covers all epochs below e replaces
    the one before and the deltas it holds; they are kept until the snapshot after
    it is complete, so readers that listed them finish, and then deleted.  A
    repeated epoch replaces its own delta and its own snapshot."""
    def handle(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        SM.last_n(batch, ts, id_col, n).write.mode("overwrite").parquet(os.path.join(base, "deltas", f"d{epoch:08d}"))
        if epoch and epoch % compact_every == 0:
            held = _live(spark, base, epoch)
            if held:
                rows = spark.read.parquet(*held)
                SM.last_n(rows, ts, id_col, n).write.mode("overwrite").parquet(version_path(os.path.join(base, "snapshots"), epoch))
                _retire(spark, base)
    return handle


def _complete(spark: SparkSession, base: str, prefix: str) -> list[int]:
    """Numbers of the complete folders ``<prefix><number>`` below ``base``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(x[len(prefix):]) for x in names if x.startswith(prefix) and fs.exists(hadoop.Path(os.path.join(base, x, "_SUCCESS"))))


def _live(spark: SparkSession, base: str, below: int | None = None) -> list[str]:
    """The newest snapshot and the deltas it does not hold (of epochs below ``below``)."""
    snaps = [e for e in _complete(spark, os.path.join(base, "snapshots"), "v") if below is None or e < below]
    upto = snaps[-1] if snaps else 0
    deltas = [e for e in _complete(spark, os.path.join(base, "deltas"), "d") if e >= upto and (below is None or e < below)]
    return ([version_path(os.path.join(base, "snapshots"), upto)] if snaps else []) + [os.path.join(base, "deltas", f"d{e:08d}") for e in deltas]


def _retire(spark: SparkSession, base: str) -> None:
    """Deletes snapshots before the last two, and deltas that the older of these holds."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    snaps = _complete(spark, os.path.join(base, "snapshots"), "v")
    if len(snaps) < 2:
        return
    fs = hadoop.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [version_path(os.path.join(base, "snapshots"), e) for e in snaps[:-2]]
    gone += [os.path.join(base, "deltas", f"d{e:08d}") for e in _complete(spark, os.path.join(base, "deltas"), "d") if e < snaps[-2]]
    for path in gone:
        fs.delete(hadoop.Path(path), True)


def latest_n(spark: SparkSession, base: str, ts: str, id_col: str, n: int = C.LOG_CAPACITY) -> DataFrame | None:
    """STR7: the log's newest ``n`` rows; None before the first epoch."""
    held = _live(spark, base)
    return SM.last_n(spark.read.parquet(*held), ts, id_col, n) if held else None


def latest_version(spark: SparkSession, base: str, below: int | None = None) -> str | None:
    """The newest complete version, of those before epoch ``below`` when given."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    names = sorted(st.getPath().getName() for st in fs.listStatus(p) if st.getPath().getName().startswith("v"))
    done = [nm for nm in names if (below is None or int(nm[1:]) < below)
            and fs.exists(jvm.org.apache.hadoop.fs.Path(os.path.join(base, nm, "_SUCCESS")))]
    return os.path.join(base, done[-1]) if done else None
