"""Sinks: CSV / parquet tables, JSON report records, the append-only feedback
log, the retrain decision flag (SNK1-4, SNK7).

Writes go to paths the caller names (on a cluster: the shared file system);
every writer is an ordinary DataFrame write, so a failed task is retried by
Spark and a failed job leaves no ``_SUCCESS`` marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalar import run_stamp


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """SNK1: a table without index; CSV with a header (or parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def write_report(record: DataFrame, path: str, stamp_col: str | None = "run_stamp") -> str:
    """SNK2 + SNK7: one-row (possibly nested) report records as JSON lines,
    partitioned by a ``%Y%m%d_%H%M%S`` run stamp so reports accumulate."""
    r = record
    if stamp_col and stamp_col not in r.columns:
        r = r.withColumn(stamp_col, run_stamp(F.current_timestamp()))
    (r.coalesce(1).write.mode("append").partitionBy(stamp_col).json(path) if stamp_col
     else r.coalesce(1).write.mode("append").json(path))
    return path


def append_feedback(feedback: DataFrame, path: str, date_col: str = "feedback_date") -> str:
    """SNK3: append feedback records, partitioned by feedback date so readers
    prune by date."""
    feedback.withColumn(date_col, F.to_date(date_col)).write.mode("append").partitionBy(date_col).parquet(path)
    return path


def decision_flag(decision: DataFrame, needed_col: str = "retrain_needed") -> DataFrame:
    """SNK4: the flag row ``true`` / ``false``; a missing decision row (the
    decision job failed) yields ``true`` so a retrain is never skipped silently."""
    agg = decision.agg(F.max(F.col(needed_col).cast("int")).alias("_f"))
    return agg.select(F.when(F.col("_f") == 0, "false").otherwise("true").alias("retrain_flag"))


def write_flag(decision: DataFrame, path: str) -> str:
    """SNK4 writer: one text line with the flag."""
    decision_flag(decision).coalesce(1).write.mode("overwrite").text(path)
    return path
