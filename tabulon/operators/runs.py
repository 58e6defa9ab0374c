"""Experiment runs and the model registry as tables (SNK6, ORD1-3, REG1-2, JON2).

Runs are long tables ``run_params(run_id, parent_id, key, value)`` and
``run_metrics(run_id, parent_id, key, value)``; versions are rows of
``model_versions(name, version, run_id, ...)``.  Metric keys are snake_case
(a missing metric sorts last instead of silently reading 0).

As stored tables they are appended to by many writers.  A batch of runs is a folder
of its own, written with overwrite (a repeated batch replaces itself) and seen by
readers once its commit file exists.  A version number is taken by creating a small
file that must not exist yet: of several writers one succeeds, the others try the
next number.  The file names its run, so a writer that died after taking a number
finds it again.
"""

from __future__ import annotations

import os
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def metrics_long(wide: DataFrame, run_col: str, metrics: Sequence[str], parent: str | None = None) -> DataFrame:
    """SNK6: wide per-run metrics → run_metrics(run_id, parent_id, key, value)."""
    structs = [F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in metrics]
    return wide.select(F.col(run_col).alias("run_id"), F.lit(parent).cast("string").alias("parent_id"),
                       F.inline(F.array(*structs)))


def comparison_table(wide: DataFrame, sort_metric: str = "roc_auc", digits: int = 4,
                     metrics: Sequence[str] = ()) -> DataFrame:
    """ORD1: models sorted by a metric (desc), rounded half-to-even like pandas."""
    cols = [F.bround(F.col(m), digits).alias(m) if m in metrics else F.col(m) for m in wide.columns]
    return wide.select(*cols).orderBy(F.col(sort_metric).desc_nulls_last())


def best_by(wide: DataFrame, name_col: str, metric: str, position_col: str | None = None) -> DataFrame:
    """ORD2: the name with the highest metric; first position on ties."""
    order = F.struct(F.coalesce(F.col(metric), F.lit(float("-inf"))),
                     (-F.col(position_col)) if position_col else F.lit(0))
    return wide.agg(F.max_by(name_col, order).alias(f"best_{name_col}"),
                    F.max(metric).alias(f"best_{metric}"))


def best_run(run_metrics: DataFrame, artifacts: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """ORD3 + JON2: the best run by the metric (missing → last) among those that
    have an artifact; if none has one, the best of all.  Returns one row (run_id,
    metric value, has_artifact).  The artifact test comes before the choice."""
    m = run_metrics.where(F.col("key") == metric).select("run_id", F.col("value").alias("metric"))
    have = artifacts.select("run_id").distinct().withColumn("has_artifact", F.lit(True))
    runs = (run_metrics.select("run_id").distinct().join(m, "run_id", "left").join(have, "run_id", "left")
            .withColumn("has_artifact", F.coalesce("has_artifact", F.lit(False))))
    o = F.col("metric").asc_nulls_last() if ascending else F.col("metric").desc_nulls_last()
    return runs.orderBy(F.col("has_artifact").desc(), o, "run_id").limit(1)


def register(versions: DataFrame, run: DataFrame, name: str) -> DataFrame:
    """REG1: append the run as the next version of ``name`` (max + 1, from 1)."""
    nxt = versions.where(F.col("name") == name).agg(
        (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")).withColumn("_k", F.lit(0))
    new = run.withColumn("_k", F.lit(0)).join(F.broadcast(nxt), "_k").select(        # one row
        F.lit(name).alias("name"), F.col("version").cast("int").alias("version"), "run_id", "metric")
    return versions.unionByName(new)


def register_batch(versions: DataFrame, runs: DataFrame, name: str, order_col: str = "run_id") -> DataFrame:
    """REG1 for several runs at once: versions max + 1, max + 2, ... in
    ``order_col`` order (a window over the new runs only)."""
    base = versions.where(F.col("name") == name).agg(
        F.coalesce(F.max("version"), F.lit(0)).alias("_base")).withColumn("_k", F.lit(0))
    w = Window.orderBy(order_col)
    new = (runs.withColumn("_k", F.lit(0)).join(F.broadcast(base), "_k")             # one row
           .select(F.lit(name).alias("name"),
                   (F.col("_base") + F.row_number().over(w)).cast("int").alias("version"),
                   "run_id", "metric"))
    return versions.unionByName(new)


def promotion(versions: DataFrame, metric: str = "metric") -> DataFrame:
    """REG2: per version, compare with the previous one of the same name:
    promote when not worse, else roll back (the first version is promoted)."""
    w = Window.partitionBy("name").orderBy("version")
    prev = F.lag(metric).over(w)
    return versions.select("*", prev.alias("previous_metric"),
                           F.when(prev.isNull() | (F.col(metric) >= prev), "promote")
                           .otherwise("rollback").alias("decision"))


# --- stored tables ------------------------------------------------------------------

PARAMS = "run_id string, parent_id string, key string, value string"
METRICS = "run_id string, parent_id string, key string, value double"
VERSIONS = "name string, version int, run_id string, metric double"


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, to = _folder(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(to(path))) if fs.exists(to(path)) else []


def write_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file, or returns False when there is one: the file system's
    own create-without-overwrite decides between writers (one step on HDFS and on
    stores with conditional writes; a local folder, where the Hadoop client takes two
    steps, is asked directly)."""
    from py4j.protocol import Py4JJavaError
    fs, to = _folder(spark, path)
    if fs.getScheme() == "file":
        fs.mkdirs(to(path).getParent())
        try:
            f = os.open(to(path).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        os.write(f, text.encode())
        os.close(f)
        return True
    try:
        out = fs.create(to(path), False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _small_file(spark: SparkSession, path: str) -> str:
    fs, to = _folder(spark, path)
    stream = fs.open(to(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def run_rows(spark: SparkSession, run_id: str, parent_id: str | None, params: Mapping[str, object],
             metrics: Mapping[str, float | None]) -> tuple[DataFrame, DataFrame]:
    """SNK6: the (run_params, run_metrics) rows of one run."""
    return (spark.createDataFrame([(run_id, parent_id, k, None if v is None else str(v)) for k, v in params.items()], PARAMS),
            spark.createDataFrame([(run_id, parent_id, k, None if v is None else float(v)) for k, v in metrics.items()], METRICS))


def log_runs(base: str, batch: str, params: DataFrame, metrics: DataFrame) -> None:
    """SNK6: appends a batch of runs to the stored tables; a batch of the same name
    replaces the earlier one."""
    spark = params.sparkSession
    for name, rows, schema in (("params", params, PARAMS), ("metrics", metrics, METRICS)):
        rows.select(*[f.split()[0] for f in schema.split(", ")]).write.mode("overwrite").parquet(os.path.join(base, name, f"batch={batch}"))
    write_if_absent(spark, os.path.join(base, "commits", batch), "")


def stored_runs(spark: SparkSession, base: str, what: str) -> DataFrame:
    """SNK6: ``params`` or ``metrics`` of all committed batches."""
    schema = {"params": PARAMS, "metrics": METRICS}[what]
    parts = [os.path.join(base, what, f"batch={b}") for b in _names(spark, os.path.join(base, "commits"))]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def best_params(params: DataFrame, metrics: DataFrame, metric: str, best: str = "best_") -> DataFrame:
    """SNK6: per parent, the parameters of its best run by the metric (ties: smallest
    run id) as parameters of the parent itself, named ``best_<key>``."""
    top = metrics.where((F.col("key") == metric) & F.col("value").isNotNull()).groupBy("parent_id").agg(
        F.min_by("run_id", F.struct(-F.col("value"), F.col("run_id"))).alias("run_id"))
    return top.join(params.select("run_id", "key", "value"), "run_id").select(
        F.col("parent_id").alias("run_id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit(best), F.col("key")).alias("key"), "value")


def take_version(spark: SparkSession, base: str, name: str, run_id: str) -> int:
    """The version number of a run under ``name``: the one it has already taken, or
    the next that no other writer takes."""
    claims = os.path.join(base, "versions", name, "claims")
    taken = [int(x[1:]) for x in _names(spark, claims)]
    for v in taken:
        if _small_file(spark, os.path.join(claims, f"v{v:08d}")) == run_id:
            return v
    v = max(taken, default=0) + 1
    while not write_if_absent(spark, os.path.join(claims, f"v{v:08d}"), run_id):
        v += 1
    return v


def register_stored(spark: SparkSession, base: str, name: str, run_id: str, metric: float | None) -> int:
    """REG1: the run becomes a version of ``name`` in the stored registry; a
    repeated call completes or repeats the same version."""
    v = take_version(spark, base, name, run_id)
    row = spark.createDataFrame([(name, v, run_id, metric)], VERSIONS)
    row.coalesce(1).write.mode("overwrite").parquet(os.path.join(base, "versions", name, "rows", f"v{v:08d}"))
    return v


def stored_versions(spark: SparkSession, base: str) -> DataFrame:
    """REG1: all complete versions of all names."""
    fs, to = _folder(spark, base)
    parts = []
    for name in _names(spark, os.path.join(base, "versions")):
        rows = os.path.join(base, "versions", name, "rows")
        parts += [os.path.join(rows, v) for v in _names(spark, rows) if fs.exists(to(os.path.join(rows, v, "_SUCCESS")))]
    return spark.read.schema(VERSIONS).parquet(*parts) if parts else spark.createDataFrame([], VERSIONS)
