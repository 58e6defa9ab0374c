"""Scans: parquet tables, CSV files, JSON requests, the no-data guard, models."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, between: dict | None = None) -> DataFrame:
    """SRC2: one supplied parquet table, NaN as NULL; column pruning reaches the
    scan, and so do filters on columns that are not floating point.

    A range of any column, ``between={"value": (10.0, None)}`` (ends included, None:
    open), reaches the scan for floating-point columns too: it is applied to the
    stored values, where NaN is above every bound, and NaN is left out after it."""
    raw = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    for c, (lo, hi) in (between or {}).items():
        raw = raw.where(F.lit(True) if lo is None else F.col(c) >= F.lit(lo)).where(F.lit(True) if hi is None else F.col(c) <= F.lit(hi))
        raw = raw.where(F.col(c).isNotNull())
        if isinstance(raw.schema[c].dataType, (T.DoubleType, T.FloatType)):
            raw = raw.where(~F.isnan(c))
    return nan_to_null(raw)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL at the scan (Spark's avg/median treat NaN as a value)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


class EmptyInput(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             require_rows: bool = True) -> DataFrame:
    """SRC1: CSV with header; explicit schema when known, else inferred.

    A missing path or an empty file is an error, as in the studied loader.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    try:
        df = reader.csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise FileNotFoundError(path) from e
        raise
    if require_rows and df.isEmpty():
        raise EmptyInput(f"no rows in {path}")
    return nan_to_null(df)


def read_or_no_data(spark: SparkSession, path: str, schema: T.StructType,
                    fmt: str = "parquet") -> DataFrame:
    """SRC4: a missing current table gives an empty typed result with
    ``status = 'no_data'`` instead of an error."""
    if _path_exists(spark, path):
        return spark.read.format(fmt).schema(schema).load(path).withColumn(
            "status", F.lit("ok"))
    empty = spark.createDataFrame([], schema)
    return empty.withColumn("status", F.lit("no_data"))


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


# SRC3: the scoring request schema (model-side fields, optional ones defaulted).
REQUEST_FIELDS = (
    ("monthly_charges", T.DoubleType(), None),
    ("total_charges", T.DoubleType(), None),
    ("tenure_months", T.LongType(), None),
    ("phone_service", T.StringType(), None),
    ("multiple_lines", T.StringType(), "No"),
    ("internet_service", T.StringType(), None),
    ("streaming_tv", T.StringType(), "No"),
    ("streaming_movies", T.StringType(), "No"),
    ("contract", T.StringType(), None),
    ("cltv", T.DoubleType(), None),
    ("internet_type", T.StringType(), "No"),
    ("streaming_music", T.StringType(), "No"),
    ("age", T.LongType(), None),
    ("avg_monthly_gb_download", T.DoubleType(), None),
    ("avg_monthly_long_distance_charges", T.DoubleType(), None),
    ("population", T.DoubleType(), None),
    ("satisfaction_score", T.LongType(), None),
    ("total_extra_data", T.DoubleType(), None),
    ("total_long_distance", T.DoubleType(), None),
    ("total_revenue", T.DoubleType(), None),
    ("unlimited_data", T.StringType(), "No"),
)
REQUEST_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t, _ in REQUEST_FIELDS])
BATCH_SCHEMA = T.StructType([
    T.StructField("customers", T.ArrayType(REQUEST_SCHEMA), True),
    T.StructField("include_probabilities", T.BooleanType(), True),
    T.StructField("include_explanations", T.BooleanType(), True),
])
#: what a batch body without the flags asks for
BATCH_FLAGS = {"include_probabilities": True, "include_explanations": False}


def decode_requests(df: DataFrame, json_col: str = "value", batch: bool = False) -> DataFrame:
    """SRC3: JSON text → typed request columns with defaults filled.

    ``batch=True`` reads ``{"customers": [...]}`` bodies and explodes them,
    keeping the position as ``item_index``, the item's name ``batch_<position>`` as
    ``customer_id`` and the body's flags (``score.batch_rows`` honours them).
    """
    if batch:
        parsed = df.select(F.from_json(F.col(json_col), BATCH_SCHEMA).alias("_b"), "*")
        rows = parsed.select(
            *[c for c in df.columns if c != json_col],
            *[F.coalesce(F.col(f"_b.{c}"), F.lit(d)).alias(c) for c, d in BATCH_FLAGS.items()],
            F.posexplode("_b.customers").alias("item_index", "_r"))
        rows = rows.withColumn("customer_id", F.concat(F.lit("batch_"), F.col("item_index").cast("string")))
    else:
        rows = df.select(*[c for c in df.columns if c != json_col],
                         F.from_json(F.col(json_col), REQUEST_SCHEMA).alias("_r"))
    fields = [F.coalesce(F.col(f"_r.{n}"), F.lit(d)).alias(n) if d is not None
              else F.col(f"_r.{n}").alias(n) for n, _, d in REQUEST_FIELDS]
    keep = [c for c in rows.columns if c != "_r"]
    return rows.select(*keep, *fields)
