"""Registry of named queries: a Spark builder plus an optional DuckDB oracle.

Keys are the lower-case inventory ID plus a short name (``agg3_describe``).
Double columns of every result are rounded to 6 decimals, and the oracle SQL
rounds the same columns, so the two sides can be compared value by value.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from tabulon.session import checkpoint_dir, ship_package
            checkpoint_dir(spark)   # the shared folder named by spark.checkpoint.dir
            ship_package(spark)     # executors import tabulon for pandas UDFs / stream state
            # event times are wall-clock (TIMESTAMP_NTZ); windows, day buckets and
            # watermarks are defined in UTC
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finish(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns for a stable value comparison."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def load_all() -> dict[str, Query]:
    """Import every query module so its queries register."""
    from tabulon.plans import (q_prepare, q_quality, q_drift, q_monitor,  # noqa: F401
                               q_model, q_stream, q_io)
    return REGISTRY


def ts_text(col: str) -> F.Column:
    return F.date_format(F.col(col), "yyyy-MM-dd HH:mm:ss")


def ts_text_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"
