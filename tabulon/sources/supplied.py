"""Role tables derived from the supplied parquet tables.

The supplied tables carry no churn columns, so each role (entity table,
target, score, prediction log, feedback, request log, reference/current)
is a Spark derivation of them.  Each has an SQL twin (``*_SQL``) with the same
columns, used as a CTE by the DuckDB oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.sources.tables import read_table

CUTOFF_TS = "2001-01-01 00:00:00"
DRIFT_SPLIT_TS = "2024-01-22 00:00:00"


def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: spend profile from orders, a churn-style target,
    and deterministically injected nulls for the cleaning operators.

    Orders are aggregated first (map-side partial aggregation absorbs a hot
    customer), so the join sees one row per customer on both sides.
    """
    cust = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    agg = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("total_spend"),
        F.max("o_orderdate").alias("last_order"))
    j = cust.join(agg, cust.c_custkey == agg.o_custkey, "left")
    return j.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        "total_spend", "last_order",
        F.coalesce((F.col("last_order") < F.lit(CUTOFF_TS).cast("timestamp_ntz"))
                   .cast("int"), F.lit(0)).alias("churn"),
    )


ENTITY_SQL = f"""entity AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
         CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders, total_spend, last_order,
         CAST(coalesce(CAST(last_order < TIMESTAMP '{CUTOFF_TS}' AS INTEGER), 0) AS INTEGER) AS churn
  FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_spend,
           max(o_orderdate) AS last_order
    FROM orders GROUP BY o_custkey) a ON c_custkey = a.o_custkey)"""

ENTITY_NUMERIC = ("c_acctbal", "n_orders", "total_spend")
ENTITY_CATEGORICAL = ("c_mktsegment",)


def scored_documents(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Labelled documents with a score column: (doc_id, label, score)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", label)
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col(label).cast("int").alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).alias("score"))


def scored_documents_sql(label: str = "quality") -> str:
    return f"""scored AS (
  SELECT d.doc_id, CAST(l.{label} AS INTEGER) AS label,
         d.n_chars / (d.n_chars + 2000.0) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a prediction log: id, time, entity, score, label, tier, confidence."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("prediction_id"), "ts",
        F.col("user_id").alias("entity_id"), "event_type", "value",
        S.saturation("value", 50.0).alias("churn_probability"))


PREDLOG_SQL = """predlog AS (
  SELECT event_id AS prediction_id, ts, user_id AS entity_id, event_type, value,
         value / (value + 50.0) AS churn_probability
  FROM events)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: duration_ms, status, concurrency level."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"), "ts",
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        (F.col("user_id") % 5).alias("level"))


REQLOG_SQL = """reqlog AS (
  SELECT event_id AS request_id, ts, value AS duration_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         user_id % 5 AS level
  FROM events)"""


def reference_current(spark: SparkSession, sf_dir: str, drifted: bool = False):
    """Events before / from the split time; ``drifted`` scales current values
    by 1.2 and recodes ``event_type`` for ids divisible by 3."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    ref = ev.where(F.col("ts") < F.lit(DRIFT_SPLIT_TS).cast("timestamp_ntz"))
    cur = ev.where(F.col("ts") >= F.lit(DRIFT_SPLIT_TS).cast("timestamp_ntz"))
    if drifted:
        cur = cur.select(
            "event_id", "ts",
            F.when(F.col("event_id") % 3 == 0, F.lit("view"))
             .otherwise(F.col("event_type")).alias("event_type"),
            (F.col("value") * 1.2).alias("value"))
    return ref, cur


def refcur_sql(drifted: bool = False) -> str:
    cur = ("SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS event_type, "
           "value * 1.2 AS value" if drifted else "SELECT event_id, ts, event_type, value")
    return f"""ref AS (SELECT event_id, ts, event_type, value FROM events
              WHERE ts < TIMESTAMP '{DRIFT_SPLIT_TS}'),
cur AS ({cur} FROM events WHERE ts >= TIMESTAMP '{DRIFT_SPLIT_TS}')"""


def messy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text with blanks, for the coercion operators."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 1, F.lit(" "))
         .otherwise(F.col("l_extendedprice").cast("string")).alias("price_text"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        "l_quantity", "l_returnflag", "l_shipdate")


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests as JSON text, one per customer (SRC3 input).

    Field values are projections of the entity table, chosen so that some
    rows break the request rules (negative balances, injected nulls,
    satisfaction outside 1..5)."""
    e = entity_table(spark, sf_dir)
    req = F.struct(
        F.col("c_acctbal").alias("monthly_charges"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit(0.0)).otherwise(F.col("total_spend")).alias("total_charges"),
        F.col("n_orders").alias("tenure_months"),
        F.when(F.col("c_nationkey") % 2 == 0, "Yes").otherwise("No").alias("phone_service"),
        F.when(F.col("c_custkey") % 5 == 0, "Yes").alias("multiple_lines"),
        F.col("c_mktsegment").alias("internet_service"),
        F.element_at(F.array(F.lit("Month-to-month"), F.lit("One year"), F.lit("Two year")),
                     (F.col("c_nationkey") % 3 + 1).cast("int")).alias("contract"),
        (F.col("total_spend") / 10).alias("cltv"),
        F.element_at(F.array(F.lit("Cable"), F.lit("DSL"), F.lit("Fiber optic"), F.lit("None")),
                     (F.col("c_custkey") % 4 + 1).cast("int")).alias("internet_type"),
        (F.col("c_nationkey") + 18).alias("age"),
        (F.col("c_custkey") % 7).alias("satisfaction_score"),
        F.col("c_custkey").cast("double").alias("population"),
    )
    return e.select(F.col("c_custkey").alias("customer_id"), F.to_json(req).alias("value"))


REQUEST_SQL = """req AS (
  SELECT c_custkey AS customer_id, c_acctbal AS monthly_charges,
    CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE total_spend END AS total_charges,
    n_orders AS tenure_months,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS phone_service,
    CASE WHEN c_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS multiple_lines,
    c_mktsegment AS internet_service,
    ['Month-to-month', 'One year', 'Two year'][c_nationkey % 3 + 1] AS contract,
    total_spend / 10 AS cltv,
    ['Cable', 'DSL', 'Fiber optic', 'None'][c_custkey % 4 + 1] AS internet_type,
    c_nationkey + 18 AS age, c_custkey % 7 AS satisfaction_score, CAST(c_custkey AS DOUBLE) AS population,
    'No' AS streaming_tv, 'No' AS streaming_movies, 'No' AS streaming_music, 'No' AS unlimited_data
  FROM entity)"""
