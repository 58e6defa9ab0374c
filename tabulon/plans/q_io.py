"""Queries: round trips through the sources and sinks (SRC1, SRC4, SNK1-4,
SCL10, SCL12), the evaluation record (EVL2) and the column-expression forms
of the fitted feature pipeline (FEA1, FEA2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import scalar as S
from tabulon.operators import model as MD
from tabulon.operators import quality as Q
from tabulon.plans.catalog import query
from tabulon.plans.q_monitor import FEEDBACK_SQL, _feedback
from tabulon.plans.q_prepare import ENTITY_COLS_SQL, E, _entity
from tabulon.session import scratch_path
from tabulon.sources import sinks as K
from tabulon.sources import supplied as SP
from tabulon.sources.tables import read_csv, read_or_no_data, read_table

ENTITY_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType()), T.StructField("n_orders", T.LongType()),
    T.StructField("total_spend", T.DoubleType()), T.StructField("last_order", T.StringType()),
    T.StructField("churn", T.IntegerType())])


@query("src1_snk1_csv_roundtrip", f"WITH {E} SELECT {ENTITY_COLS_SQL} FROM entity")
def src1_snk1_csv_roundtrip(spark, sf):
    """SNK1 + SRC1: the entity table written as CSV with a header and read
    back with an explicit schema (an empty or missing file is an error)."""
    path = K.write_table(_entity(spark, sf), scratch_path(spark, f"csv-{uuid.uuid4().hex}"), "csv")
    return read_csv(spark, path, ENTITY_SCHEMA)


@query("src4_no_data", "SELECT 'events' AS source, 'ok' AS status, count(*) AS n FROM events UNION ALL SELECT 'absent', 'no_data', 0")
def src4_no_data(spark, sf):
    """SRC4: a current table that exists, and one that does not: no rows and the
    status ``no_data`` instead of an error."""
    import os
    out = None
    for name in ("events", "absent"):
        schema = spark.read.parquet(os.path.join(sf, "events.parquet")).schema
        t = read_or_no_data(spark, os.path.join(sf, f"{name}.parquet"), schema)
        some = t.agg(F.count(F.lit(1)).alias("n"), F.first("status").alias("status"))
        row = some.select(F.lit(name).alias("source"), F.coalesce("status", F.lit("no_data")).alias("status"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("scl10_csv_files", """SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'html' AS is_html,
  lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('org', 'com', 'net') AS is_host FROM pages""")
def scl10_csv_files(spark, sf):
    """SCL10: file-extension check on the URL of every page."""
    p = read_table(spark, sf, "pages")
    host = F.lit(False)
    for e in ("org", "com", "net"):
        host = host | S.has_extension("url", e)
    return p.select("page_id", S.has_extension("url", "html").alias("is_html"), host.alias("is_host"))


@query("snk2_json_report", """WITH {refcur}
SELECT 'events' AS dataset, (SELECT count(*) FROM ref) AS reference_rows, (SELECT count(*) FROM cur) AS current_rows""".format(
    refcur=SP.refcur_sql(False)))
def snk2_json_report(spark, sf):
    """SNK2: a one-row nested report written as JSON (run-stamped partition)
    and read back."""
    ref, cur = SP.reference_current(spark, sf)
    rec = (ref.agg(F.count(F.lit(1)).alias("reference_rows")).withColumn("_k", F.lit(0))
           .join(cur.agg(F.count(F.lit(1)).alias("current_rows")).withColumn("_k", F.lit(0)), "_k")
           .select(F.lit("events").alias("dataset"),
                   F.struct("reference_rows", "current_rows").alias("data_info")))
    path = K.write_report(rec, scratch_path(spark, f"report-{uuid.uuid4().hex}"))
    back = spark.read.json(path)
    return back.select("dataset", F.col("data_info.reference_rows").alias("reference_rows"),
                       F.col("data_info.current_rows").alias("current_rows"))


@query("snk3_feedback_log", f"""WITH {FEEDBACK_SQL}
SELECT strftime(feedback_ts, '%Y-%m-%d') AS feedback_date, count(*) AS n,
  count(*) FILTER (WHERE predicted_churn = actual_churn) AS n_correct FROM fb GROUP BY 1""")
def snk3_feedback_log(spark, sf):
    """SNK3: feedback appended to a log partitioned by feedback date, then
    read back per date (partition pruning on the date column)."""
    fb = _feedback(spark, sf).select(F.col("entity_id").cast("string").alias("customer_id"),
                                     "predicted_churn", "actual_churn",
                                     F.col("feedback_ts").alias("feedback_date"),
                                     F.col("feedback_ts").alias("timestamp"))
    path = K.append_feedback(fb, scratch_path(spark, f"feedback-{uuid.uuid4().hex}"))
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("feedback_date", "yyyy-MM-dd").alias("feedback_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted_churn") == F.col("actual_churn")).alias("n_correct"))


@query("snk4_decision_flag_drift", "SELECT 'true' AS retrain_flag")
def snk4_decision_flag_drift(spark, sf):
    """SNK4 on the drifted events copy: the decision says retrain → ``true``."""
    from tabulon.operators import drift as D
    ref, cur = SP.reference_current(spark, sf, drifted=True)
    ds = D.dataset_drift(D.column_drift(ref, cur, ["value"], ["event_type"]))
    return K.decision_flag(D.retrain_decision(ds, None, None))


@query("scl12_elapsed_ms", f"""WITH {FEEDBACK_SQL}
SELECT prediction_id, feedback_id, epoch_us(feedback_ts) // 1000 - epoch_us(ts) // 1000 AS elapsed_ms FROM fb""")
def scl12_elapsed_ms(spark, sf):
    """SCL12: elapsed milliseconds between a prediction and its feedback."""
    fb = _feedback(spark, sf)
    return fb.select("prediction_id", "feedback_id", S.elapsed_ms("ts", "feedback_ts").alias("elapsed_ms"))


def _evl2_sql() -> str:
    from tabulon.plans.q_quality import PRED_SQL
    return f"""WITH {PRED_SQL},
c AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn,
  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM p),
s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM scored GROUP BY score),
ra AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_run FROM s),
auc AS (SELECT sum(pos * (neg_run - neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM ra)
SELECT 'length_score' AS model_name, '1' AS model_version,
  round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(roc_auc, 6) AS roc_auc,
  n AS n_rows, tp + fn AS n_positive, tn + fp AS n_negative FROM c, auc"""


@query("evl2_evaluation_record", _evl2_sql())
def evl2_evaluation_record(spark, sf):
    """EVL2: the nested evaluation record - model info, the five metrics, data size
    and class counts - written as a JSON report and read back."""
    rec = Q.evaluation_record(Q.with_prediction(SP.scored_documents(spark, sf, "quality")), "length_score", "1")
    back = spark.read.json(K.write_report(rec, scratch_path(spark, f"record-{uuid.uuid4().hex}")))
    return back.select(
        F.col("model_info.name").alias("model_name"), F.col("model_info.version").alias("model_version"), "metrics.accuracy", "metrics.precision",
        "metrics.recall", "metrics.f1", "metrics.roc_auc", "data_info.n_rows", "class_distribution.n_positive", "class_distribution.n_negative")


# --- FEA1 / FEA2 as column expressions ----------------------------------------

def _fitted(spark, sf):
    ent = SP.entity_table(spark, sf).select("c_custkey", "c_acctbal", "total_spend", "c_mktsegment")
    spec = MD.fit_feature_spec(ent, ["c_acctbal", "total_spend"], ["c_mktsegment"])
    from pyspark.ml import Pipeline
    model = Pipeline(stages=MD.feature_stages(spec)).fit(ent)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(ent).select("c_custkey", F.col("c_mktsegment__filled").alias("c_mktsegment"), vector_to_array("features").alias("f"))
    return spec, out


_FEA_SQL = f"""{E},
med AS (SELECT quantile_cont(c_acctbal, 0.5) AS m1, quantile_cont(total_spend, 0.5) AS m2 FROM entity),
filled AS (SELECT c_custkey, coalesce(c_acctbal, m1) AS a, coalesce(total_spend, m2) AS t,
   coalesce(c_mktsegment, (SELECT c_mktsegment FROM entity WHERE c_mktsegment IS NOT NULL
     GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) AS seg FROM entity, med),
st AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(t) AS mt, stddev_samp(t) AS st_ FROM filled)"""


@query("fea1_standard_scaled", f"""WITH {_FEA_SQL}
SELECT c_custkey, round((a - ma) / sa, 6) AS c_acctbal_scaled, round((t - mt) / st_, 6) AS total_spend_scaled FROM filled, st""")
def fea1_standard_scaled(spark, sf):
    """FEA1: fitted median imputation then standard scaling (sample std, like
    Spark's StandardScaler), read back from the feature vector."""
    _, out = _fitted(spark, sf)
    return out.select("c_custkey", F.col("f")[0].alias("c_acctbal_scaled"), F.col("f")[1].alias("total_spend_scaled"))


@query("fea2_one_hot", f"""WITH {_FEA_SQL}
SELECT c_custkey, seg AS c_mktsegment, CAST(seg = 'AUTOMOBILE' AS DOUBLE) AS is_automobile,
  CAST(seg = 'BUILDING' AS DOUBLE) AS is_building, CAST(seg = 'FURNITURE' AS DOUBLE) AS is_furniture,
  CAST(seg = 'HOUSEHOLD' AS DOUBLE) AS is_household, CAST(seg = 'MACHINERY' AS DOUBLE) AS is_machinery FROM filled""")
def fea2_one_hot(spark, sf):
    """FEA2: mode imputation then one-hot (alphabetical slots, unknown → zeros),
    read back from the feature vector (pivot form)."""
    spec, out = _fitted(spark, sf)
    cats = spec.categories["c_mktsegment"]
    cols = [F.col("f")[2 + i].alias(f"is_{c.lower()}") for i, c in enumerate(cats)]
    return out.select("c_custkey", *cols, "c_mktsegment")


@query("fea2_unknown_category_zeros", f"WITH {E} SELECT count(*) AS n_rows, 5 AS n_slots, CAST(0.0 AS DOUBLE) AS slot_sum FROM entity")
def fea2_unknown_category_zeros(spark, sf):
    """FEA2: a category never seen in training encodes as all zeros - the
    fitted pipeline applied to every row with its segment replaced by an
    unseen value."""
    ent = SP.entity_table(spark, sf).select("c_custkey", "c_acctbal", "total_spend", "c_mktsegment")
    spec = MD.fit_feature_spec(ent, ["c_acctbal", "total_spend"], ["c_mktsegment"])
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    model = Pipeline(stages=MD.feature_stages(spec)).fit(ent)
    unseen = ent.withColumn("c_mktsegment", F.lit("SPACECRAFT"))
    v = model.transform(unseen).select(vector_to_array("features").alias("f"))
    return v.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("f") - 2).alias("n_slots"),
                 F.sum(F.aggregate(F.slice("f", 3, 100), F.lit(0.0), lambda a, x: a + x)).alias("slot_sum"))
