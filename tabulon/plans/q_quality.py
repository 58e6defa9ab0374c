"""Queries: splits, samples and classification quality (WIN1-5, SMP1-2, AGG7-12, EVL1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import quality as Q
from tabulon.operators import sample as SM
from tabulon.plans.catalog import query, ts_text, ts_text_sql
from tabulon.sources import supplied as SP
from tabulon.sources.tables import read_table

SC = SP.scored_documents_sql("quality")
PRED_SQL = f"{SC}, p AS (SELECT doc_id, label, score, CAST(score >= 0.5 AS INTEGER) AS prediction FROM scored)"


def _scored(spark, sf):
    return Q.with_prediction(SP.scored_documents(spark, sf, "quality"))


@query("agg7_confusion_matrix", f"""WITH {PRED_SQL},
cls AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
cnt AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction)
SELECT a.c AS label, b.c AS prediction, coalesce(cnt.n, 0) AS n
FROM cls a JOIN cls b ON true LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c""")
def agg7_confusion_matrix(spark, sf):
    """AGG7: confusion matrix on the full class grid."""
    return Q.confusion_matrix(_scored(spark, sf))


_METRICS_SQL = f"""WITH {PRED_SQL},
c AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn,
  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM p)
SELECT n, tp, fp, tn, fn,
  round(coalesce((tp + tn) / nullif(n, 0), 0), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy
FROM c"""


@query("agg8_binary_metrics", _METRICS_SQL)
def agg8_binary_metrics(spark, sf):
    """AGG8: accuracy, precision, recall, F1, balanced accuracy."""
    return Q.binary_metrics(_scored(spark, sf))


@query("agg9_class_report", f"""WITH {PRED_SQL},
per AS (SELECT c AS cls,
   (SELECT count(*) FROM p WHERE label = c) AS support,
   (SELECT count(*) FROM p WHERE prediction = c) AS predicted,
   (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp
 FROM (SELECT label AS c FROM p UNION SELECT prediction FROM p)),
m AS (SELECT CAST(cls AS VARCHAR) AS class, support,
   coalesce(tp / nullif(predicted, 0), 0) AS precision,
   coalesce(tp / nullif(support, 0), 0) AS recall,
   coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM per)
SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m
UNION ALL SELECT 'accuracy', (SELECT count(*) FROM p), NULL, NULL,
  round((SELECT count(*) FILTER (WHERE label = prediction) FROM p) / (SELECT count(*) FROM p), 6)
UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM m
UNION ALL SELECT 'weighted avg', CAST(sum(support) AS BIGINT),
  round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6) FROM m""")
def agg9_class_report(spark, sf):
    """AGG9: per-class precision/recall/F1/support with macro and weighted averages."""
    return Q.class_report(_scored(spark, sf))


_SCORE_COUNTS = f"""{SC},
s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM scored GROUP BY score)"""


@query("agg10_roc_auc", f"""WITH {_SCORE_COUNTS},
r AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_run FROM s)
SELECT round(sum(pos * (neg_run - neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc, 'ok' AS status FROM r""")
def agg10_roc_auc(spark, sf):
    """AGG10: exact rank-form ROC AUC (ties get half credit)."""
    return Q.roc_auc(SP.scored_documents(spark, sf, "quality"))


@query("agg10_roc_auc_toxic", f"""WITH {SP.scored_documents_sql('toxic')},
s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM scored GROUP BY score),
r AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_run FROM s),
a AS (SELECT sum(pos * (neg_run - neg / 2.0)) AS c, sum(pos) AS P, sum(neg) AS N FROM r)
SELECT CASE WHEN P = 0 OR N = 0 THEN NULL ELSE round(c / (P * N), 6) END AS roc_auc,
       CASE WHEN P = 0 OR N = 0 THEN 'one_class' ELSE 'ok' END AS status FROM a""")
def agg10_roc_auc_toxic(spark, sf):
    """AGG10 on the second target (``labels.toxic``)."""
    return Q.roc_auc(SP.scored_documents(spark, sf, "toxic"))


@query("agg11_average_precision", f"""WITH {_SCORE_COUNTS},
r AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM s)
SELECT round(sum(pos / (SELECT sum(pos) FROM s) * tp / (tp + fp)), 6) AS average_precision FROM r""")
def agg11_average_precision(spark, sf):
    """AGG11: step-sum average precision."""
    return Q.average_precision(SP.scored_documents(spark, sf, "quality"))


@query("agg12_curve_points", f"""WITH {_SCORE_COUNTS},
r AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
             CAST(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp FROM s),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM s)
SELECT round(score, 6) AS threshold, tp, fp, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr,
       round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM r, t
UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE,
       1.0::DOUBLE, 0.0::DOUBLE""")
def agg12_curve_points(spark, sf):
    """AGG12 / WIN4: cumulative TP/FP per descending threshold → ROC and PR points."""
    return Q.curve_points(SP.scored_documents(spark, sf, "quality"))


@query("evl1_evaluation_report", f"""WITH {PRED_SQL},
c AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn,
  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM p),
s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM scored GROUP BY score),
ra AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_run FROM s),
rp AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
              sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM s)
SELECT 'accuracy' AS metric, round((tp + tn) / n, 6) AS value FROM c
UNION ALL SELECT 'precision', round(coalesce(tp / nullif(tp + fp, 0), 0), 6) FROM c
UNION ALL SELECT 'recall', round(coalesce(tp / nullif(tp + fn, 0), 0), 6) FROM c
UNION ALL SELECT 'f1', round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) FROM c
UNION ALL SELECT 'balanced_accuracy', round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) FROM c
UNION ALL SELECT 'roc_auc', round(sum(pos * (neg_run - neg / 2.0)) / (sum(pos) * sum(neg)), 6) FROM ra
UNION ALL SELECT 'average_precision', round(sum(pos / (SELECT sum(pos) FROM s) * tp / (tp + fp)), 6) FROM rp""")
def evl1_evaluation_report(spark, sf):
    """EVL1: the quality metrics as one long report table."""
    return Q.evaluation_report(_scored(spark, sf))


_MD5 = "md5(concat('42', ':', CAST({k} AS VARCHAR)))"


@query("win2_stratified_split", f"""WITH r AS (
  SELECT c_custkey, c_mktsegment,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_MD5.format(k='c_custkey')}, c_custkey) AS rk,
    count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN rk <= n - (n * 20 + 99) // 100 THEN 'train' ELSE 'test' END AS split FROM r""")
def win2_stratified_split(spark, sf):
    """WIN2: exact stratified 80/20 split in seeded hash order."""
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return SM.stratified_split(cust, "c_mktsegment", "c_custkey")


@query("win2_split_entity_target", f"""WITH {SP.ENTITY_SQL}, r AS (
  SELECT c_custkey, churn,
    row_number() OVER (PARTITION BY churn ORDER BY {_MD5.format(k='c_custkey')}, c_custkey) AS rk,
    count(*) OVER (PARTITION BY churn) AS n FROM entity)
SELECT churn, split, count(*) AS n FROM (
  SELECT churn, CASE WHEN rk <= n - (n * 20 + 99) // 100 THEN 'train' ELSE 'test' END AS split FROM r)
GROUP BY churn, split""")
def win2_split_entity_target(spark, sf):
    """WIN2 on the entity target: class balance of train and test."""
    ent = SP.entity_table(spark, sf).select("c_custkey", "churn")
    sp = SM.stratified_split(ent, "churn", "c_custkey")
    return sp.groupBy("churn", "split").agg(F.count(F.lit(1)).alias("n"))


@query("win3_stratified_folds", f"""WITH r AS (
  SELECT c_custkey, c_mktsegment,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_MD5.format(k='c_custkey')}, c_custkey) AS rk FROM customer)
SELECT c_custkey, c_mktsegment, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r""")
def win3_stratified_folds(spark, sf):
    """WIN3: stratified 5 folds."""
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return SM.stratified_folds(cust, "c_mktsegment", "c_custkey")


@query("smp1_seeded_sample", f"""SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events
ORDER BY {_MD5.format(k='event_id')}, event_id LIMIT 1000""")
def smp1_seeded_sample(spark, sf):
    """SMP1: 1000 rows in seeded hash order (the sample is the feature)."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return SM.seeded_sample(ev, "event_id", 1000)


@query("smp2_first_rows", """SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice
FROM orders ORDER BY o_orderkey LIMIT 100""")
def smp2_first_rows(spark, sf):
    """SMP2: first 100 rows by key (the head is the feature)."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return SM.first_rows(o, "o_orderkey", 100)


@query("win1_last_n", f"""{SP.PREDLOG_SQL.replace('predlog AS (', 'WITH predlog AS (', 1)}
SELECT prediction_id, {ts_text_sql('ts')} AS ts, entity_id, round(churn_probability, 6) AS churn_probability
FROM predlog ORDER BY ts DESC, prediction_id DESC LIMIT 1000""")
def win1_last_n(spark, sf):
    """WIN1: newest 1000 prediction-log rows (the bounded log)."""
    log = SP.prediction_log(spark, sf).select("prediction_id", "ts", "entity_id", "churn_probability")
    return SM.last_n(log, "ts", "prediction_id", 1000).withColumn("ts", ts_text("ts"))


@query("win1_last_n_per_entity", f"""WITH {SP.PREDLOG_SQL}, r AS (
  SELECT prediction_id, ts, entity_id, churn_probability,
         row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, prediction_id DESC) AS rank FROM predlog)
SELECT prediction_id, {ts_text_sql('ts')} AS ts, entity_id, round(churn_probability, 6) AS churn_probability,
       CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def win1_last_n_per_entity(spark, sf):
    """WIN1 per key: newest 3 predictions of every entity (map-side group limit)."""
    log = SP.prediction_log(spark, sf).select("prediction_id", "ts", "entity_id", "churn_probability")
    return SM.last_n_per_key(log, "entity_id", "ts", "prediction_id", 3).withColumn("ts", ts_text("ts"))


@query("win5_batch_ids", """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS row_number,
  concat('batch_', CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR)) AS item_id FROM orders""")
def win5_batch_ids(spark, sf):
    """WIN5: ``batch_{i}`` ids over a stated key order (distributed row numbers)."""
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return SM.batch_ids(o, "o_orderkey")


@query("win2_hash_split", f"""SELECT c_custkey, CASE WHEN CAST(('0x' || substr({_MD5.format(k='c_custkey')}, 1, 8)) AS BIGINT) % 100 < 80
  THEN 'train' ELSE 'test' END AS split FROM customer""")
def win2_hash_split(spark, sf):
    """WIN2 for very large strata: a pure map (no shuffle) giving each row to
    test when its seeded hash falls in the last 20 percent."""
    cust = read_table(spark, sf, "customer").select("c_custkey")
    return SM.hash_split(cust, "c_custkey")
