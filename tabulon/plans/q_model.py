"""Queries: feature pipeline, models, tuning, scoring, contributions, runs and
registry (FEA*, MDL*, EXP1, SCO1/3, SNK5/6, SRC5, ORD1-4, REG1-2, JON2-4).

Model fits are checked rows-only (no SQL oracle can refit a model); the run
and registry operators are SQL-checked on runs whose metrics are computed
from the supplied tables (score variants on labelled documents).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.functions import scalar as S
from tabulon.operators import model as MD
from tabulon.operators import quality as Q
from tabulon.operators import runs as R
from tabulon.operators.ordered import materialize
from tabulon.operators import score as SC
from tabulon.plans.catalog import query
from tabulon.plans.training import train_all, tune
from tabulon.session import scratch_path
from tabulon.sources import supplied as SP
from tabulon.sources.tables import read_table

NUMERIC = ["c_acctbal", "n_orders", "total_spend", "c_nationkey"]
CATEGORICAL = ["c_mktsegment"]
METRICS = ["accuracy", "precision", "recall", "f1", "balanced_accuracy", "roc_auc", "average_precision"]


def _entity(spark, sf):
    return SP.entity_table(spark, sf).select("c_custkey", *NUMERIC, *CATEGORICAL, "churn")


def _training_table(spark, sf):
    """The weighted training table, cut from its lineage once: every estimator
    of a pipeline (scaler, indexer, classifier) and every fitted statistic
    reads it, and the join behind it should run once."""
    ent = MD.balanced_weights(_entity(spark, sf).withColumn("churn", F.col("churn").cast("double")), "churn")
    return MD.settled_over_cores(ent)


@query("mdl6_model_comparison")
def mdl6_model_comparison(spark, sf):
    """MDL1-6 + ORD1: five model families on one split, holdout metrics in one
    grouped pass, sorted by ROC AUC and rounded half-to-even to 4 places."""
    t = train_all(_entity(spark, sf), "churn", "c_custkey", NUMERIC, CATEGORICAL)
    return R.comparison_table(t.comparison, "roc_auc", 4, METRICS)


@query("mdl7_grid_search")
def mdl7_grid_search(spark, sf):
    """MDL7 + SCL15: logistic regression over C = 10^-2..10^2 (regParam = 1/(C·n)),
    5 stratified folds, ROC AUC."""
    ent = _training_table(spark, sf)
    spec = MD.fit_feature_spec(ent, NUMERIC, CATEGORICAL)
    n = ent.count()
    grid_c = S.log_grid()
    _, scores = tune(ent, spec, "logistic_regression", {"regParam": [1.0 / (c * n) for c in grid_c]},
                     "churn", "c_custkey")
    rows = [(c, p["regParam"], auc) for c, (p, auc) in zip(grid_c, scores)]
    return spark.createDataFrame(rows, "C double, regParam double, mean_roc_auc double")


@query("mdl8_feature_importance")
def mdl8_feature_importance(spark, sf):
    """MDL8 + ORD4: random-forest importances named per encoded feature, top 20."""
    ent = _training_table(spark, sf)
    spec = MD.fit_feature_spec(ent, NUMERIC, CATEGORICAL)
    m = MD.fit_model(ent, spec, "random_forest", label="churn")
    return MD.top_features(MD.feature_importance(m, spec, spark), 20)


@query("fea3_feature_expansion", f"""WITH {SP.ENTITY_SQL}
SELECT 'c_acctbal' AS source_column, CAST(1 AS BIGINT) AS n_encoded, 'num__c_acctbal' AS encoded_features
UNION ALL SELECT 'n_orders', 1, 'num__n_orders'
UNION ALL SELECT 'total_spend', 1, 'num__total_spend'
UNION ALL SELECT 'c_nationkey', 1, 'num__c_nationkey'
UNION ALL SELECT 'c_mktsegment', count(*), string_agg('cat__c_mktsegment_' || v, ',' ORDER BY v)
  FROM (SELECT DISTINCT c_mktsegment AS v FROM entity WHERE c_mktsegment IS NOT NULL)""")
def fea3_feature_expansion(spark, sf):
    """FEA3: encoded feature names and counts per source column."""
    spec = MD.fit_feature_spec(_entity(spark, sf), NUMERIC, CATEGORICAL)
    rows = [(n, n.split("__", 1)[1].rsplit("_", 1)[0] if n.startswith("cat__") else n.split("__", 1)[1])
            for n in spec.encoded_names]
    df = spark.createDataFrame(rows, "encoded_feature string, source_column string")
    return df.groupBy("source_column").agg(F.count(F.lit(1)).alias("n_encoded"),
                                           F.array_join(F.sort_array(F.collect_list("encoded_feature")), ",")
                                           .alias("encoded_features"))


def _fea4_sql() -> str:
    xs = ["coalesce(c_acctbal, 0.0)", "CAST(n_orders AS DOUBLE)", "coalesce(total_spend, 0.0)",
          "CAST(c_nationkey AS DOUBLE)"]
    terms = []
    for j in range(len(xs)):                      # degree-2 expansion order: x_j, then x_i * x_j (i <= j)
        terms.append(xs[j])
        terms += [f"{xs[i]} * {xs[j]}" for i in range(j + 1)]
    flags = " + ".join(f"CAST(var_samp({t}) > {C.FEATURE_SELECTION_THRESHOLD} AS INTEGER)" for t in terms)
    return f"""WITH {SP.ENTITY_SQL}, v AS (SELECT {flags} AS n_sel FROM entity)
SELECT c_custkey, {len(terms)} AS n_poly, (SELECT n_sel FROM v) AS n_selected FROM entity"""


@query("fea4_optional_features", _fea4_sql())
def fea4_optional_features(spark, sf):
    """FEA4 (off in the studied config): degree-2 polynomial expansion of the
    numeric features (interactions included) and variance-threshold selection."""
    from pyspark.ml.functions import vector_to_array
    ent = _entity(spark, sf)
    sel = MD.optional_features(ent, NUMERIC).transform(ent)
    return sel.select("c_custkey", F.size(vector_to_array("_expanded")).alias("n_poly"),
                      F.size(vector_to_array("optional_features")).alias("n_selected"))


def _fit_lr(spark, sf):
    ent = _training_table(spark, sf)
    spec = MD.fit_feature_spec(ent, NUMERIC, CATEGORICAL)
    return ent, spec, MD.fit_model(ent, spec, "logistic_regression", label="churn")


@query("sco1_batch_scoring")
def sco1_batch_scoring(spark, sf):
    """SCO1: the whole entity table scored at once: label, probability, tier,
    confidence, time, version."""
    ent, spec, m = _fit_lr(spark, sf)
    p = MD.positive_probability(m.transform(ent)).withColumnRenamed("c_custkey", "customer_id")
    return SC.scored_rows(p, model_version="lr-1").drop("timestamp")


@query("sco3_prediction_log", "SELECT c_custkey AS customer_id, true AS same FROM customer")
def sco3_prediction_log(spark, sf):
    """SCO3: prediction-log rows (time, id, features struct, prediction struct)
    appended by date and read back; each row's tier, confidence, label and
    features follow from its stored probability and the scored table."""
    ent, spec, m = _fit_lr(spark, sf)
    p = MD.positive_probability(m.transform(ent))
    path = scratch_path(spark, f"prediction-log-{uuid.uuid4().hex}")
    SC.append_prediction_log(SC.prediction_log_rows(p, [*NUMERIC, *CATEGORICAL], model_version="lr-1", id_col="c_custkey"), path)
    log = spark.read.parquet(path)
    q = F.col("prediction.churn_probability")
    tier = F.when(q < 0.3, "Low").when(q < 0.7, "Medium").otherwise("High")
    own = ent.select(F.col("c_custkey").cast("string").alias("customer_id"), F.struct(*NUMERIC, *CATEGORICAL).alias("own"))
    same = ((F.col("prediction.risk_level") == tier) & (F.abs(F.col("prediction.confidence") - F.greatest(q, 1 - q)) < 1e-12)
            & (F.col("prediction.churn_prediction") == (q >= 0.5).cast("int")) & F.col("features").eqNullSafe(F.col("own")))
    return log.join(own, "customer_id").select(F.col("customer_id").cast("long").alias("customer_id"), same.alias("same"))


@query("snk5_src5_model_roundtrip", "SELECT c_custkey, true AS same FROM customer")
def snk5_src5_model_roundtrip(spark, sf):
    """SNK5 + SRC5: save the fitted pipeline with its metadata, load it back and
    score: the loaded model gives the same probabilities."""
    ent, spec, m = _fit_lr(spark, sf)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    MD.save_model(m, spec, path, metrics={"note": 0.0})
    m2, spec2, meta = MD.load_model(path, spark)
    a = MD.positive_probability(m.transform(ent)).select("c_custkey", F.col("churn_probability").alias("p1"))
    b = MD.positive_probability(m2.transform(ent)).select("c_custkey", F.col("churn_probability").alias("p2"))
    return a.join(b, "c_custkey").select("c_custkey", (F.abs(F.col("p1") - F.col("p2")) < 1e-12).alias("same"))


@query("exp1_linear_contributions")
def exp1_linear_contributions(spark, sf):
    """EXP1 (linear): coef · (x - mean) per row and feature; top-20 mean |contribution|."""
    ent, spec, m = _fit_lr(spark, sf)
    scored = m.transform(ent)
    return MD.mean_abs_contribution(MD.linear_contributions(m, scored, spec, key="c_custkey"), 20)


@query("exp1_permutation_importance")
def exp1_permutation_importance(spark, sf):
    """EXP1 (trees): permutation importance (AUC drop) of each input column."""
    ent = _training_table(spark, sf)
    spec = MD.fit_feature_spec(ent, NUMERIC, CATEGORICAL)
    m = MD.fit_model(ent, spec, "random_forest", label="churn", numTrees=30)
    return MD.permutation_importance(m, ent, [*NUMERIC, *CATEGORICAL], "c_custkey", label="churn")


@query("mdl1_5_holdout_checks", f"""WITH {SP.ENTITY_SQL},
n AS (SELECT CAST(sum((c * 20 + 99) // 100) AS BIGINT) AS n_test FROM (SELECT churn, count(*) AS c FROM entity GROUP BY churn))
SELECT model, n_test, true AS metrics_equal, true AS auc_equal, true AS scores_are_shares FROM n,
  (VALUES ('logistic_regression'), ('random_forest'), ('gradient_boosting'), ('linear_svc'), ('bagging')) f(model)""")
def mdl1_5_holdout_checks(spark, sf):
    """MDL1-6: the five families (small ones) on one split; from the written holdout
    scores the metrics are computed again in SQL, and the AUC by Spark ML's evaluator."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    small = {"random_forest": {"numTrees": 8, "maxDepth": 6}, "gradient_boosting": {"maxIter": 5}, "bagging": {"numTrees": 4, "maxDepth": 6},
             "linear_svc": {"maxIter": 20}}
    t = train_all(_entity(spark, sf), "churn", "c_custkey", NUMERIC, CATEGORICAL, params=small)
    path = scratch_path(spark, f"holdout-{uuid.uuid4().hex}")
    t.predictions.write.parquet(path)
    scores = spark.read.parquet(path)
    hit = "int(label = 1 and prediction = 1)"
    again = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_test"), F.expr("avg(int(label = prediction))").alias("a"),
        F.expr(f"coalesce(try_divide(sum({hit}), sum(int(prediction = 1))), 0.0)").alias("p"),
        F.expr(f"coalesce(try_divide(sum({hit}), sum(int(label = 1))), 0.0)").alias("r"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", numBins=0)
    auc = spark.createDataFrame([(m, float(ev.evaluate(scores.where(F.col("model") == m).withColumn("label", F.col("label").cast("double")))))
                                 for m in MD.MODEL_FAMILIES], "model string, ml_auc double")              # one number per family
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) < 1e-9
    return t.comparison.join(again, "model").join(auc, "model").select(
        "model", "n_test", (near("accuracy", "a") & near("precision", "p") & near("recall", "r")).alias("metrics_equal"),
        (F.abs(F.col("roc_auc") - F.col("ml_auc")) < 1e-6).alias("auc_equal"), ((F.col("lo") >= 0) & (F.col("hi") <= 1)).alias("scores_are_shares"))


@query("mdl8_importance_checks", f"""WITH {SP.ENTITY_SQL},
k AS (SELECT 4 + count(DISTINCT c_mktsegment) AS n FROM entity)
SELECT model, n AS n_features, CAST(1.0 AS DOUBLE) AS total, least(n, 5) AS n_top, true AS in_order FROM k,
  (VALUES ('random_forest'), ('gradient_boosting')) f(model)""")
def mdl8_importance_checks(spark, sf):
    """MDL8 + ORD4: importances name every encoded column, are not negative and add
    up to 1; the top five come in order."""
    ent = _training_table(spark, sf)
    spec = MD.fit_feature_spec(ent, NUMERIC, CATEGORICAL)
    out = None
    for family, params in (("random_forest", {"numTrees": 10, "maxDepth": 6}), ("gradient_boosting", {"maxIter": 5})):
        imp = MD.feature_importance(MD.fit_model(ent, spec, family, label="churn", **params), spec, spark)
        top = MD.top_features(imp, 5).agg(F.collect_list("importance").alias("v"))
        row = imp.agg(F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("total"), F.min("importance").alias("low")).crossJoin(F.broadcast(top))
        row = row.select(F.lit(family).alias("model"), "n_features", "total", F.size("v").cast("long").alias("n_top"),
                         ((F.col("low") >= 0) & (F.col("v") == F.reverse(F.array_sort("v")))).alias("in_order"))
        out = row if out is None else out.unionByName(row)
    return out


@query("sco1_scored_checks", "SELECT c_custkey AS customer_id, true AS same FROM customer")
def sco1_scored_checks(spark, sf):
    """SCO1: each scored row's label, tier, confidence and version follow from its
    probability, and every entity is scored once."""
    ent, spec, m = _fit_lr(spark, sf)
    rows = SC.scored_rows(MD.positive_probability(m.transform(ent)).withColumnRenamed("c_custkey", "customer_id"), model_version="lr-1")
    p = F.col("churn_probability")
    tier = F.when(p < 0.3, "Low").when(p < 0.7, "Medium").otherwise("High")
    same = ((F.col("churn_prediction") == (p >= 0.5).cast("int")) & (F.col("risk_level") == tier) & (F.col("model_version") == "lr-1")
            & (F.abs(F.col("confidence") - F.greatest(p, 1 - p)) < 1e-12) & F.col("timestamp").isNotNull())
    return rows.select(F.col("customer_id").cast("long").alias("customer_id"), same.alias("same"))


@query("exp1_linear_sums", "SELECT c_custkey, true AS same FROM customer")
def exp1_linear_sums(spark, sf):
    """EXP1 (linear): a row's contributions add up to its margin less the margin of the
    mean row."""
    ent, spec, m = _fit_lr(spark, sf)
    scored = materialize(MD.positive_probability(m.transform(ent)).select("c_custkey", "features", "churn_probability"))
    total = MD.linear_contributions(m, scored, spec, key="c_custkey").groupBy("c_custkey").agg(F.sum("contribution").alias("total"))
    margin = F.log(F.col("churn_probability") / (1 - F.col("churn_probability")))
    mean = scored.agg(F.avg(margin).alias("mean"))                                     # one row: the margin is linear
    return total.join(scored, "c_custkey").crossJoin(F.broadcast(mean)).select(
        "c_custkey", (F.abs(F.col("total") - (margin - F.col("mean"))) < 1e-6).alias("same"))


def _path_sums(spark, sf, family, margin, **params):
    """Whether every row's path contributions add up to the model's own output."""
    ent = _training_table(spark, sf)
    spec = MD.fit_feature_spec(ent, NUMERIC, CATEGORICAL)
    m = MD.fit_model(ent, spec, family, label="churn", **params)
    scored = MD.positive_probability(m.transform(ent))
    parts = MD.tree_contributions(m, scored, spec, scratch_path(spark, f"trees-{uuid.uuid4().hex}"), "c_custkey")
    want = scored.select("c_custkey", margin(F.col("churn_probability")).alias("want"))
    some = F.exists("contributions", lambda x: x != 0)
    return parts.join(want, "c_custkey").select("c_custkey", ((F.abs(F.col("margin") - F.col("want")) < 1e-9) & some).alias("same"))


@query("exp1_forest_contributions", "SELECT c_custkey, true AS same FROM customer")
def exp1_forest_contributions(spark, sf):
    """EXP1 (trees): per-row path contributions of a random forest; with the bias they
    add up to each row's probability."""
    return _path_sums(spark, sf, "random_forest", lambda p: p, numTrees=20)


@query("exp1_boosting_contributions", "SELECT c_custkey, true AS same FROM customer")
def exp1_boosting_contributions(spark, sf):
    """EXP1 (trees): per-row path contributions of boosted trees, which add up to half
    the log-odds of each row's probability."""
    return _path_sums(spark, sf, "gradient_boosting", lambda p: F.log(p / (1 - p)) / 2, maxIter=10)


@query("jon4_class_weights", f"""WITH {SP.ENTITY_SQL}
SELECT churn, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS class_weight
FROM entity GROUP BY churn""")
def jon4_class_weights(spark, sf):
    """JON4: balanced class weights n / (k · n_class) joined to the rows."""
    w = MD.balanced_weights(SP.entity_table(spark, sf).select("c_custkey", "churn"), "churn")
    return w.groupBy("churn").agg(F.count(F.lit(1)).alias("n"), F.first("class_weight").alias("class_weight"))


@query("jon3_tier_actions", f"""WITH {SP.PREDLOG_SQL},
actions AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {i + 1}, '{a}')" for t, acts in C.TIER_ACTIONS.items() for i, a in enumerate(acts))}) v(risk_level, step, action)),
t AS (SELECT CASE WHEN churn_probability < 0.3 THEN 'Low' WHEN churn_probability < 0.7 THEN 'Medium' ELSE 'High' END AS risk_level
      FROM predlog)
SELECT t.risk_level, step, action, count(*) AS n_entities FROM t JOIN actions a ON t.risk_level = a.risk_level
GROUP BY t.risk_level, step, action""")
def jon3_tier_actions(spark, sf):
    """JON3: recommended actions per tier joined (broadcast: 12 fixed rows) to the scored log."""
    rows = [(t, i + 1, a) for t, acts in C.TIER_ACTIONS.items() for i, a in enumerate(acts)]
    actions = spark.createDataFrame(rows, "risk_level string, step int, action string")
    log = SP.prediction_log(spark, sf).select(S.risk_tier("churn_probability").alias("risk_level"))
    return (log.join(F.broadcast(actions), "risk_level")
            .groupBy("risk_level", "step", "action").agg(F.count(F.lit(1)).alias("n_entities")))


# --- runs and registry on score variants of the labelled documents -----------------

VARIANTS = {
    "run_chars": "n_chars",
    "run_spaces": "length(text) - length(replace(text, ' ', ''))",
    "run_inverse": "-n_chars",
    "run_lang": "CASE WHEN lang = 'en' THEN 1 ELSE 0 END + n_chars / 1000000.0",
}
ARTIFACT_RUNS = ("run_spaces", "run_inverse", "run_lang")


def _variant_scores(spark, sf):
    docs = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    j = docs.join(lab, "doc_id")
    runs = [F.struct(F.lit(r).alias("run_id"), F.expr(e).cast("double").alias("score")) for r, e in VARIANTS.items()]
    return j.select("doc_id", "label", F.inline(F.array(*runs)))                 # one read for all runs


def _variant_metrics(spark, sf):
    """run_id, roc_auc and average_precision of every run, in one pass."""
    return Q.ranking_of(Q.score_table(_variant_scores(spark, sf), group=["run_id"]), ["run_id"]).drop("status")


def _variant_sql():
    parts = " UNION ALL ".join(
        f"SELECT '{r}' AS run_id, d.doc_id, CAST(l.quality AS INTEGER) AS label, CAST({e} AS DOUBLE) AS score "
        f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id" for r, e in VARIANTS.items())
    return f"""vs AS ({parts}),
s AS (SELECT run_id, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM vs GROUP BY run_id, score),
ra AS (SELECT run_id, pos, neg, sum(neg) OVER (PARTITION BY run_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_run FROM s),
rp AS (SELECT run_id, pos, sum(pos) OVER (PARTITION BY run_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
              sum(neg) OVER (PARTITION BY run_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM s),
auc AS (SELECT run_id, sum(pos * (neg_run - neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM ra GROUP BY run_id),
ap AS (SELECT rp.run_id, sum(pos / P * tp / (tp + fp)) AS average_precision FROM rp
       JOIN (SELECT run_id, sum(pos) AS P FROM s GROUP BY run_id) t ON rp.run_id = t.run_id GROUP BY rp.run_id),
wide AS (SELECT auc.run_id, roc_auc, average_precision FROM auc JOIN ap ON auc.run_id = ap.run_id),
run_metrics AS (SELECT run_id, 'roc_auc' AS key, roc_auc AS value FROM wide
                UNION ALL SELECT run_id, 'average_precision', average_precision FROM wide),
artifacts AS (SELECT * FROM (VALUES {", ".join(f"('{r}')" for r in ARTIFACT_RUNS)}) a(run_id))"""


def _run_metrics(spark, sf):
    return R.metrics_long(_variant_metrics(spark, sf), "run_id", ["roc_auc", "average_precision"], parent="parent_0")


def _artifacts(spark):
    return spark.createDataFrame([(r,) for r in ARTIFACT_RUNS], "run_id string")


@query("snk6_run_metrics", f"""WITH {_variant_sql()}
SELECT run_id, 'parent_0' AS parent_id, key, round(value, 6) AS value FROM run_metrics""")
def snk6_run_metrics(spark, sf):
    """SNK6: run metrics as a long table (four scoring runs under one parent),
    all runs evaluated in one grouped pass."""
    return _run_metrics(spark, sf)


@query("ord3_best_run", f"""WITH {_variant_sql()},
m AS (SELECT run_id, value AS metric FROM run_metrics WHERE key = 'roc_auc'),
top AS (SELECT * FROM m ORDER BY metric DESC NULLS LAST, run_id LIMIT 50),
pool AS (SELECT run_id, metric, true AS has_artifact FROM top WHERE run_id IN (SELECT run_id FROM artifacts)
         UNION ALL SELECT run_id, metric, false FROM top)
SELECT run_id, round(metric, 6) AS metric, has_artifact FROM pool
ORDER BY has_artifact DESC, metric DESC NULLS LAST, run_id LIMIT 1""")
def ord3_best_run(spark, sf):
    """ORD3 + JON2: best run by ROC AUC among the top 50 that have an artifact."""
    return R.best_run(_run_metrics(spark, sf), _artifacts(spark), "roc_auc")


@query("ord2_best_by_metric", f"""WITH {_variant_sql()}
SELECT arg_max(run_id, roc_auc) AS best_run_id, round(max(roc_auc), 6) AS best_roc_auc FROM wide""")
def ord2_best_by_metric(spark, sf):
    """ORD2: name with the highest metric."""
    return R.best_by(_variant_metrics(spark, sf), "run_id", "roc_auc")


@query("ord1_comparison_table", f"""WITH {_variant_sql()}
SELECT run_id, round_even(roc_auc, 4) AS roc_auc, round_even(average_precision, 4) AS average_precision FROM wide""")
def ord1_comparison_table(spark, sf):
    """ORD1: comparison sorted by ROC AUC, rounded half-to-even (4 places)."""
    return R.comparison_table(_variant_metrics(spark, sf), "roc_auc", 4, ["roc_auc", "average_precision"])


_PROMOTED = """SELECT name, version, run_id, round(metric, 6) AS metric, round(lag(metric) OVER w, 6) AS previous_metric,
  CASE WHEN lag(metric) OVER w IS NULL OR metric >= lag(metric) OVER w THEN 'promote' ELSE 'rollback' END AS decision
FROM v WINDOW w AS (PARTITION BY name ORDER BY version)"""

#: versions that the registry holds before the runs are registered
EARLIER = [("churn_model", 1, "old_a", 0.99), ("churn_model", 2, "old_b", 0.5), ("other_model", 7, "old_c", 0.7)]
_EARLIER_SQL = ", ".join(f"('{n}', {v}, '{r}', {m})" for n, v, r, m in EARLIER)


@query("reg1_reg2_registry", f"""WITH {_variant_sql()},
m AS (SELECT run_id, value AS metric FROM run_metrics WHERE key = 'roc_auc'),
e AS (SELECT name, version, run_id, CAST(metric AS DOUBLE) AS metric FROM (VALUES {_EARLIER_SQL}) t(name, version, run_id, metric)),
v AS (SELECT * FROM e UNION ALL SELECT 'churn_model', CAST(2 + row_number() OVER (ORDER BY run_id) AS INTEGER), run_id, metric FROM m)
{_PROMOTED}""")
def reg1_reg2_registry(spark, sf):
    """REG1 + REG2: register each run in id order after the versions that are
    there, then promote / roll back against the previous version."""
    m = _run_metrics(spark, sf).where(F.col("key") == "roc_auc").select("run_id", F.col("value").alias("metric"))
    return R.promotion(R.register_batch(spark.createDataFrame(EARLIER, R.VERSIONS), m, "churn_model"))


@query("reg1_stored_registry", f"""WITH {_variant_sql()},
m AS (SELECT run_id, value AS metric FROM run_metrics WHERE key = 'roc_auc'),
v AS (SELECT 'churn_model' AS name, CAST(1 + row_number() OVER (ORDER BY metric, run_id) AS INTEGER) AS version, run_id, metric FROM m
      UNION ALL SELECT 'churn_model', 1, 'old_a', CAST(0.99 AS DOUBLE))
{_PROMOTED}""")
def reg1_stored_registry(spark, sf):
    """REG1 + REG2 on the stored registry: runs take versions from the worst to the
    best, one of them twice, after a version that is there."""
    base = scratch_path(spark, f"registry-{uuid.uuid4().hex}")
    R.register_stored(spark, base, "churn_model", "old_a", 0.99)
    runs = _run_metrics(spark, sf).where(F.col("key") == "roc_auc").orderBy("value", "run_id").collect()   # one row per run
    for r in [*runs, runs[0]]:
        R.register_stored(spark, base, "churn_model", r["run_id"], r["value"])
    return R.promotion(R.stored_versions(spark, base))


@query("snk6_run_params", f"""WITH {_variant_sql()},
n AS (SELECT run_id, count(*) AS n_rows, min(score) AS lo, max(score) AS hi FROM vs GROUP BY run_id),
x AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{e.replace(chr(39), chr(39) * 2)}')" for r, e in VARIANTS.items())}) t(run_id, e)),
p AS (SELECT run_id, 'score_expr' AS key, e AS value FROM x UNION ALL SELECT run_id, 'n_rows', CAST(n_rows AS VARCHAR) FROM n),
b AS (SELECT arg_max(run_id, value) AS run_id FROM run_metrics WHERE key = 'average_precision')
SELECT run_id, 'parent_0' AS parent_id, key, value FROM p
UNION ALL SELECT 'parent_0', NULL, 'best_' || key, value FROM p WHERE run_id = (SELECT run_id FROM b)""")
def snk6_run_params(spark, sf):
    """SNK6: parameters of the runs and, for their parent, those of its best run,
    appended to the stored run tables in two batches and read back."""
    base = scratch_path(spark, f"runs-{uuid.uuid4().hex}")
    sc = _variant_scores(spark, sf)
    exprs = spark.createDataFrame([(r, e) for r, e in VARIANTS.items()], "run_id string, e string")
    n = sc.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(exprs), "run_id")
    params = n.select("run_id", F.lit("parent_0").alias("parent_id"), F.inline(F.array(
        F.struct(F.lit("score_expr").alias("key"), F.col("e").alias("value")), F.struct(F.lit("n_rows").alias("key"), F.col("n").cast("string").alias("value")))))
    R.log_runs(base, "runs", params, _run_metrics(spark, sf))
    done = R.stored_runs(spark, base, "params")
    best = R.best_params(done, R.stored_runs(spark, base, "metrics"), "average_precision")
    R.log_runs(base, "best", best, spark.createDataFrame([], R.METRICS))
    return R.stored_runs(spark, base, "params")
