"""Classification metrics and splits: identities and agreement with MLlib."""

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabulon.operators import quality as Q
from tabulon.operators import sample as SM


def _scored(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)   # ties on purpose
    return spark.createDataFrame([(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                                 "id long, label int, score double")


def test_auc_matches_mllib(spark):
    df = _scored(spark)
    ours = Q.roc_auc(df).first()["roc_auc"]
    v = df.select(F.col("label").cast("double").alias("label"),
                  F.array(1 - F.col("score"), F.col("score")).alias("a"))
    from pyspark.ml.functions import array_to_vector
    v = v.select("label", array_to_vector("a").alias("rawPrediction"))
    ml = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(v)
    assert abs(ours - ml) < 1e-9


def test_auc_of_reversed_scores(spark):
    df = _scored(spark)
    a = Q.roc_auc(df).first()["roc_auc"]
    b = Q.roc_auc(df.withColumn("score", -F.col("score"))).first()["roc_auc"]
    assert abs(a + b - 1) < 1e-12


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    r = Q.roc_auc(df).first()
    assert r["roc_auc"] is None and r["status"] == "one_class"


def test_no_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    r = Q.binary_metrics(df).first()
    assert r["precision"] == 0.0 and r["f1"] == 0.0 and r["accuracy"] == 0.5


def test_average_precision_step_sum(spark):
    # sklearn example: y = [0, 0, 1, 1], s = [0.1, 0.4, 0.35, 0.8] → AP 0.8333...
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    assert abs(Q.average_precision(df).first()["average_precision"] - 0.8333333333) < 1e-9


def test_split_disjoint_complete_and_folds_balanced(spark):
    df = _scored(spark, 503)
    sp = SM.stratified_split(df, "label", "id").toPandas()
    assert len(sp) == 503 and sp["id"].is_unique
    for lab, g in sp.groupby("label"):
        n = len(g)
        assert (g["split"] == "test").sum() == (n * 20 + 99) // 100
    f = SM.stratified_folds(df, "label", "id", k=5).toPandas()
    sizes = f.groupby(["label", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1


def test_tier_counts_sum_to_n(spark):
    from tabulon.operators.monitor import tier_distribution
    df = _scored(spark).withColumnRenamed("score", "churn_probability")
    t = tier_distribution(df).collect()
    assert sum(r["n"] for r in t) == 600 and {r["risk_level"] for r in t} == {"Low", "Medium", "High"}


def test_global_row_number(spark):
    df = _scored(spark).select("id", F.col("score").alias("s"))
    r = SM.global_row_number(df, "s", tiebreak=["id"]).toPandas().sort_values("row_number")
    assert list(r["row_number"]) == list(range(1, 601))
    assert (np.diff(r["s"].to_numpy()) >= 0).all()


def test_curve_points_integrate_to_auc(spark):
    df = _scored(spark)
    pts = Q.curve_points(df).toPandas().sort_values(["fpr", "tpr"])
    area = float(np.sum(np.diff(pts["fpr"]) * (pts["tpr"].to_numpy()[1:] + pts["tpr"].to_numpy()[:-1]) / 2))
    assert abs(area - Q.roc_auc(df).first()["roc_auc"]) < 1e-12
    anchor = pts[pts["threshold"].isna()].iloc[0]
    assert anchor["fpr"] == 0 and anchor["tpr"] == 0 and anchor["precision"] == 1
