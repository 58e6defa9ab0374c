"""Training flow: split → fit feature statistics → fit each model family →
score the holdout → compare all models in one grouped evaluation → tune the
best with stratified-fold cross validation.

The prepared training table is checkpointed (written to the shared
checkpoint folder) so the many model fits reuse it without recomputing the
joins, and a lost executor re-reads it instead of replaying the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.operators import model as MD
from tabulon.operators import quality as Q
from tabulon.operators.ordered import materialize
from tabulon.operators.sample import stratified_folds, stratified_split


#: families by their number of jobs one after the other, and how many are fitted at a time
LONGEST, FITS_AT_ONCE = ("gradient_boosting", "linear_svc"), 2


@dataclass
class Trained:
    spec: MD.FeatureSpec
    models: dict
    predictions: DataFrame
    comparison: DataFrame
    train: DataFrame
    test: DataFrame


def split_and_weight(df: DataFrame, label: str, key: str) -> tuple[DataFrame, DataFrame]:
    sp = stratified_split(df, label, key)
    sp = MD.balanced_weights(sp, label)
    sp = MD.settled_over_cores(sp, even=True)   # reliable checkpoint in the shared folder
    return sp.where(F.col("split") == "train").drop("split"), sp.where(F.col("split") == "test").drop("split")


def train_all(df: DataFrame, label: str, key: str, numeric: Sequence[str], categorical: Sequence[str],
              families: Sequence[str] = MD.MODEL_FAMILIES, params: dict | None = None) -> Trained:
    """MDL6: every family on the same prepared data; metrics in one pass over
    the unioned holdout predictions grouped by model.  Families are fitted and score
    the holdout side by side, those of many short jobs first: the jobs of one leave
    cores to the others."""
    params = params or {}
    train, test = split_and_weight(df.withColumn(label, F.col(label).cast("double")), label, key)
    spec = MD.fit_feature_spec(train, numeric, categorical)
    features = MD.fit_features(train, spec)
    first = sorted(families, key=lambda f: LONGEST.index(f) if f in LONGEST else len(LONGEST))

    def fitted(fam):
        m = MD.fit_model(train, spec, fam, label=label, key=key, features=features, **params.get(fam, {}))
        p = MD.positive_probability(m.transform(test)).select(
            F.lit(fam).alias("model"), F.col(key), F.col(label).cast("int").alias("label"),
            F.col("churn_probability").alias("score"),
            (F.col("churn_probability") >= C.LABEL_CUT).cast("int").alias("prediction"))
        return m, materialize(p)
    with ThreadPool(max(1, min(FITS_AT_ONCE, len(first)))) as pool:
        done = dict(zip(first, pool.map(inheritable_thread_target(df.sparkSession)(fitted), first, chunksize=1)))
    models = {fam: done[fam][0] for fam in families}
    preds = reduce(DataFrame.unionByName, [done[fam][1] for fam in families]) if families else None
    return Trained(spec, models, preds, compared(preds), train, test)


METRICS = ("accuracy", "average_precision", "balanced_accuracy", "f1", "precision", "recall", "roc_auc")


def compared(preds: DataFrame) -> DataFrame:
    """One row of metrics per model; the holdout is scored once for all of them."""
    table = Q.score_table(preds, prediction="prediction", group=["model"])
    return Q.evaluation_of(table, ["model"]).select("model", *METRICS)


def tune(train: DataFrame, spec: MD.FeatureSpec, family: str, grid: dict, label: str, key: str,
         k: int = C.CV_FOLDS):
    """MDL7: stratified folds as a column, then ``cross_validate``."""
    folded = stratified_folds(train, label, key, k=k).withColumn(label, F.col(label).cast("double"))
    # every fold x parameter fit reads this table: derive the folds once
    folded = MD.settled_over_cores(folded)
    return MD.cross_validate(folded, spec, family, grid, label=label, num_folds=k)


def tune_best(t: Trained, label: str, key: str, metric: str = "roc_auc", k: int = C.CV_FOLDS, grid: dict | None = None):
    """MDL6 → MDL7: tune the best family of ``train_all`` with its grid, then
    evaluate the tuned model on the same holdout.  Returns (family, tuned
    model, comparison of untuned vs tuned metrics) - the tuned model is the
    one to save (the studied pipeline saved the untuned one)."""
    best = t.comparison.orderBy(F.col(metric).desc_nulls_last(), "model").first()["model"]
    n = t.train.count()
    tuned, scores = tune(t.train, t.spec, best, grid or MD.grid_for(best, n), label, key, k)
    if best == "linear_svc":      # its margins need the calibration stage: refit the best parameters
        tuned = MD.fit_model(t.train, t.spec, best, label, key=key, **max(scores, key=lambda x: x[1])[0])
    p = MD.positive_probability(tuned.transform(t.test)).select(
        F.lit("tuned").alias("model"), F.col(key), F.col(label).cast("int").alias("label"),
        F.col("churn_probability").alias("score"),
        (F.col("churn_probability") >= C.LABEL_CUT).cast("int").alias("prediction"))
    base = t.predictions.where(F.col("model") == best).withColumn("model", F.lit("untuned"))
    return best, tuned, compared(base.unionByName(p))
