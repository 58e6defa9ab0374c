"""Stored runs and versions, values seen at training, path contributions, and what
a fitted model must satisfy."""

import threading

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import model as MD
from tabulon.operators import quality as Q
from tabulon.operators import runs as R
from tabulon.plans.training import compared, train_all, tune
from tabulon.session import scratch_path


@pytest.fixture()
def base(spark, tmp_path):
    return scratch_path(spark, tmp_path.name)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 240
    x, z, c = rng.normal(0, 1, n), rng.normal(0, 1, n), rng.choice(["a", "b", "c"], n)
    y = (x + 0.7 * (c == "b") + rng.normal(0, 0.6, n) > 0).astype(float)
    rows = [(i, float(x[i]), None if i % 29 == 0 else float(z[i]), None if i % 31 == 0 else str(c[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, x double, z double, c string, y double")
    return MD.balanced_weights(df, "y").checkpoint()


@pytest.fixture(scope="module")
def spec(table):
    return MD.fit_feature_spec(table, ["x", "z"], ["c"])


# --- runs and versions -----------------------------------------------------------------

def test_batches_of_runs_are_appended_and_replaced(spark, base):
    assert R.stored_runs(spark, base, "params").count() == 0
    R.log_runs(base, "a", *R.run_rows(spark, "r1", "p", {"depth": 3}, {"auc": 0.7}))
    R.log_runs(base, "b", *R.run_rows(spark, "r2", "p", {"depth": 5}, {"auc": 0.8, "f1": None}))
    R.log_runs(base, "a", *R.run_rows(spark, "r1", "p", {"depth": 4}, {"auc": 0.75}))          # repeated batch
    params, metrics = R.stored_runs(spark, base, "params"), R.stored_runs(spark, base, "metrics")
    assert {(r.run_id, r.parent_id, r.key, r.value) for r in params.collect()} == {("r1", "p", "depth", "4"), ("r2", "p", "depth", "5")}
    assert metrics.count() == 3
    assert [tuple(r) for r in R.best_params(params, metrics, "auc").collect()] == [("p", None, "best_depth", "5")]
    params.limit(0).write.parquet(base + "/params/batch=torn")                                     # no commit: not seen
    assert R.stored_runs(spark, base, "params").count() == 2


def test_two_writers_get_different_versions(spark, base):
    assert R.register_stored(spark, base, "m", "old", 0.5) == 1
    got, start = {}, threading.Barrier(4)

    def work(run):
        start.wait()
        got[run] = R.register_stored(spark, base, "m", run, 0.1 * len(run))
    threads = [threading.Thread(target=work, args=(f"run{'x' * i}",)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got.values()) == [2, 3, 4, 5]
    assert R.register_stored(spark, base, "m", "run", 0.3) == got["run"]                          # a repeated call
    assert R.register_stored(spark, base, "other", "run", 0.3) == 1
    assert R.stored_versions(spark, base).where("name = 'm'").count() == 5


def test_a_number_that_another_writer_takes_is_passed_over(spark, base, monkeypatch):
    assert R.write_if_absent(spark, base + "/f", "one") and not R.write_if_absent(spark, base + "/f", "two")
    R.take_version(spark, base, "m", "first")
    monkeypatch.setattr(R, "_names", lambda *a: [])                                                # a listing from before
    assert R.take_version(spark, base, "m", "second") == 2


# --- values seen at training ---------------------------------------------------------------

def test_new_categories_are_found(spark, base, table, spec):
    m = MD.fit_model(table, spec, "logistic_regression", label="y", key="k")
    MD.save_model(m, spec, base)
    new = table.withColumn("c", F.when(F.col("k") % 10 == 0, "new").when(F.col("k") % 10 == 1, "A").otherwise(F.col("c")))
    assert {(r.column_name, r.value, r.n) for r in MD.unseen_categories(new, base).collect()} == {("c", "new", 24), ("c", "A", 24)}
    assert MD.unseen_categories(table, base).isEmpty() and MD.unseen_categories(table.drop("c"), base).isEmpty()


@pytest.mark.parametrize("most", [MD.BLOOM_MOST, 1])
def test_the_sketch_only_saves_work(spark, base, monkeypatch, most):
    monkeypatch.setattr(MD, "BLOOM_MOST", most)
    seen = spark.range(3000).select(F.lit("u").alias("column_name"), F.concat(F.lit("v"), "id").alias("value"))
    MD.save_seen_values(seen, base)
    sketch = spark.read.parquet(base + "/seen/sketch")
    assert sketch.isEmpty() == (most == 1)
    df = spark.range(2000, 6000).select(F.concat(F.lit("v"), "id").alias("u"))
    got = {r.value for r in MD.unseen_categories(df, base).collect()}
    assert got == {f"v{i}" for i in range(3000, 6000)}
    if most > 1:      # about one value in a hundred is let through to the exact lists
        ones = sketch.select(F.sum(F.bit_count("mask"))).first()[0]
        assert 0.3 < ones / sketch.first()["bits"] < 0.7


# --- path contributions -------------------------------------------------------------------

@pytest.mark.parametrize("family,params", [("random_forest", {"numTrees": 7}), ("gradient_boosting", {"maxIter": 5}), ("bagging", {"numTrees": 4})])
def test_contributions_add_up_to_the_margin(spark, base, table, spec, family, params):
    m = MD.fit_model(table, spec, family, label="y", key="k", **params)
    scored = MD.positive_probability(m.transform(table))
    parts = MD.tree_contributions(m, scored, spec, base, "k")
    got = {r.k: r for r in parts.collect()}
    for r in scored.select("k", "churn_probability").collect():
        p = r.churn_probability
        want = np.log(p / (1 - p)) / 2 if family == "gradient_boosting" else p
        assert abs(got[r.k].margin - want) < 1e-9 and abs(got[r.k].bias + sum(got[r.k].contributions) - want) < 1e-9
    top = MD.mean_abs_contribution(MD.named_contributions(parts, spec)).collect()
    assert top[0].feature == "num__x" and {r.feature for r in top} == set(spec.encoded_names)


def test_a_stump_gives_all_to_its_feature(spark, base, table, spec):
    m = MD.fit_model(table, spec, "random_forest", label="y", key="k", numTrees=1, maxDepth=1)
    parts = MD.tree_contributions(m, m.transform(table), spec, base, "k").collect()
    used = {i for r in parts for i, v in enumerate(r.contributions) if v}
    assert len(used) == 1 and len({r.margin for r in parts}) == 2


# --- what a fit must satisfy ----------------------------------------------------------------

def test_logistic_regression_has_no_gradient_left(table, spec):
    m = MD.fit_model(table, spec, "logistic_regression", label="y", key="k", tol=1e-10)
    p = MD.positive_probability(m.transform(table)).select(vector_to_array("features").alias("f"), "y", "class_weight", "churn_probability").toPandas()
    x = np.c_[np.array(p["f"].tolist()), np.ones(len(p))]
    gradient = x.T @ (p["class_weight"] * (p["churn_probability"] - p["y"])) / p["class_weight"].sum()
    assert np.abs(gradient).max() < 1e-4


@pytest.mark.parametrize("family", ["random_forest", "gradient_boosting", "bagging"])
def test_importances_add_up_to_one(spark, table, spec, family):
    params = {"maxIter": 3} if family == "gradient_boosting" else {"numTrees": 3}
    m = MD.fit_model(table, spec, family, label="y", key="k", **params)
    rows = MD.feature_importance(m, spec, spark).collect()
    assert abs(sum(r.importance for r in rows) - 1) < 1e-9 and {r.feature for r in rows} == set(spec.encoded_names)


@pytest.mark.parametrize("family", ["random_forest", "gradient_boosting", "bagging"])
def test_every_grid_runs(table, spec, family):
    """Each parameter of the family's grid is tried at two values, small ones for trees."""
    small = {"numTrees": [2, 3], "maxIter": [2, 3], "maxDepth": [3, 2], "minInstancesPerNode": [1, 5], "stepSize": [0.05, 0.1], "subsamplingRate": [0.5, 1.0]}
    grid = {k: small[k] for k in MD.grid_for(family, 240)}
    assert all(len(v) == 2 for v in MD.grid_for(family, 240).values())
    model, scores = tune(table, spec, family, {k: v for k, v in list(grid.items())[:2]}, "y", "k", k=2)
    assert len(scores) == 4 and all(0.5 < a <= 1 for _, a in scores)
    last = dict(list(grid.items())[2:])
    if last:
        assert len(tune(table, spec, family, {k: v[:1] for k, v in last.items()}, "y", "k", k=2)[1]) == 1


def test_comparison_equals_sql_on_the_written_scores(spark, table, base):
    t = train_all(table.drop("class_weight"), "y", "k", ["x", "z"], ["c"], families=("logistic_regression", "bagging"), params={"bagging": {"numTrees": 3}})
    t.predictions.write.parquet(base + "/scores")
    spark.read.parquet(base + "/scores").createOrReplaceTempView("holdout_scores")
    sql = spark.sql("""SELECT model, avg(int(label = prediction)) accuracy, sum(int(label = 1 and prediction = 1)) / sum(int(prediction = 1)) `precision`,
      sum(int(label = 1 and prediction = 1)) / sum(int(label = 1)) recall FROM holdout_scores GROUP BY model""").collect()
    got = {r.model: r for r in t.comparison.collect()}
    assert len(sql) == 2 and all(abs(got[r.model][m] - r[m]) < 1e-12 for r in sql for m in ("accuracy", "precision", "recall"))
    assert compared(t.predictions).count() == 2


def test_optional_features_and_nested_record(spark, table):
    m = MD.optional_features(table, ["x", "z"], threshold=0.5)
    out = m.transform(table).select(F.size(vector_to_array("_expanded")).alias("all"), F.size(vector_to_array("optional_features")).alias("kept")).distinct().collect()
    assert len(out) == 1 and out[0]["all"] == 5 and 0 < out[0]["kept"] <= 5
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)], "label int, score double")
    r = Q.evaluation_record(Q.with_prediction(df), "m", "2", n_features=7).first()
    assert r.model_info.n_features == 7 and r.metrics.accuracy == 0.5 and r.metrics.roc_auc == 0.75
    assert r.data_info.n_rows == 4 and r.class_distribution.positive_share == 0.5


def test_features_are_fitted_once_a_fold(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    rows = [(i, float((i * 7) % 13), "abc"[i % 3], float((i * 5) % 11 + i % 3 > 6), 1.0, i % 2) for i in range(120)]
    table = spark.createDataFrame(rows, "k long, x double, c string, label double, class_weight double, fold int").checkpoint()
    spec = MD.fit_feature_spec(table, ["x"], ["c"])
    est = MD.classifier("logistic_regression")
    maps = ParamGridBuilder().addGrid(est.regParam, [0.01, 0.1, 10.0]).build()
    whole = CrossValidator(estimator=Pipeline(stages=MD.feature_stages(spec) + [est]), estimatorParamMaps=maps, foldCol="fold", numFolds=2,
                           evaluator=BinaryClassificationEvaluator(labelCol="label")).fit(table)
    fits, fit = [], MD.StandardScaler._fit
    monkeypatch.setattr(MD.StandardScaler, "_fit", lambda self, d: fits.append(1) or fit(self, d))
    best, scores = MD.cross_validate(table, spec, "logistic_regression", {"regParam": [0.01, 0.1, 10.0]}, num_folds=2)
    assert np.allclose([s for _, s in scores], whole.avgMetrics, atol=1e-9) and [p["regParam"] for p, _ in scores] == [0.01, 0.1, 10.0]
    assert np.allclose(best.stages[-1].coefficients.toArray(), whole.bestModel.stages[-1].coefficients.toArray(), atol=1e-9)
    assert len(fits) == 3                                            # each fold, and the best model


def test_forests_keep_node_ids_and_use_the_cores(spark):
    assert all(MD.classifier(f).getCacheNodeIds() for f in ("random_forest", "bagging"))
    few = spark.range(3 * MD.ROWS_PER_CORE).coalesce(1)
    wide = MD.settled_over_cores(few)
    assert wide.rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism) and wide.distinct().count() == 3 * MD.ROWS_PER_CORE
    assert MD.settled_over_cores(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 1
