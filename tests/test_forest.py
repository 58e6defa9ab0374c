"""Forests that the driver does not hold: what a fit must satisfy, with and without
large nodes, beside Spark ML's forest."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabulon.operators import forest as FO
from tabulon.operators import model as MD
from tabulon.session import scratch_path


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 700
    x, z, c = rng.normal(0, 1, n), rng.integers(0, 6, n), rng.choice(["a", "b", "c"], n)
    y = (x + 0.9 * (c == "b") + 0.2 * z + rng.normal(0, 0.6, n) > 0.6).astype(float)
    rows = [(i, float(x[i]), None if i % 29 == 0 else float(z[i]), None if i % 31 == 0 else str(c[i]), float(y[i])) for i in range(n)]
    return MD.balanced_weights(spark.createDataFrame(rows, "k long, x double, z double, c string, y double").repartition(3, "k"), "y").checkpoint()


@pytest.fixture(scope="module")
def spec(table):
    return MD.fit_feature_spec(table, ["x", "z"], ["c"])


def _large(monkeypatch, local_rows=None, pack=None):
    monkeypatch.setattr(MD, "DRIVER_NODES", 0)
    if local_rows:
        monkeypatch.setattr(FO, "LOCAL_BYTES", local_rows * 15)            # five features
    if pack:
        monkeypatch.setattr(FO, "PACK_NODES", pack)


def _scores(m, table):
    return {r.k: (r.churn_probability, r.prediction) for r in MD.positive_probability(m.transform(table)).select("k", "churn_probability", "prediction").collect()}


def test_the_limit_counts_nodes():
    assert MD.forest_nodes("random_forest", 900_000, {}) == 180_000_000 > MD.DRIVER_NODES
    assert MD.forest_nodes("random_forest", 900_000, {"numTrees": 10, "maxDepth": 6}) == 1280
    assert MD.forest_nodes("random_forest", 1500, {}) < MD.DRIVER_NODES


@pytest.mark.parametrize("family,params", [("bagging", {"numTrees": 20}), ("random_forest", {"numTrees": 40, "maxDepth": 4, "minInstancesPerNode": 5})])
def test_a_large_forest_is_like_spark_mls(monkeypatch, table, spec, family, params):
    ml = MD.fit_model(table, spec, family, label="y", **params)
    _large(monkeypatch)
    own = MD.fit_model(table, spec, family, label="y", **params)
    assert isinstance(own.stages[-1], FO.ForestModel) and own.stages[-1].getNumTrees == params["numTrees"]
    a, b = ml.stages[-1].featureImportances.toArray(), own.stages[-1].featureImportances.toArray()
    assert abs(b.sum() - 1) < 1e-9 and np.abs(a - b).max() < 0.08 and (a.argsort()[-2:] == b.argsort()[-2:]).all()
    assert abs(own.stages[-1].totalNumNodes / ml.stages[-1].totalNumNodes - 1) < 0.12
    p, q = _scores(ml, table), _scores(own, table)
    assert set(p) == set(q) and np.mean([abs(p[k][0] - q[k][0]) for k in p]) < 0.08
    assert all((v > 0.5) == (said == 1.0) for v, said in q.values() if abs(v - 0.5) > 1e-9)


@pytest.mark.parametrize("nodes_at_once", [2, 4096])
def test_a_tree_has_the_best_splits_and_its_rows(monkeypatch, nodes_at_once):
    monkeypatch.setattr(FO, "NODES_AT_ONCE", nodes_at_once)
    rng = np.random.default_rng(3)
    x, count = rng.integers(0, [[9], [32], [2]], (3, 800)).astype(np.uint8), rng.integers(1, 4, 800).astype(np.uint8)
    y = (x[0] + 0.2 * x[1] + rng.normal(0, 2, 800) > 8).astype(np.uint8) + (x[2] > 0).astype(np.uint8)
    w = count * np.array([0.7, 1.0, 2.5])[y]
    for depth, least in ((30, 1), (4, 20)):
        tree = FO.grow(x, y, w, count, np.random.default_rng(1), 3, depth, 3, least)
        leaf = FO.walk(x, tree)
        of = {i: np.flatnonzero(leaf == i) for i in np.flatnonzero(tree["feature"] < 0)}
        assert sum(len(r) for r in of.values()) == 800 and min(count[r].sum() for r in of.values()) >= least
        for i, r in of.items():
            assert np.allclose(tree["stats"][:, i], np.bincount(y[r], w[r], 3))
        gini = lambda r: 1 - ((np.bincount(y[r], w[r], 3) / w[r].sum()) ** 2).sum()
        for i, r in {0: np.arange(800), tree["left"][0]: np.flatnonzero(x[tree["feature"][0]] <= tree["cut"][0])}.items():
            gains = {}
            for f in range(3):
                for c in range(31):
                    low, high = r[x[f, r] <= c], r[x[f, r] > c]
                    if min(count[low].sum(), count[high].sum()) >= least:
                        gains[f, c] = gini(r) - (w[low].sum() * gini(low) + w[high].sum() * gini(high)) / w[r].sum()
            got = (int(tree["feature"][i]), int(tree["cut"][i]))
            assert abs(gains[got] - max(gains.values())) < 1e-12 and abs(tree["gain"][i] - gains[got]) < 1e-12
        if depth == 30:                              # a cell of one class has it, but for four cells that cross (no split gains)
            cells = {tuple(v): np.flatnonzero((x.T == v).all(axis=1)) for v in np.unique(x.T, axis=0)}
            assert sum(tree["stats"][:, leaf[r[0]]].argmax() != y[r[0]] for r in cells.values() if len(set(y[r])) == 1) <= 2


@pytest.mark.parametrize("local_rows,pack", [(None, None), (60, 40)])
def test_contributions_and_a_stored_forest(monkeypatch, spark, tmp_path, table, spec, local_rows, pack):
    _large(monkeypatch, local_rows, pack)
    m = MD.fit_model(table, spec, "random_forest", label="y", numTrees=6)
    forest = m.stages[-1]
    assert (max(len(t["feature"]) for t in forest.tops) > 1) == bool(local_rows)
    again = MD.fit_model(table, spec, "random_forest", label="y", numTrees=6).stages[-1]
    assert np.array_equal(again.importances, forest.importances)
    p = _scores(m, table)
    base = scratch_path(spark, tmp_path.name)
    parts = MD.tree_contributions(m, m.transform(table), spec, base + "/trees", "k").collect()
    assert len(parts) == len(p)
    for r in parts:
        assert abs(r.margin - p[r.k][0]) < 1e-9 and abs(r.bias + sum(r.contributions) - p[r.k][0]) < 1e-9
    MD.save_model(m, spec, base + "/saved")
    loaded = PipelineModel.load(base + "/saved/model")
    assert _scores(loaded, table) == p


def test_a_forest_needs_whole_labels_and_one_class_is_a_leaf(monkeypatch, spark, table, spec):
    _large(monkeypatch)
    m = MD.fit_model(table.withColumn("y", F.lit(0.0)), spec, "random_forest", label="y", numTrees=3)
    assert m.stages[-1].totalNumNodes == 3 and not m.stages[-1].importances.any()
    assert set(_scores(m, table).values()) == {(0.0, 0.0)}
    assert m.transform(table.limit(0)).count() == 0
    for bad in ("null", "0.5D", "-1.0D"):
        with pytest.raises(ValueError):
            MD.fit_model(table.withColumn("y", F.expr(f"if(k = 3, {bad}, y)")), spec, "random_forest", label="y", numTrees=3)


def test_cuts_come_from_all_rows(spark):
    rows = spark.range(50_000).selectExpr("array(double(id % 20), double(id), double(int(id = 77))) as x", "0D as y", "if(id < 25000, 1D, 3D) as w").repartition(4)
    few, many, rare = FO.find_cuts(rows, 3)
    assert few == [i + 0.5 for i in range(19)] and rare == [0.5] and len(many) == FO.BINS - 1
    weight = [c if c < 25_000 else 25_000 + 3 * (c - 25_000) for c in many]
    assert np.allclose(np.diff([0, *weight, 100_000]) / (100_000 / FO.BINS), 1, atol=0.1)


def test_families_share_features_and_equal_fits_of_their_own(monkeypatch, table):
    from tabulon.plans.training import train_all
    fits, fit = [], MD.StandardScaler._fit
    monkeypatch.setattr(MD.StandardScaler, "_fit", lambda self, d: fits.append(1) or fit(self, d))
    few = {"random_forest": {"numTrees": 3, "maxDepth": 4}, "bagging": {"numTrees": 2, "maxDepth": 4}}
    t = train_all(table.drop("class_weight"), "y", "k", ["x", "z"], ["c"], families=("logistic_regression", "random_forest", "bagging"), params=few)
    assert len(fits) == 1 and list(t.models) == ["logistic_regression", "random_forest", "bagging"]
    got = {(r.model, r.k): r.score for r in t.predictions.collect()}
    assert len(got) == 3 * t.test.count()
    for fam in t.models:
        alone = MD.fit_model(t.train, t.spec, fam, label="y", key="k", **few.get(fam, {}))
        assert all(abs(got[fam, k] - p) < 1e-9 for k, (p, _) in _scores(alone, t.test).items())


def test_a_training_table_has_no_last_partitions_to_wait_for(spark):
    cores = spark.sparkContext.defaultParallelism
    odd = spark.range(cores * MD.ROWS_PER_CORE).repartition(cores + 1)
    assert MD.settled_over_cores(odd, even=True).rdd.getNumPartitions() == cores
    assert MD.settled_over_cores(odd).rdd.getNumPartitions() == cores + 1
