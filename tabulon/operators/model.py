"""Feature pipeline, classifiers, tuning, importance and contributions
(FEA1-4, JON4, MDL1-8, EXP1, SCO1, SNK5, SRC5).

Everything is Spark ML: the fitted fill values (exact medians / modes,
computed distributed) become a ``SQLTransformer`` stage, so the imputation
statistics travel with the saved ``PipelineModel`` (no refit on upload).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Sequence

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (OneHotEncoder, PolynomialExpansion, SQLTransformer, StandardScaler, StringIndexer,
                                VarianceThresholdSelector, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import config as C
from tabulon.functions.scalar import log_grid
from tabulon.operators import clean, forest
from tabulon.operators.ordered import materialize
from tabulon.operators.sample import hash_split

MODEL_FAMILIES = ("logistic_regression", "random_forest", "gradient_boosting", "linear_svc", "bagging")


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


#: rows of a training table for which one more core is taken
ROWS_PER_CORE = 10_000


def settled_over_cores(df: DataFrame, even: bool = False) -> DataFrame:
    """``materialize``, dealt over the cores: a shuffle packs partitions by bytes, and
    the few megabytes of a training table would be fitted by a core or two.  ``even``:
    also if there are a few more partitions than cores, as the last of them would be
    waited for in each of a fit's many passes."""
    d = materialize(df)
    n, parts = min(d.sparkSession.sparkContext.defaultParallelism, -(-d.count() // ROWS_PER_CORE)), d.rdd.getNumPartitions()
    return materialize(d.repartition(n)) if parts < n or even and n > 1 and parts < 4 * n and parts % n else d


def balanced_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """JON4: weight n / (k · n_class) attached by a broadcast join of the
    class counts (k rows: bounded by the number of classes)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k")).withColumn("_j", F.lit(0))
    w = (counts.withColumn("_j", F.lit(0)).join(tot, "_j")
         .select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(name)))
    return df.join(F.broadcast(w), label)


def fill_stage(values: dict, columns: Sequence[str], suffix: str = "__filled") -> SQLTransformer:
    """A fitted-imputer stage: coalesce each column with its fitted value."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(float(v))
    exprs = ", ".join(f"coalesce({_q(c)}, {lit(values[c])}) AS {_q(c + suffix)}"
                      for c in columns if c in values)
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


@dataclass
class FeatureSpec:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    fill_values: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)

    @property
    def encoded_names(self) -> list[str]:
        names = [f"num__{c}" for c in self.numeric]
        for c in self.categorical:
            names += [f"cat__{c}_{v}" for v in self.categories.get(c, [])]
        return names


def fit_feature_spec(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> FeatureSpec:
    """Fit the imputation statistics (exact median / mode) and category lists."""
    values = {}
    values.update(clean.median_fill_values(train, list(numeric)))
    values.update(clean.mode_fill_values(train, list(categorical)))
    cats = {}
    if categorical:
        from tabulon.operators.profile import distinct_values
        rows = distinct_values(train.select(*categorical), list(categorical)).limit(C.MAX_CATEGORIES + 1).collect()
        if len(rows) > C.MAX_CATEGORIES:
            raise ValueError(f"more than {C.MAX_CATEGORIES} category values in {list(categorical)}: "
                             "name fewer columns as categorical (identifiers and free text are not)")
        for r in rows:
            if r["value"] is not None:
                cats.setdefault(r["column_name"], []).append(r["value"])
        # a column without any value is filled, so the fill value is its only category
        cats = {c: sorted(cats.get(c) or [values[c]]) for c in categorical if cats.get(c) or c in values}
    return FeatureSpec(tuple(numeric), tuple(categorical), values, cats)


def feature_stages(spec: FeatureSpec, features_col: str = "features") -> list:
    """FEA1 + FEA2: fitted fill → assemble → standard scale (numbers);
    fitted fill → index (alphabetical, unknown kept) → one-hot with the
    unknown slot dropped, so unknown / null categories encode as all zeros."""
    stages = []
    filled = [c + "__filled" for c in spec.numeric]
    cat_filled = [c + "__filled" for c in spec.categorical]
    stages.append(fill_stage(spec.fill_values, list(spec.numeric) + list(spec.categorical)))
    parts = []
    if spec.numeric:
        stages.append(VectorAssembler(inputCols=filled, outputCol="_num_vec", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="_num_vec", outputCol="_num_scaled", withMean=True, withStd=True))
        parts.append("_num_scaled")
    if spec.categorical:
        idx = [c + "__idx" for c in spec.categorical]
        ohe = [c + "__ohe" for c in spec.categorical]
        stages.append(StringIndexer(inputCols=cat_filled, outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
        parts += ohe
    stages.append(VectorAssembler(inputCols=parts, outputCol=features_col))
    return stages


#: Parameters that a caller may set, by family, with the studied models' settings.
CLASSIFIER_DEFAULTS = {
    # max 1000 iterations and tolerance 1e-4, the studied model's settings
    "logistic_regression": {"maxIter": 1000, "tol": 1e-4, "regParam": 0.0},
    "random_forest": {"numTrees": 100, "maxDepth": 30, "minInstancesPerNode": 1},
    "gradient_boosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},
    "linear_svc": {"regParam": 0.0, "maxIter": 100},
    "bagging": {"numTrees": 10, "subsamplingRate": 1.0, "maxDepth": 30},
}


def classifier(family: str, label: str = "label", weight: str | None = "class_weight",
               seed: int = C.RANDOM_SEED, **params):
    """MDL1-5 (MDL4 returns the SVM; calibration is added by ``fit_model``).
    A parameter that the family does not offer is an error.  Forests keep each row's
    node: else every pass sends all trees to every task and walks them again."""
    if family not in CLASSIFIER_DEFAULTS:
        raise ValueError(family)
    unknown = set(params) - set(CLASSIFIER_DEFAULTS[family])
    if unknown:
        raise ValueError(f"{family} has no parameter {sorted(unknown)}")
    p = CLASSIFIER_DEFAULTS[family] | params
    if family == "logistic_regression":
        return LogisticRegression(labelCol=label, weightCol=weight, elasticNetParam=0.0, **p)
    if family == "random_forest":
        return RandomForestClassifier(labelCol=label, weightCol=weight, seed=seed, cacheNodeIds=True, **p)
    if family == "gradient_boosting":
        return GBTClassifier(labelCol=label, seed=seed, **p)
    if family == "linear_svc":
        return LinearSVC(labelCol=label, weightCol=weight, predictionCol="svm_prediction", rawPredictionCol="svm_raw", **p)
    return RandomForestClassifier(labelCol=label, seed=seed, featureSubsetStrategy="all", bootstrap=True, cacheNodeIds=True, **p)


#: nodes of a forest, at most, that Spark ML may grow and keep in the driver
DRIVER_NODES = 2_000_000


def forest_nodes(family: str, n_rows: int, params: dict) -> int:
    """How many nodes a forest over ``n_rows`` rows can have: a leaf needs a row."""
    p = CLASSIFIER_DEFAULTS[family] | params
    return p["numTrees"] * min(2 << p["maxDepth"], 2 * n_rows)


def _fit_forest(rows: DataFrame, est: RandomForestClassifier) -> forest.ForestModel:
    return forest.fit_forest(rows, est.getLabelCol(), est.getWeightCol() if est.isSet("weightCol") else None, forest.forest_path(rows.sparkSession), est.getNumTrees(),
                             est.getMaxDepth(), "all" if est.getFeatureSubsetStrategy() == "all" else "sqrt", est.getMinInstancesPerNode(), est.getSubsamplingRate(), est.getSeed())


def _platt_stages(label: str) -> tuple[list, LogisticRegression]:
    margin = VectorSlicer(inputCol="svm_raw", outputCol="svm_margin_vec", indices=[1])
    lr = LogisticRegression(labelCol=label, featuresCol="svm_margin_vec", maxIter=100)
    return [margin], lr


def fit_features(train: DataFrame, spec: FeatureSpec) -> PipelineModel:
    return Pipeline(stages=feature_stages(spec)).fit(train)


def fit_model(train: DataFrame, spec: FeatureSpec, family: str, label: str = "label",
              weight: str | None = "class_weight", key: str | None = None, features: PipelineModel | None = None, **params) -> PipelineModel:
    """Fit features + classifier as one ``PipelineModel``.

    For the linear SVM a logistic calibration (Platt 1999) on the margin is
    fitted on a held-back 20 % of the training rows the SVM did not see.  A forest
    that may have more than ``DRIVER_NODES`` nodes is a ``forest.ForestModel``.
    ``features``: ``fit_features`` of the same table, for families that share them;
    the SVM fits its own, on fewer rows.
    """
    w = weight if family not in ("gradient_boosting", "bagging") else None
    est = classifier(family, label, w, **params)
    if family != "linear_svc":
        features = features or fit_features(train, spec)
        rows = features.transform(train)
        large = family in ("random_forest", "bagging") and forest_nodes(family, train.count(), params) > DRIVER_NODES
        return PipelineModel(stages=features.stages + [_fit_forest(rows, est) if large else est.fit(rows)])
    key = key or next(c for c in train.columns if c not in (label, weight))
    parts = hash_split(train, key, test_pct=20)
    fit_part = parts.where(F.col("split") == "train").drop("split")
    cal_part = parts.where(F.col("split") == "test").drop("split")
    base = Pipeline(stages=feature_stages(spec) + [est]).fit(fit_part)
    pre, lr = _platt_stages(label)
    cal_in = PipelineModel(stages=base.stages + pre).transform(cal_part)
    cal = lr.fit(cal_in)
    return PipelineModel(stages=base.stages + pre + [cal])


def grid_for(family: str, n_rows: int) -> dict:
    """MDL7 grids per family (Spark parameter names).  ``regParam`` = 1/(C·n)
    for C in 10^-2..10^2; depth "none" is Spark's limit 30; minimum split size
    maps to ``minInstancesPerNode`` (closest, not equal)."""
    cs = log_grid()
    if family == "logistic_regression":
        return {"regParam": [1.0 / (c * n_rows) for c in cs]}
    if family == "linear_svc":
        return {"regParam": [1.0 / (c * n_rows) for c in cs]}
    if family == "random_forest":
        return {"numTrees": [100, 200], "maxDepth": [30, 10], "minInstancesPerNode": [1, 5]}
    if family == "gradient_boosting":
        return {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 5]}
    if family == "bagging":
        return {"numTrees": [10, 20], "subsamplingRate": [0.5, 1.0]}
    raise ValueError(family)


def positive_probability(pred: DataFrame, name: str = "churn_probability") -> DataFrame:
    return pred.withColumn(name, vector_to_array(F.col("probability"))[1])


def cross_validate(train_with_folds: DataFrame, spec: FeatureSpec, family: str, grid: dict,
                   label: str = "label", weight: str | None = "class_weight", fold_col: str = "fold",
                   num_folds: int = C.CV_FOLDS, parallelism: int = 2):
    """MDL7: grid search with ROC AUC over stratified folds given as a column, as
    ``CrossValidator(foldCol=...)`` runs it.

    Returns (best PipelineModel, [(params, mean auc)]).  The linear SVM's best
    model has margins only; ``training.tune_best`` refits it with calibration."""
    w = weight if family not in ("gradient_boosting", "bagging") else None
    est = classifier(family, label, w)
    b = ParamGridBuilder()
    for pname, values in grid.items():
        b = b.addGrid(est.getParam(pname), values)
    maps = b.build()
    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC",
                                       rawPredictionCol="svm_raw" if family == "linear_svc" else "rawPrediction")
    if not train_with_folds.where(~F.coalesce(F.col(fold_col).between(0, num_folds - 1), F.lit(False))).isEmpty():
        raise ValueError(f"a fold is not in 0..{num_folds - 1}")
    read = [c for c in (label, w, "features") if c]
    totals = [0.0] * len(maps)
    for fold in range(num_folds):
        # the feature stages know no grid parameter: fitted once a fold, and their vectors read by every point
        rest, held = train_with_folds.where(F.col(fold_col) != fold), train_with_folds.where(F.col(fold_col) == fold)
        features = Pipeline(stages=feature_stages(spec)).fit(rest)
        rest, held = (features.transform(d).select(*read).persist(StorageLevel.MEMORY_AND_DISK) for d in (rest, held))
        if rest.isEmpty() or held.isEmpty():
            raise ValueError(f"fold {fold}: no rows to train on or none held out")
        with ThreadPool(min(parallelism, len(maps))) as pool:
            aucs = pool.map(inheritable_thread_target(train_with_folds.sparkSession)(lambda pm: ev.evaluate(est.fit(rest, pm).transform(held))), maps)
        totals = [t + float(a) for t, a in zip(totals, aucs)]
        rest.unpersist()
        held.unpersist()
    means = [t / num_folds for t in totals]
    scores = [({p.name: v for p, v in pm.items()}, m) for pm, m in zip(maps, means)]
    best = maps[means.index(max(means))]
    return Pipeline(stages=feature_stages(spec) + [est]).fit(train_with_folds, best), scores


def feature_importance(model: PipelineModel, spec: FeatureSpec, spark) -> DataFrame:
    """MDL8: importance per encoded feature (tree importances, or |coefficient|
    for linear models), named after the encoded columns."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    elif hasattr(last, "coefficients") and last.numFeatures == len(spec.encoded_names):
        vals = [abs(x) for x in last.coefficients.toArray().tolist()]
    else:
        base = [s for s in model.stages if hasattr(s, "coefficients")][0]
        vals = [abs(x) for x in base.coefficients.toArray().tolist()]
    names = spec.encoded_names
    rows = list(zip(names, [float(v) for v in vals], strict=True))  # bounded by the feature count; never cut
    return spark.createDataFrame(rows, "feature string, importance double")


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    """ORD4: top-k features by importance (ties by name)."""
    return importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def linear_contributions(model: PipelineModel, scored: DataFrame, spec: FeatureSpec,
                         features_col: str = "features", key: str | None = None) -> DataFrame:
    """EXP1 for linear models: contribution_j = coef_j · (x_j - mean_j), exact
    for a linear margin with independent features (Lundberg & Lee 2017).

    Column maths over the feature vectors; the coefficient and mean vectors
    are literals bounded by the feature count.  Returns (key?, feature,
    contribution) rows and is summarised by ``mean_abs_contribution``."""
    lr = model.stages[-1]
    coef = lr.coefficients.toArray().tolist()
    arr = vector_to_array(F.col(features_col))
    means = scored.select(arr.alias("_a")).select(
        *[F.avg(F.col("_a")[i]).alias(f"m{i}") for i in range(len(coef))]).first()
    mean = [float(means[f"m{i}"] or 0.0) for i in range(len(coef))]
    coef_c = F.array(*[F.lit(float(c)) for c in coef])
    mean_c = F.array(*[F.lit(m) for m in mean])
    if len(spec.encoded_names) != len(coef):
        raise ValueError(f"{len(coef)} coefficients for {len(spec.encoded_names)} encoded columns")
    names = F.array(*[F.lit(n) for n in spec.encoded_names])
    contrib = F.transform(F.arrays_zip(arr.alias("x"), coef_c.alias("c"), mean_c.alias("m"), names.alias("n")),
                          lambda s: F.struct(s["n"].alias("feature"),
                                             (s["c"] * (s["x"] - s["m"])).alias("contribution")))
    cols = [key] if key else []
    return scored.select(*cols, F.inline(contrib))


def mean_abs_contribution(contrib: DataFrame, k: int = 20) -> DataFrame:
    """EXP1 summary: top-k features by mean absolute contribution."""
    agg = contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    return agg.orderBy(F.col("mean_abs_contribution").desc(), "feature").limit(k)


def permutation_importance(model: PipelineModel, test: DataFrame, columns: Sequence[str], key: str,
                           label: str = "label", seed: int = C.RANDOM_SEED) -> DataFrame:
    """EXP1 for trees: drop in ROC AUC when one input column is permuted
    (Breiman 2001).  The permutation pairs each row with the row of the same
    rank in a seeded hash order - two distributed rankings and an equi-join."""
    from tabulon.operators.quality import roc_auc
    from tabulon.operators.sample import global_row_number
    spark = test.sparkSession

    def auc(df):
        p = positive_probability(model.transform(df))
        return p.select(F.col(label).alias("label"), F.col("churn_probability").alias("score"))

    base = roc_auc(auc(test)).select(F.col("roc_auc").alias("base_auc"))
    keyed = global_row_number(test.withColumn("_o1", F.xxhash64(F.col(key), F.lit(seed)).cast("double")),
                              "_o1", tiebreak=[key])
    out = []
    for c in columns:
        donor = global_row_number(
            test.select(key, c).withColumn("_o2", F.xxhash64(F.col(key), F.lit(seed + 1)).cast("double")),
            "_o2", tiebreak=[key]).select("row_number", F.col(c).alias("_perm"))
        shuffled = keyed.join(donor, "row_number").drop(c, "row_number", "_o1").withColumnRenamed("_perm", c)
        a = roc_auc(auc(shuffled)).select(F.lit(c).alias("feature"), F.col("roc_auc").alias("perm_auc"))
        out.append(a)
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return (res.withColumn("_k", F.lit(0)).join(base.withColumn("_k", F.lit(0)), "_k")
            .select("feature", (F.col("base_auc") - F.col("perm_auc")).alias("importance")))


# --- per-row contributions of tree models ---------------------------------------------

def tree_nodes(model, path: str) -> list[dict]:
    """The node table of a fitted tree ensemble, from its saved form below ``path``:
    one row per node with its value (share of the positive class, or the
    regression value).  As large as the model, which scoring holds in every task."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(path)
    d = spark.read.parquet(path + "/data")
    n = "nodeData." if "nodeData" in d.columns else ""
    stats = F.col(n + "impurityStats")
    share = F.try_divide(stats[1], F.aggregate(stats, F.lit(0.0), lambda a, x: a + x))
    value = F.col(n + "prediction") if isinstance(model, GBTClassificationModel) else share
    return [r.asDict() for r in d.select(
        F.col("treeID").alias("tree"), F.col(n + "id").alias("id"), value.alias("value"), F.col(n + "leftChild").alias("left"),
        F.col(n + "rightChild").alias("right"), F.col(n + "split.featureIndex").alias("feature"),
        F.col(n + "split.leftCategoriesOrThreshold").alias("cut"), F.col(n + "split.numCategories").alias("categories")).collect()]


class _Trees:
    """Node tables as arrays; a batch of rows walks all trees level by level."""

    def __init__(self, nodes: list[dict], weights: list[float]):
        import numpy as np
        self.weights, self.trees = weights, []
        for t in range(len(weights)):
            rows = sorted((r for r in nodes if r["tree"] == t), key=lambda r: r["id"])
            at = {r["id"]: i for i, r in enumerate(rows)}
            child = lambda k: np.array([at.get(r[k], -1) for r in rows])
            cont = np.array([r["categories"] is None or r["categories"] < 0 for r in rows])
            cut = np.array([r["cut"][0] if c and r["cut"] else 0.0 for r, c in zip(rows, cont)])
            sets = {i: np.array(r["cut"]) for i, (r, c) in enumerate(zip(rows, cont)) if not c and r["left"] >= 0}
            self.trees.append((child("left"), child("right"), np.array([r["feature"] if r["feature"] is not None else -1 for r in rows]),
                               cut, cont, sets, np.array([r["value"] for r in rows])))

    def walk(self, x):
        """(bias, contributions) of rows ``x``: the value of the roots, and per
        feature the changes of value at its splits on the row's paths."""
        import numpy as np
        total, out = 0.0, np.zeros(x.shape)
        every = np.arange(len(x))
        for w, (left, right, feature, cut, cont, sets, value) in zip(self.weights, self.trees):
            total += w * value[0]
            node, rows = np.zeros(len(x), np.int64), every if left[0] >= 0 else every[:0]
            while len(rows):
                here = node[rows]
                f = feature[here]
                v = x[rows, f]
                low = v <= cut[here]
                for i in set(here[~cont[here]].tolist()):
                    low = np.where(here == i, np.isin(v, sets[i]), low)
                after = np.where(low, left[here], right[here])
                np.add.at(out, (rows, f), w * (value[after] - value[here]))
                node[rows] = after
                rows = rows[left[after] >= 0]
        return total, out


def tree_contributions(model: PipelineModel, scored: DataFrame, spec: FeatureSpec, path: str, key: str,
                       features_col: str = "features") -> DataFrame:
    """EXP1 for tree models: ``key``, margin and (per encoded feature, in
    ``spec.encoded_names`` order) contributions of every scored row.

    At each split on a row's path the change of the node's value is given to the
    split feature; with the bias, the value of the roots, the contributions add up to
    the margin exactly: the probability of a forest, half the log-odds of boosted
    trees.  (Path attributions; exact SHAP values are not built.)  ``path`` is a
    folder for the model's node table."""
    import numpy as np
    import pyarrow as pa
    last = model.stages[-1]
    if isinstance(last, forest.ForestModel):
        return last.contributions(scored, key, features_col)
    boosted = isinstance(last, GBTClassificationModel)
    n = last.getNumTrees
    weights = [float(w) for w in last.treeWeights] if boosted else [1.0 / n] * n
    trees = _Trees(tree_nodes(last, path), weights)
    width = len(spec.encoded_names)
    src = scored.select(F.col(key), vector_to_array(F.col(features_col)).alias("x"))
    schema = src.select(key).schema.add("bias", "double").add("margin", "double").add("contributions", T.ArrayType(T.DoubleType()))

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            assert x.shape[1] == width or not b.num_rows, "the vector is not of the encoded columns"
            bias, parts = trees.walk(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, bias)), pa.array(bias + parts.sum(axis=1)),
                                              pa.array(list(parts), pa.list_(pa.float64()))], names=[key, "bias", "margin", "contributions"])
    return src.mapInArrow(run, schema)


def named_contributions(contributions: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(key..., feature, contribution) rows of ``tree_contributions``."""
    names = F.array(*[F.lit(n) for n in spec.encoded_names])
    rows = F.arrays_zip(names.alias("feature"), F.col("contributions").alias("contribution"))
    keys = [c for c in contributions.columns if c not in ("bias", "margin", "contributions")]
    return contributions.select(*keys, F.inline(rows))


# --- values seen at training -----------------------------------------------------------

#: bits per value and hash functions of the sketch (about 1 % let through), and its largest size
BLOOM_BITS, BLOOM_HASHES, BLOOM_MOST = 10, 7, 64 * 1024 * 1024


def _bloom_places(value, bits: int):
    """(word, bit) of a text for each hash function, by double hashing."""
    h1, h2 = F.xxhash64(value), F.xxhash64(value, F.lit("second"))
    place = lambda i: F.pmod(h1 + F.lit(i) * F.shiftrightunsigned(h2, 32), F.lit(bits))
    return [place(i) for i in range(BLOOM_HASHES)]


def save_seen_values(values: DataFrame, path: str) -> None:
    """VAL3: the (column_name, value) lists of training beside the model, exact as a
    table and as one Bloom sketch over all columns, of a size given by their number.
    Lists too long for a sketch of ``BLOOM_MOST`` bits are kept as a table only."""
    rows = values.select("column_name", F.col("value").cast("string").alias("value")).where("value is not null").distinct()
    rows.write.mode("overwrite").parquet(path + "/seen/values")
    spark = values.sparkSession
    bits = 64 * max(16, -(-BLOOM_BITS * spark.read.parquet(path + "/seen/values").count() // 64))
    stored = spark.read.parquet(path + "/seen/values")
    if bits > BLOOM_MOST:
        sketch = spark.createDataFrame([], "bits long, word long, mask long")
    else:
        place = F.explode(F.array(*_bloom_places(F.concat_ws("=", "column_name", "value"), bits))).alias("at")
        sketch = stored.select(place).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("mask")).select(F.lit(bits).cast("long").alias("bits"), "word", "mask")
    sketch.coalesce(1).write.mode("overwrite").parquet(path + "/seen/sketch")


def unseen_categories(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """VAL3 / JON5: (column_name, value, n): values of the checked columns that
    training had not seen, and in how many rows they are.

    The table's distinct values are counted once.  What the sketch does not know is
    unseen for certain; only what it lets through meets the exact lists."""
    from tabulon.operators.counts import TEXT, value_counts
    spark = df.sparkSession
    stored = spark.read.parquet(path + "/seen/values")
    if columns is None:
        columns = [c for c in df.columns if not stored.where(F.col("column_name") == c).isEmpty()]
    have = value_counts(df, categorical=columns).where((F.col("kind") == TEXT) & F.col("txt").isNotNull()).select(
        "column_name", F.col("txt").alias("value"), "n")
    words = spark.read.parquet(path + "/seen/sketch")
    first = words.first()
    if first is None:                                             # lists too long for a sketch
        return have.join(stored, ["column_name", "value"], "left_anti")
    bits = first["bits"]
    dense = spark.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    masks = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))),
                                  lambda x: x["mask"]).alias("masks"))              # one row of at most BLOOM_MOST bits
    asked = have.crossJoin(F.broadcast(masks))
    known = F.lit(True)
    for at in _bloom_places(F.concat_ws("=", "column_name", "value"), bits):
        mask = F.get("masks", F.floor(at / 64).cast("int"))
        known = known & (F.call_function("shiftrightunsigned", mask, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    asked = asked.withColumn("known", known).drop("masks")
    maybe = asked.where("known").join(stored, ["column_name", "value"], "left_anti")
    return asked.where("not known").unionByName(maybe).drop("known")


# --- optional features -------------------------------------------------------------------

def optional_features(df: DataFrame, numeric: Sequence[str], degree: int = 2, threshold: float = C.FEATURE_SELECTION_THRESHOLD,
                      output: str = "optional_features") -> PipelineModel:
    """FEA4 (off by default): the products of the numeric columns up to ``degree``
    (interactions and powers) and the selection of those whose variance exceeds
    ``threshold``, as a fitted pipeline; nulls count as 0."""
    zeros = ", ".join(f"coalesce(cast({_q(c)} as double), 0.0) AS {_q(c + '__zero')}" for c in numeric)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {zeros} FROM __THIS__"),
        VectorAssembler(inputCols=[c + "__zero" for c in numeric], outputCol="_optional"),
        PolynomialExpansion(degree=degree, inputCol="_optional", outputCol="_expanded"),
        VarianceThresholdSelector(varianceThreshold=threshold, featuresCol="_expanded", outputCol=output)]).fit(df)


def save_model(model: PipelineModel, spec: FeatureSpec, path: str, metrics: dict | None = None,
               best_params: dict | None = None) -> None:
    """SNK5: the PipelineModel directory plus a one-row metadata JSON."""
    model.write().overwrite().save(path + "/model")
    meta = {"numeric": list(spec.numeric), "categorical": list(spec.categorical),
            "fill_values": spec.fill_values, "categories": spec.categories,
            "feature_names": spec.encoded_names, "metrics": metrics or {}, "best_params": best_params or {}}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(path + "/metadata")
    if spec.categories:
        lists = [(c, v) for c, values in spec.categories.items() for v in values]
        save_seen_values(spark.createDataFrame(lists, "column_name string, value string"), path)


def load_model(path: str, spark):
    """SRC5: (PipelineModel, FeatureSpec, metadata dict)."""
    model = PipelineModel.load(path + "/model")
    meta = json.loads(spark.read.text(path + "/metadata").first()[0])
    spec = FeatureSpec(tuple(meta["numeric"]), tuple(meta["categorical"]), meta["fill_values"], meta["categories"])
    return model, spec, meta
