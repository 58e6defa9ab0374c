"""Classification quality on (label, prediction, score) columns (AGG7-12, EVL1).

``score_table`` reads the scored rows once: (group, score, prediction, n, pos, neg),
settled.  Counts and metrics are sums of it; everything that needs an order over
scores (ROC AUC, average precision, curve points) comes from one ascending running
sum of its per-score counts, sums from the top being totals less it.
An optional ``group`` (e.g. ``model``) computes all models in one pass; groups are
counted before anything of their number is broadcast.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.operators.ordered import materialize, running_sums


def _div(a: Column, b: Column) -> Column:
    """a / b with 0 on an empty denominator (ANSI mode raises on 1/0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_prediction(df: DataFrame, score: str = "score", cut: float = C.LABEL_CUT,
                    name: str = "prediction") -> DataFrame:
    return df.withColumn(name, (F.col(score) >= F.lit(cut)).cast("int"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     group: Sequence[str] = ()) -> DataFrame:
    """AGG7: (label, prediction, n) on the full class grid, zeros included.

    The grid comes from the set of classes (bounded by the number of classes),
    exploded twice from one row - no join of the table with itself."""
    g = list(group)
    counts = df.groupBy(*g, F.col(label).alias("label"),
                        F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.groupBy(*g).agg(
        F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("prediction"))).alias("_cls"))
    grid = (classes.select(*g, F.explode("_cls").alias("label"), "_cls")
            .select(*g, "label", F.explode("_cls").alias("prediction")))
    return grid.join(counts, g + ["label", "prediction"], "left").select(
        *g, "label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def binary_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                  group: Sequence[str] = (), positive: int = 1) -> DataFrame:
    y = F.col(label) == positive
    p = F.col(prediction) == positive
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   group: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """AGG8: accuracy, precision, recall, F1, balanced accuracy (0 on empty denominators)."""
    return metrics_of_counts(binary_counts(df, label, prediction, group, positive), group)


def metrics_of_counts(c: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    specificity = _div(tn, tn + fp)
    return c.select(
        *group, "n", "tp", "fp", "tn", "fn",
        _div(tp + tn, F.col("n")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / 2).alias("balanced_accuracy"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 group: Sequence[str] = ()) -> DataFrame:
    """AGG9: per class precision, recall, F1, support; the accuracy row (in the
    F1 column, as the usual report prints it); macro and weighted averages.
    Built from the (tiny) confusion matrix."""
    g = list(group)
    cm = confusion_matrix(df, label, prediction, g)
    as_true = cm.groupBy(*g, F.col("label").alias("cls")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    as_pred = cm.groupBy(*g, F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = as_true.join(as_pred, g + ["cls"])
    p = _div(F.col("tp"), F.col("predicted"))
    r = _div(F.col("tp"), F.col("support"))
    per = per.select(*g, F.col("cls").cast("string").alias("class"), "support",
                     p.alias("precision"), r.alias("recall"),
                     _div(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))
    avg = per.groupBy(*g).agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        _div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("w_p"),
        _div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("w_r"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("w_f"),
        F.sum("support").alias("support"))
    macro = avg.select(*g, F.lit("macro avg").alias("class"), "support",
                       F.col("m_p").alias("precision"), F.col("m_r").alias("recall"),
                       F.col("m_f").alias("f1"))
    weighted = avg.select(*g, F.lit("weighted avg").alias("class"), "support",
                          F.col("w_p").alias("precision"), F.col("w_r").alias("recall"),
                          F.col("w_f").alias("f1"))
    acc = cm.groupBy(*g).agg(F.sum("n").alias("support"),
                             F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
                             .alias("_hit"))
    accuracy = acc.select(*g, F.lit("accuracy").alias("class"), "support",
                          F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                          _div(F.col("_hit"), F.col("support")).alias("f1"))
    return per.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def score_table(df: DataFrame, label: str = "label", score: str = "score", prediction: str | None = None,
                group: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """(group, score, prediction, n, pos, neg), settled: one row per distinct score
    and prediction (map-side combined); the only read of the scored rows."""
    y = F.col(label) == positive
    p = (F.col(prediction) == positive) if prediction else F.lit(None).cast("boolean")
    return materialize(df.groupBy(*group, F.col(score).cast("double").alias("score"), p.alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))


def _running(table: DataFrame, g: list[str]) -> DataFrame:
    """Per distinct score pos and neg, their ascending running sums and totals P, N."""
    sc = table.where(F.col("score").isNotNull()).groupBy(*g, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    run = running_sums(sc, "score", ["pos", "neg"], g, groups_bounded=None if g else True, with_totals=True)
    return run.withColumnRenamed("pos_total", "P").withColumnRenamed("neg_total", "N")


def ranking_of(table: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AGG10 + AGG11 of a ``score_table`` in one scan: roc_auc, its status, average_precision.

    AUC = Σ_s pos(s)·(neg below s + neg(s)/2) / (P·N), null with ``status =
    'one_class'`` when either class is missing; average precision is the step sum
    Σ Δrecall · precision over descending thresholds, null without positives."""
    g = list(group)
    run = _running(table, g)
    top_pos, top_neg = F.col("P") - F.col("pos_run") + F.col("pos"), F.col("N") - F.col("neg_run") + F.col("neg")
    agg = run.groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("neg_run") - F.col("neg") / 2.0)).alias("c"),
        F.sum(_div(F.col("pos"), F.col("P")) * _div(top_pos, top_pos + top_neg)).alias("ap"),
        F.first("P").alias("P"), F.first("N").alias("N"))
    none = F.lit(None).cast("double")
    one_class = F.coalesce((F.col("P") == 0) | (F.col("N") == 0), F.lit(True))
    return agg.select(
        *g, F.when(one_class, none).otherwise(F.col("c") / (F.col("P").cast("double") * F.col("N"))).alias("roc_auc"),
        F.when(one_class, F.lit("one_class")).otherwise(F.lit("ok")).alias("status"),
        F.when(F.col("P") > 0, F.col("ap")).alias("average_precision"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            group: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """AGG10: exact ROC AUC in rank form with half credit for ties."""
    return ranking_of(score_table(df, label, score, None, group, positive), group).drop("average_precision")


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      group: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """AGG11: step-sum average precision Σ Δrecall · precision over thresholds."""
    return ranking_of(score_table(df, label, score, None, group, positive), group).select(*group, "average_precision")


def curve_points(df: DataFrame, label: str = "label", score: str = "score",
                 group: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """AGG12 / WIN4: per distinct threshold (descending) the cumulative TP/FP,
    ROC point (fpr, tpr) and PR point (precision, recall), plus the anchor row
    (null threshold) where both curves start."""
    g = list(group)
    table = score_table(df, label, score, None, g, positive)
    run = _running(table, g)
    run = run.withColumns({"_tp": F.col("P") - F.col("pos_run") + F.col("pos"), "_fp": F.col("N") - F.col("neg_run") + F.col("neg")})
    pts = run.select(
        *g, F.col("score").alias("threshold"), F.col("_tp").alias("tp"), F.col("_fp").alias("fp"),
        _div(F.col("_fp"), F.col("N")).alias("fpr"), _div(F.col("_tp"), F.col("P")).alias("tpr"),
        _div(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision"), _div(F.col("_tp"), F.col("P")).alias("recall"))
    # the curves' anchor (threshold above every score): ROC (0, 0), PR (recall 0, precision 1)
    keys = table.select(*g).distinct() if g else df.sparkSession.range(1).select()
    anchor = keys.select(*g, F.lit(None).cast("double").alias("threshold"),
                         F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"),
                         F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(anchor)


def evaluation_of(table: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AGG8 + AGG10 + AGG11 of a ``score_table``: one row per group."""
    g = list(group)
    of = lambda p, c: F.coalesce(F.sum(F.when(F.col("prediction") == p, F.col(c))), F.lit(0))
    c = table.groupBy(*g).agg(F.sum("n").alias("n"), of(True, "pos").alias("tp"), of(True, "neg").alias("fp"),
                              of(False, "neg").alias("tn"), of(False, "pos").alias("fn"))
    m, r = metrics_of_counts(c, g), ranking_of(table, g)
    return m.join(r, g, "left") if g else m.crossJoin(F.broadcast(r))                  # without groups: one row each


def evaluation_report(df: DataFrame, label: str = "label", score: str = "score",
                      prediction: str = "prediction", group: Sequence[str] = ()) -> DataFrame:
    """EVL1: one long table (group, metric, value) of the quality metrics."""
    wide = evaluation_of(score_table(df, label, score, prediction, group), group)
    g = list(group)
    names = ["accuracy", "precision", "recall", "f1", "balanced_accuracy", "roc_auc",
             "average_precision"]
    structs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
               for n in names]
    return wide.select(*g, F.inline(F.array(*structs)))


def evaluation_record(df: DataFrame, model_name: str, model_version: str, label: str = "label", score: str = "score",
                      prediction: str = "prediction", n_features: int | None = None) -> DataFrame:
    """EVL2: one nested row - model_info, metrics, data_info, class_distribution (the
    share of each class) - as ``sinks.write_report`` writes it; one read of the rows."""
    table = score_table(df, label, score, prediction)
    wide = evaluation_of(table)
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    share = lambda n: _div(n, F.col("n"))
    return wide.select(
        F.struct(F.lit(model_name).alias("name"), F.lit(model_version).alias("version"), F.lit(n_features).cast("int").alias("n_features")).alias("model_info"),
        F.struct("accuracy", "precision", "recall", "f1", "roc_auc").alias("metrics"),
        F.struct(F.col("n").alias("n_rows")).alias("data_info"),
        F.struct(pos.alias("n_positive"), neg.alias("n_negative"), share(pos).alias("positive_share"), share(neg).alias("negative_share")).alias("class_distribution"))
