"""Drift between a reference and a current table (DRF1-8, DEC1-2).

``pair_counts`` reads each table once: all columns of both, numbers and
categories, are tagged and counted in one shuffle on (column, value), and the
counts are settled.  Every score, the target's drift and the sample sizes are read
from them.  Empirical CDFs come from the distributed running sums in ``ordered``;
category shares from one aggregate.  Only per-column results (bounded by the
schema) are ever joined by broadcast.  Counts are multiplied as doubles.

What decides (our contract, see README) is named by ``DriftConfig.decide_by``, the
same at every size: ``distance`` (Wasserstein over the reference std, and
Jensen-Shannon; drift from 0.1 on) or ``p_value`` (KS and chi-square; drift below
0.05).  Dataset drift: share of drifted columns >= 0.5.
"""

from __future__ import annotations

import math
from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.config import DEFAULT_DRIFT, MIN_DRIFT_SAMPLES, DriftConfig
from tabulon.operators.counts import KEYS, NUMBER, TEXT
from tabulon.operators.ordered import materialize, running_sums


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def pair_counts(ref: DataFrame, cur: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """(kind, column_name, num, txt, a, b), settled: how often each value occurs in
    the reference (a) and in the current table (b); nulls and NaN count too, so
    the a of one column add up to the rows of the reference."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def side(df, a, b):
        entries = [F.struct(F.lit(NUMBER).alias("kind"), F.lit(c).alias("column_name"), F.nanvl(_q(c).cast("double"), none).alias("num"),
                            text.alias("txt")) for c in numeric]
        entries += [F.struct(F.lit(TEXT).alias("kind"), F.lit(c).alias("column_name"), none.alias("num"), _q(c).cast("string").alias("txt"))
                    for c in categorical]
        return df.select(F.inline(F.array(*entries))).select("*", F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = side(ref, 1, 0).unionByName(side(cur, 0, 1))
    return materialize(both.groupBy(*KEYS).agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


def sample_sizes(counts: DataFrame) -> DataFrame:
    """One row: reference_rows, current_rows of the tables behind ``pair_counts``."""
    per = counts.groupBy("kind", "column_name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per.agg(F.coalesce(F.max("a"), F.lit(0)).alias("reference_rows"), F.coalesce(F.max("b"), F.lit(0)).alias("current_rows"))


def ks_p_value(d: Column, n: Column, m: Column, terms: int = DEFAULT_DRIFT.ks_series_terms) -> Column:
    """Asymptotic two-sample Kolmogorov p-value:
    λ = (√ne + 0.12 + 0.11/√ne)·D, ne = n·m/(n+m), p = 2 Σ (-1)^(k-1) e^(-2k²λ²),
    p = 1 when λ < 0.2 (the cut-off series is not valid there)."""
    n, m = n.cast("double"), m.cast("double")            # a product of counts may not fit a long
    en = F.sqrt(F.try_divide(n * m, n + m))
    lam = (en + F.lit(0.12) + F.try_divide(F.lit(0.11), en)) * d
    # Σ_{k=1..terms} (-1)^(k-1) exp(-2 k² λ²), folded over a sequence: a small
    # expression (one per column result) instead of `terms` inlined terms
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.least(F.greatest(F.lit(2.0) * series, F.lit(0.0)), F.lit(1.0))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(p)


def ks_p_value_sql(d: str, n: str, m: str, terms: int = DEFAULT_DRIFT.ks_series_terms) -> str:
    lam = f"((sqrt({n} * {m} / ({n} + {m})) + 0.12 + 0.11 / sqrt({n} * {m} / ({n} + {m}))) * {d})"
    series = " + ".join(f"{(-1) ** (k - 1)} * exp({-2.0 * k * k} * {lam} * {lam})"
                        for k in range(1, terms + 1))
    return f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(greatest(2.0 * ({series}), 0.0), 1.0) END"


def numeric_drift(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DRF1 + DRF2 per numeric column: KS statistic and p-value, Wasserstein
    distance and its normalised form (over max(reference population std, 0.001))."""
    return numeric_drift_of(pair_counts(ref, cur, columns))


def segment_drift(ref: DataFrame, cur: DataFrame, value: str, segment: str) -> DataFrame:
    """The numeric drift of one column within every value of ``segment`` that
    either table holds (named ``<value>_<segment value>``)."""
    def side(df, a, b):
        return df.select(F.concat(F.lit(value + "_"), F.coalesce(F.col(segment).cast("string"), F.lit("null"))).alias("column_name"),
                         F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("num"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = side(ref, 1, 0).unionByName(side(cur, 0, 1))
    counts = materialize(both.groupBy("column_name", "num").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    return numeric_drift_of(counts.withColumn("kind", F.lit(NUMBER)), groups_bounded=None)


def numeric_drift_of(counts: DataFrame, groups_bounded: bool | None = True) -> DataFrame:
    """DRF1 + DRF2 of settled counts (kind, column_name, num, a, b)."""
    counts = counts.where((F.col("kind") == NUMBER) & F.col("num").isNotNull()).select("column_name", F.col("num").alias("value"), "a", "b")
    run = running_sums(counts, "value", ["a", "b"], ["column_name"], with_totals=True, groups_bounded=groups_bounded)
    run = run.withColumnRenamed("a_total", "n_ref").withColumnRenamed("b_total", "n_cur")
    # reference mean per column (one row per column), for a centred variance
    mean = counts.groupBy("column_name").agg(
        F.try_divide(F.sum(F.col("a") * F.col("value")), F.sum("a").cast("double")).alias("_mean"))
    j = run.join(F.broadcast(mean) if groups_bounded else mean, "column_name")      # unhinted: the planner sees its size
    gap = F.abs(F.try_divide(F.col("a_run").cast("double"), F.col("n_ref"))
                - F.try_divide(F.col("b_run").cast("double"), F.col("n_cur")))
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    per = j.groupBy("column_name").agg(
        F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"),
        F.max(gap).alias("ks"), F.sum(gap * step).alias("wasserstein"),
        F.sqrt(F.try_divide(F.sum(F.col("a") * (F.col("value") - F.col("_mean")) ** 2),
                            F.first("n_ref").cast("double"))).alias("ref_std"))
    return per.select(
        "column_name", "n_ref", "n_cur", "ks",
        ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_cur")).alias("ks_p_value"),
        "wasserstein",
        (F.col("wasserstein") / F.greatest(F.coalesce("ref_std", F.lit(0.0)), F.lit(0.001)))
        .alias("wasserstein_norm"))


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Chi-square survival function Q(dof/2, stat/2), one value per column result."""
    return pd.Series([_gammq(d / 2.0, s / 2.0) if s is not None and d and d > 0
                      and not math.isnan(s) else None for s, d in zip(stat, dof)], dtype="float64")


def _gammq(a: float, x: float) -> float:
    """Regularised upper incomplete gamma (series below a+1, continued fraction above)."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1:
        ap, s = a, 1.0 / a
        delta = s
        while abs(delta) >= abs(s) * 1e-15:     # the terms fall geometrically once ap > x
            ap += 1
            delta *= x / ap
            s += delta
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b = x + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    i = 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 3e-15:
            break
        if i > 10_000_000:
            raise ArithmeticError(f"the continued fraction did not converge at a={a}, x={x}")
    return min(1.0, math.exp(-x + a * math.log(x) - gln) * h)


PSI_FLOOR = 0.0001


def categorical_drift(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DRF3 + DRF4 per categorical column: chi-square homogeneity statistic,
    degrees of freedom and p-value; Jensen-Shannon distance (base 2); PSI.

    Null is a category of its own (it is a value the model sees)."""
    return categorical_drift_of(pair_counts(ref, cur, categorical=columns))


def categorical_drift_of(counts: DataFrame) -> DataFrame:
    """DRF3 + DRF4 of settled counts (kind, column_name, txt, a, b)."""
    counts = counts.where(F.col("kind") == TEXT).select("column_name", F.coalesce("txt", F.lit("<null>")).alias("value"), "a", "b")
    counts = counts.groupBy("column_name", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = counts.groupBy("column_name").agg(
        F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur"), F.count(F.lit(1)).alias("k"))
    j = counts.join(F.broadcast(totals), "column_name")
    p = F.coalesce(F.try_divide(F.col("a").cast("double"), F.col("n_ref")), F.lit(0.0))
    q = F.coalesce(F.try_divide(F.col("b").cast("double"), F.col("n_cur")), F.lit(0.0))
    m = (p + q) / 2
    kl = (F.when(p > 0, p * F.log2(F.try_divide(p, m))).otherwise(0.0)
          + F.when(q > 0, q * F.log2(F.try_divide(q, m))).otherwise(0.0))
    n_ref, n_cur = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    row_t = F.col("a").cast("double") + F.col("b")
    e_a = F.try_divide(row_t * n_ref, n_ref + n_cur)
    e_b = F.try_divide(row_t * n_cur, n_ref + n_cur)
    chi = (F.coalesce(F.try_divide((F.col("a") - e_a) ** 2, e_a), F.lit(0.0))
           + F.coalesce(F.try_divide((F.col("b") - e_b) ** 2, e_b), F.lit(0.0)))
    pf = F.greatest(p, F.lit(PSI_FLOOR))
    qf = F.greatest(q, F.lit(PSI_FLOOR))  # floored: no zero divisor below
    per = j.groupBy("column_name").agg(
        F.sum(chi).alias("chi2"), F.sqrt(F.greatest(F.sum(kl) / 2, F.lit(0.0))).alias("jensen_shannon"),
        F.sum((qf - pf) * F.log(qf / pf)).alias("psi"))
    out = totals.join(per, "column_name")
    dof = (F.col("k") - 1).cast("long")
    return out.select("column_name", "n_ref", "n_cur", F.col("k").alias("n_categories"),
                      "chi2", dof.alias("dof"), chi2_sf(F.col("chi2"), dof).alias("chi2_p_value"),
                      "jensen_shannon", "psi")


def column_drift(ref: DataFrame, cur: DataFrame, numeric: Sequence[str],
                 categorical: Sequence[str], cfg: DriftConfig = DEFAULT_DRIFT, counts: DataFrame | None = None) -> DataFrame:
    """Per column: kind, test, score, threshold, drifted.  ``cfg.decide_by`` names
    the deciding score, the same at every size; ``status`` tells columns without
    any current or reference value (score null, never counted as compared).
    ``counts`` are the ``pair_counts`` of both tables, when the caller has them."""
    if cfg.decide_by not in ("distance", "p_value"):
        raise ValueError(f"decide_by is 'distance' or 'p_value', not {cfg.decide_by!r}")
    by_distance = cfg.decide_by == "distance"
    if counts is None:
        counts = pair_counts(ref, cur, numeric, categorical)
    parts = []

    def part(d, kind, names, distance, test, p):
        score = F.col(distance if by_distance else p)
        # a column without a value on either side keeps its row
        wanted = d.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
        d = F.broadcast(wanted).join(d, "column_name", "left")
        n_ref, n_cur = F.coalesce("n_ref", F.lit(0)), F.coalesce("n_cur", F.lit(0))
        status = (F.when(n_cur == 0, "no_current_data").when(n_ref == 0, "no_reference_data").otherwise("ok"))
        cut = cfg.distance_cut if by_distance else cfg.p_value_cut
        over = (score >= cut) if by_distance else (score < cut)
        return d.select("column_name", F.lit(kind).alias("kind"), n_ref.alias("n_ref"), n_cur.alias("n_cur"),
                        F.lit(distance if by_distance else test).alias("test"), F.when(status == "ok", score).alias("score"),
                        F.lit(cut).alias("threshold"), F.coalesce(over & (status == "ok"), F.lit(False)).alias("drifted"),
                        status.alias("status"))
    if numeric:
        parts.append(part(numeric_drift_of(counts), "numeric", numeric, "wasserstein_norm", "ks", "ks_p_value"))
    if categorical:
        parts.append(part(categorical_drift_of(counts), "categorical", categorical, "jensen_shannon", "chi_square", "chi2_p_value"))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def with_sample_gate(per_column: DataFrame, min_rows: int = MIN_DRIFT_SAMPLES) -> DataFrame:
    """FLT5 for drift: a column whose reference or current sample is below
    ``min_rows`` gets ``status = 'insufficient'`` and is not counted as drifted."""
    low = (F.col("n_ref") < min_rows) | (F.col("n_cur") < min_rows)
    return (per_column.withColumn("status", F.when(low, "insufficient").otherwise("ok"))
            .withColumn("drifted", F.col("drifted") & ~low))


def dataset_drift(per_column: DataFrame, share: float = DEFAULT_DRIFT.dataset_share) -> DataFrame:
    """DRF6: one row - columns, drifted count and share, dataset flag, sorted names.
    Columns that could not be compared (``status`` other than ``ok``) do not
    weigh in the share."""
    compared = F.count_if(F.col("status") == "ok") if "status" in per_column.columns else F.count(F.lit(1))
    agg = per_column.agg(
        F.count(F.lit(1)).alias("n_columns"), compared.alias("_n"),
        F.count_if("drifted").alias("n_drifted"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("column_name")))).alias("_names"))
    return agg.select(
        "n_columns", "n_drifted",
        F.coalesce(F.try_divide(F.col("n_drifted").cast("double"), F.col("_n")), F.lit(0.0))
        .alias("share_drifted"),
        (F.coalesce(F.try_divide(F.col("n_drifted").cast("double"), F.col("_n")), F.lit(0.0))
         >= share).alias("dataset_drift"),
        F.array_join("_names", ",").alias("drifted_columns"))


def drift_summary(ds: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """DRF7: the dataset row with an action (retrain on dataset drift, else
    monitor) and, given the ``pair_counts``, the sample sizes of both tables."""
    from tabulon.functions.scalar import short_list
    out = ds.select(
        "dataset_drift", "n_drifted", "n_columns", "share_drifted",
        short_list(F.split(F.nullif(F.col("drifted_columns"), F.lit("")), ",")).alias("drifted_preview"),
        F.when(F.col("dataset_drift"), "retrain").otherwise("monitor").alias("action"))
    if counts is not None:
        n = sample_sizes(counts).withColumnsRenamed({"reference_rows": "reference_samples", "current_rows": "current_samples"})
        out = out.crossJoin(F.broadcast(n))                       # one row each
    return out


def target_drift(ref: DataFrame, cur: DataFrame, target: str, cfg: DriftConfig = DEFAULT_DRIFT, categorical: bool = True,
                 counts: DataFrame | None = None) -> DataFrame:
    """DRF5: the drift test on the target only, when both tables have it (no rows
    else); ``counts`` may hold it among other columns."""
    if target not in ref.columns or target not in cur.columns:
        none = ref.limit(0).select(F.lit("").alias("x"))
        return column_drift(none, none, [], ["x"], cfg).limit(0)
    if counts is not None:
        counts = counts.where((F.col("column_name") == target) & (F.col("kind") == (TEXT if categorical else NUMBER)))
    names = ([], [target]) if categorical else ([target], [])
    return column_drift(ref, cur, *names, cfg, counts)


def retrain_decision(ds: DataFrame, td: DataFrame | None, tests: DataFrame | None) -> DataFrame:
    """DEC1: retrain if dataset drift, target drift or failed tests; with reasons."""
    d = ds.select("dataset_drift", F.lit(0).alias("_k"))
    t = (td.agg(F.max(F.col("drifted").cast("int")).alias("_t")) if td is not None
         else d.select(F.lit(0).alias("_t")).limit(1))
    t = t.select(F.coalesce(F.col("_t"), F.lit(0)).cast("boolean").alias("target_drift"),
                 F.lit(0).alias("_k"))
    f = (tests.agg(F.count_if(F.col("status") != "SUCCESS").alias("tests_failed")) if tests is not None
         else d.select(F.lit(0).cast("long").alias("tests_failed")).limit(1))
    f = f.withColumn("_k", F.lit(0))
    j = d.join(F.broadcast(t), "_k").join(F.broadcast(f), "_k").drop("_k")          # one row each
    from tabulon import config as C
    reasons = F.array_compact(F.array(
        F.when(F.col("dataset_drift"), F.lit(C.REASON_DATASET_DRIFT)),
        F.when(F.col("target_drift"), F.lit(C.REASON_TARGET_DRIFT)),
        F.when(F.col("tests_failed") > 0,
               F.concat(F.col("tests_failed").cast("string"), F.lit(C.REASON_TESTS_FAILED)))))
    return j.select("dataset_drift", "target_drift", "tests_failed",
                    (F.size(reasons) > 0).alias("retrain_needed"),
                    F.array_join(reasons, "; ").alias("reasons"))


def validation_summary(decision: DataFrame, ref: DataFrame, cur: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """DEC2: decision row with sample and column counts of both tables (rows from
    the ``pair_counts`` when given)."""
    if counts is None:
        counts = pair_counts(ref, cur, categorical=[ref.columns[0]])
    return (decision.crossJoin(F.broadcast(sample_sizes(counts)))             # one row each
            .withColumn("reference_columns", F.lit(len(ref.columns)))
            .withColumn("current_columns", F.lit(len(cur.columns))))


# --- binned forms (fixed reference bins; used by the monitor and STR4) ---

def binned(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of ``value`` on the reference range (clipped to 1..bins);
    a constant reference puts everything in bin 1."""
    if not hi > lo:
        return F.lit(1)
    b = F.floor((F.col(value) - F.lit(lo)) * bins / F.lit(hi - lo)) + 1
    return F.least(F.greatest(b, F.lit(1)), F.lit(bins)).cast("int")


def binned_drift(hist: DataFrame, ref_hist: DataFrame, bins: int = 20) -> DataFrame:
    """Per window: Jensen-Shannon distance and binned KS against the reference
    histogram.  Inputs are (window_start, bin, n) and (bin, n): bounded by
    windows × bins."""
    grid = hist.select("window_start").distinct().select(
        "window_start", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    cur = grid.join(hist, ["window_start", "bin"], "left").fillna(0, subset=["n"])
    tot = cur.groupBy("window_start").agg(F.sum("n").alias("n_total"))
    # reference shares over at most ``bins`` rows
    ref = ref_hist.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("p"))
    j = cur.join(tot, "window_start").join(F.broadcast(ref), "bin", "left").fillna(0.0, subset=["p"])
    j = j.withColumn("q", F.col("n") / F.col("n_total"))
    w = Window.partitionBy("window_start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("cp", F.sum("p").over(w)).withColumn("cq", F.sum("q").over(w))
    m = (F.col("p") + F.col("q")) / 2
    kl = (F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / m)).otherwise(0.0)
          + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / m)).otherwise(0.0))
    return j.groupBy("window_start").agg(
        F.first("n_total").alias("n"), F.max(F.abs(F.col("cp") - F.col("cq"))).alias("ks_binned"),
        F.sqrt(F.greatest(F.sum(kl) / 2, F.lit(0.0))).alias("jensen_shannon"))
