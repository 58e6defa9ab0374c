"""Column profiles (AGG2, AGG3, AGG5, AGG6, AGG15, AGG19, AGG21).

Everything but histograms and class counts is read from the value counts of
``operators.counts``: one scan of the table, then only its distinct values.
Results are long tables (one row per column), joined on the column name.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.operators import counts as VC
from tabulon.operators.clean import to_long
from tabulon.roles import numeric_columns, string_columns


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def describe(df: DataFrame, columns: Sequence[str] | None = None,
             probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """AGG3: per numeric column count, mean, sample std, min, 25/50/75 %, max.

    Quantiles are exact and interpolated (pandas ``describe``).
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    return VC.describe_counts(VC.value_counts(df, cols), cols, probs)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """AGG5: (class, n, share).  The total rides along as a window over the
    already-aggregated classes (a handful of rows)."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("class", "n", (F.col("n") / total).alias("share"))


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None,
                     approximate: bool = False) -> DataFrame:
    """AGG6: (column, n_distinct, has_null) per categorical column.

    ``n_distinct`` skips null (pandas ``nunique``); ``approximate`` switches to
    HyperLogLog++ for very large tables.
    """
    cols = list(columns) if columns is not None else string_columns(df)
    if not approximate:
        return VC.distinct_of(VC.value_counts(df, categorical=cols), cols)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.approx_count_distinct(_q(c)).alias(f"d_{i}"), F.max(_q(c).isNull()).alias(f"n_{i}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"d_{i}").alias("n_distinct"),
                        F.col(f"n_{i}").alias("has_null")) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*structs)))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG6: (column, value) for every distinct value, null kept (pandas ``unique``)."""
    return to_long(df, columns, as_type="string").distinct()


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """AGG15: equal-width bins between min and max; the maximum falls in the
    last bin; empty bins appear with count 0 (bin grid from ``sequence``)."""
    x = _q(column).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("_k", F.lit(0))
    d = (df.select(x.alias("x"), F.lit(0).alias("_k")).where(F.col("x").isNotNull())
         .join(F.broadcast(rng), "_k"))  # one-row range, broadcast
    b = F.least(F.width_bucket("x", "lo", "hi", F.lit(bins)), F.lit(bins))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(b)
    counts = d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + (F.col("bin") - 1) * w).alias("bin_start"),
        (F.col("lo") + F.col("bin") * w).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None,
                 k: float = C.OUTLIER_IQR_FACTOR) -> DataFrame:
    """AGG19: per column, values outside [Q1 - k·IQR, Q3 + k·IQR] with exact quartiles."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    return VC.outliers_of(VC.value_counts(df, cols), k)


def quality_profile(df: DataFrame, dataset: str, numeric: Sequence[str] | None = None,
                    categorical: Sequence[str] | None = None) -> DataFrame:
    """AGG21: per column mode, distinct count and share, missing share, tagged
    with ``dataset``; union reference and current profiles to compare."""
    num = list(numeric) if numeric is not None else numeric_columns(df)
    cat = list(categorical) if categorical is not None else string_columns(df)
    counts = VC.value_counts(df, num, cat, texts=True)
    cols = num + cat
    d = (VC.missing_by_column(counts, cols).join(F.broadcast(VC.distinct_of(counts, cols)), "column_name")
         .join(F.broadcast(VC.modes_of(counts)), "column_name", "left"))                     # one row per column each
    return d.select(F.lit(dataset).alias("dataset"), "column_name", "n_rows", "missing", "missing_share", "n_distinct",
                    F.coalesce(F.try_divide(F.col("n_distinct"), F.col("n_rows")), F.lit(0.0)).alias("distinct_share"),
                    F.col("mode").alias("most_common"), "mode_count")


def before_after(summary: DataFrame, before: DataFrame, after: DataFrame, dropped: int, missing_after: Column) -> DataFrame:
    """AGG2: one row of shapes and missing counts before and after preparation,
    from the missing summary of the raw table (no second scan); ``missing_after``
    is an expression over it.  Preparation keeps all rows."""
    s = summary.withColumn("_after", missing_after)
    return s.select(
        F.col("n_rows").alias("rows_before"), F.lit(len(before.columns)).alias("columns_before"),
        F.col("n_rows").alias("rows_after"), F.lit(len(after.columns)).alias("columns_after"),
        F.lit(dropped).alias("columns_dropped"), F.col("missing_cells").alias("missing_before"), F.col("_after").alias("missing_after"),
        (F.col("missing_cells") - F.col("_after")).alias("missing_filled"),
        F.lit(_type_summary(before)).alias("types_before"), F.lit(_type_summary(after)).alias("types_after"))


def _type_summary(df: DataFrame) -> str:
    """Column count per Spark type, e.g. ``bigint:2,double:3,string:1`` (from the schema)."""
    counts = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    return ",".join(f"{t}:{n}" for t, n in sorted(counts.items()))
