"""Table and row validation (AGG1, AGG4, VAL*, TST1).

Every table-level check is a single aggregate over the whole table, so a
table is scanned once no matter how many columns or checks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.functions import scalar as S


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG4: (column, missing, missing_share, n_rows) in one pass, plus a
    row-level flag counted in the same aggregate."""
    cols = list(columns) if columns is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(_q(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("missing"))
               for i, c in enumerate(cols)]
    long = one.select("_n", F.inline(F.array(*structs)))
    return long.select(
        "column_name", "missing",
        F.coalesce(F.try_divide(F.col("missing"), F.col("_n")), F.lit(0.0)).alias("missing_share"),
        F.col("_n").alias("n_rows"))


def row_has_missing(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    cols = list(columns) if columns is not None else df.columns
    if not cols:
        return F.lit(False)
    return F.greatest(*[_q(c).isNull() for c in cols]) if len(cols) > 1 else _q(cols[0]).isNull()


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG4 roll-up, one row: rows, cells, missing cells, columns with missing,
    rows with missing (and shares)."""
    cols = list(columns) if columns is not None else df.columns
    per_col = [F.count_if(_q(c).isNull()) for c in cols]
    agg = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (sum(per_col[1:], per_col[0]) if per_col else F.lit(0)).alias("missing_cells"),
        (sum([(m > 0).cast("int") for m in per_col[1:]], (per_col[0] > 0).cast("int"))
         if per_col else F.lit(0)).alias("columns_with_missing"),
        F.count_if(row_has_missing(df, cols)).alias("rows_with_missing"),
    )
    n_cells = F.col("n_rows") * F.lit(len(cols))
    return agg.select(
        "n_rows", F.lit(len(cols)).alias("n_columns"), "missing_cells",
        F.coalesce(F.try_divide(F.col("missing_cells"), n_cells), F.lit(0.0)).alias("missing_share"),
        "columns_with_missing", "rows_with_missing",
        F.coalesce(F.try_divide(F.col("rows_with_missing"), F.col("n_rows")), F.lit(0.0))
        .alias("rows_with_missing_share"))


def validate_table(df: DataFrame, min_rows: int = C.MIN_SAMPLES,
                   max_missing_share: float = C.MAX_MISSING_SHARE,
                   required: Sequence[str] = C.REQUIRED_COLUMNS) -> DataFrame:
    """AGG1: one row with each check and the overall AND.

    Missing required columns are reported, not raised ("warn and continue").
    """
    return validate_summary(missing_summary(df), df.columns, min_rows, max_missing_share, required)


def validate_summary(summary: DataFrame, columns: Sequence[str], min_rows: int = C.MIN_SAMPLES,
                     max_missing_share: float = C.MAX_MISSING_SHARE, required: Sequence[str] = C.REQUIRED_COLUMNS) -> DataFrame:
    """AGG1 from the missing summary of a table with these columns."""
    missing_req = [c for c in required if c not in columns]
    return summary.select(
        "n_rows", "n_columns", "missing_cells", "missing_share",
        (F.col("n_rows") >= min_rows).alias("has_min_rows"),
        (F.col("missing_share") <= max_missing_share).alias("missing_ok"),
        F.lit(len(missing_req) == 0).alias("required_present"),
        F.lit(", ".join(missing_req)).alias("missing_required"),
        ((F.col("n_rows") >= min_rows) & (F.col("missing_share") <= max_missing_share)
         & F.lit(len(missing_req) == 0)).alias("is_valid"))


def violations(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """VAL1: adds ``violations`` (names of the failed rules; a null check
    counts as failed) and ``is_valid``.  ``rules`` are (name, ok-condition)."""
    fails = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    v = F.array_compact(F.array(*fails))
    return df.withColumn("violations", v).withColumn("is_valid", F.size("violations") == 0)


def split_valid(df: DataFrame, rules: Sequence[tuple[str, Column]]
                ) -> tuple[DataFrame, DataFrame]:
    """VAL1: (valid rows, quarantined rows with their violations)."""
    checked = violations(df, rules)
    return (checked.where("is_valid").drop("violations", "is_valid"),
            checked.where(~F.col("is_valid")).drop("is_valid"))


def violation_counts(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """VAL2: (rule, n_violations) for every rule, zero-filled."""
    names = [n for n, _ in rules]
    checked = violations(df, rules)
    # one conditional count per rule: a single pass, no explode of the table
    row = checked.agg(*[F.count_if(F.array_contains("violations", n)).alias(f"_v{i}")
                        for i, n in enumerate(names)])
    structs = [F.struct(F.lit(n).alias("rule"), F.col(f"_v{i}").alias("n_violations"))
               for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*structs)))


REQUEST_RULE_NAMES = (
    "phone_service_required", "internet_service_required", "contract_required",
    "monthly_charges_positive", "tenure_months_non_negative", "cltv_non_negative",
    "age_non_negative", "population_non_negative", "satisfaction_score_range",
)


def request_rules() -> list[tuple[str, Column]]:
    """Rules of the scoring request (FIXTURES A2)."""
    def not_blank(c):
        return ~S.is_blank(c)
    checks = [
        not_blank("phone_service"), not_blank("internet_service"), not_blank("contract"),
        F.col("monthly_charges") > 0, F.col("tenure_months") >= 0, F.col("cltv") >= 0,
        F.col("age") >= 0, F.col("population") >= 0, F.col("satisfaction_score").between(1, 5),
    ]
    return list(zip(REQUEST_RULE_NAMES, checks))


def unseen_values(current: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """VAL3 / JON5: distinct values of ``column`` in ``current`` that the
    reference never had (anti join; both sides shuffle on the value)."""
    cur = current.select(column).where(F.col(column).isNotNull()).distinct()
    ref = reference.select(column).where(F.col(column).isNotNull()).distinct()
    return cur.join(ref, column, "left_anti")


def test_suite(df: DataFrame, max_columns_with_missing: int = C.TEST_MAX_COLUMNS_WITH_MISSING,
               max_rows_share: float = C.TEST_MAX_ROWS_WITH_MISSING_SHARE) -> DataFrame:
    """TST1: (test, value, limit, status) rows from one missing-value pass.

    Both the count form and the share form of the rows test are reported; the
    share form is the one the decision uses.
    """
    s = missing_summary(df)
    rows = [
        F.struct(F.lit("columns_with_missing_values").alias("test"),
                 F.col("columns_with_missing").cast("double").alias("value"),
                 F.lit(float(max_columns_with_missing)).alias("limit"),
                 (F.col("columns_with_missing") < max_columns_with_missing).alias("passed")),
        F.struct(F.lit("rows_with_missing_values_share").alias("test"),
                 F.col("rows_with_missing_share").alias("value"),
                 F.lit(float(max_rows_share)).alias("limit"),
                 (F.col("rows_with_missing_share") < max_rows_share).alias("passed")),
        F.struct(F.lit("rows_with_missing_values_count").alias("test"),
                 F.col("rows_with_missing").cast("double").alias("value"),
                 F.lit(0.0).alias("limit"),
                 (F.col("rows_with_missing") <= 0).alias("passed")),
    ]
    return s.select(F.inline(F.array(*rows))).select(
        "test", "value", "limit",
        F.when(F.col("passed"), "SUCCESS").otherwise("FAIL").alias("status"))
