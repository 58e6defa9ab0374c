"""Projection, coercion and imputation (PRJ*, CST*, IMP*, FLT*).

Imputation follows the fit/apply split of Spark ML: the fill values are a
fitted state (one value per column, so bounded by the schema width), computed
distributed and then applied with ``fillna`` - the same statistics travel with
the model to scoring.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import config as C
from tabulon.functions import scalar as S
from tabulon.operators import counts as VC
from tabulon.roles import numeric_columns, string_columns


# --- projections --------------------------------------------------------------

@dataclass(frozen=True)
class DropReport:
    dropped: tuple[str, ...]
    not_found: tuple[str, ...]


def drop_listed(df: DataFrame, columns: Iterable[str] = C.DROP_COLUMNS
                ) -> tuple[DataFrame, DropReport]:
    """PRJ1: drop the listed columns that exist; report dropped and missing names."""
    cols = list(columns)
    present = [c for c in cols if c in df.columns]
    missing = [c for c in cols if c not in df.columns]
    return df.drop(*present), DropReport(tuple(present), tuple(missing))


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ2: keep the columns both tables have, in sorted order."""
    common = sorted(set(a.columns) & set(b.columns))
    return a.select(*[F.col(f"`{c}`") for c in common]), b.select(*[F.col(f"`{c}`") for c in common])


def split_target(df: DataFrame, target: str) -> DataFrame:
    """PRJ4: the target as int, features unchanged."""
    return df.withColumn(target, F.col(target).cast("int"))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ5: request field names → model column names."""
    return df.withColumnsRenamed(dict(mapping))


def ints_to_double(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """PRJ6: integral columns to double (as done before ML)."""
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name)
        if isinstance(f.dataType, integral) and f.name not in exclude
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def unpivot_record(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """PRJ7: one record as (feature, display value) rows.

    Values are formatted per column type, then unpivoted; names get ``_`` →
    space and Title Case.
    """
    shown = df.select(key, *[S.display_value(F.col(f"`{c}`")).alias(c) for c in columns])
    long = shown.unpivot(key, list(columns), "feature", "display_value")
    return long.withColumn("feature", S.title_words("feature"))


# --- filters ---------------------------------------------------------------

def pick_entity(df: DataFrame, key: str, value) -> DataFrame:
    """FLT1: one entity by key (empty result instead of an error)."""
    return df.where(F.col(key) == F.lit(value))


def keep_severities(df: DataFrame, col: str = "severity",
                    levels: Sequence[str] = ("warning", "error")) -> DataFrame:
    """FLT2."""
    return df.where(F.col(col).isin(list(levels)))


def not_success(df: DataFrame, col: str = "status", ok: str = "SUCCESS") -> DataFrame:
    """FLT3: null-safe "status is not SUCCESS"."""
    return df.where(~F.col(col).eqNullSafe(F.lit(ok)))


def time_slices(df: DataFrame, ts: str, reference_days: int = C.REFERENCE_WINDOW_DAYS,
                current_days: int = C.CURRENT_WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """FLT4: last ``reference_days`` vs last ``current_days`` before the latest time.

    The latest time is one scalar aggregate; used as a literal the filters
    reach the parquet scan as pushed predicates.
    """
    max_ts = df.agg(F.max(ts)).first()[0]
    if max_ts is None:
        return df.limit(0), df.limit(0)
    hi = S.typed_lit(max_ts, df.schema[ts].dataType)
    ref = df.where(F.col(ts) >= hi - F.expr(f"INTERVAL {reference_days} DAYS"))
    cur = df.where(F.col(ts) >= hi - F.expr(f"INTERVAL {current_days} DAYS"))
    return ref, cur


# --- imputation ---------------------------------------------------------------

def median_fill_values(df: DataFrame, columns: Sequence[str] | None = None,
                       exact: bool = True) -> dict[str, float]:
    """IMP1 fit: exact (interpolated) median per numeric column.

    Exact medians go through the distributed distinct-value scan; set
    ``exact=False`` for ``percentile_approx`` on very wide tables.
    The returned map has one entry per column (bounded by the schema).
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return {}
    if not exact:
        row = df.agg(*[F.percentile_approx(F.col(f"`{c}`"), 0.5, 100000).alias(c)
                       for c in cols]).first()
        return {c: row[c] for c in cols if row[c] is not None}
    return VC.fills_of(VC.value_counts(df, cols), cols, [], C.UNKNOWN_CATEGORY)


def mode_fill_values(df: DataFrame, columns: Sequence[str] | None = None,
                     unknown: str = C.UNKNOWN_CATEGORY) -> dict[str, str]:
    """IMP2 fit: most frequent value per text column, smallest on ties;
    ``Unknown`` when the column has no value at all."""
    cols = list(columns) if columns is not None else string_columns(df)
    if not cols:
        return {}
    return VC.fills_of(VC.value_counts(df, categorical=cols), [], cols, unknown)


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """IMP apply: fill nulls with the fitted values (NaN is nulled at the scan)."""
    if not values:
        return df
    return df.select(*[
        F.coalesce(F.col(f"`{c}`"), F.lit(values[c]).cast(df.schema[c].dataType)).alias(c)
        if c in values else F.col(f"`{c}`") for c in df.columns])


def impute(df: DataFrame, numeric: Sequence[str] | None = None,
           categorical: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """IMP1 + IMP2: median for numbers, mode for text, fitted in one scan.
    Returns (table, fill values)."""
    num = list(numeric) if numeric is not None else numeric_columns(df)
    cat = list(categorical) if categorical is not None else string_columns(df)
    values = VC.fills_of(VC.value_counts(df, num, cat), num, cat, C.UNKNOWN_CATEGORY)
    return fill(df, values), values


def to_long(df: DataFrame, cols: Sequence[str], as_type: str = "double") -> DataFrame:
    """(column, value) rows for the listed columns - one pass, many columns."""
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast(as_type).alias("value"))
               for c in cols]
    return df.select(F.inline(F.array(*structs)))
