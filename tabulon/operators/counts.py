"""Value counts: one table from which profiles, fills and checks are read.

``value_counts`` scans a table once and keeps (kind, column_name, num, txt, n): how
often each value of each column occurs, nulls included, and with ``rows`` how many
cells of a row are null.  It is settled, so everything below costs no second scan:
missing counts (AGG4), descriptions with exact quantiles (AGG3), distinct values
(AGG6), outliers (AGG19), the quality profile (AGG21), medians and modes (IMP1-2),
validation (AGG1) and the report before and after preparation (AGG2).

Counts of disjoint parts of a table (days, say) merge by addition:
``merge_counts`` gives the counts of the whole without reading a part again.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.ordered import materialize, quantiles_of_counts

#: kinds of entries: a number, a text, any other column (null or not), a row's number of nulls
NUMBER, TEXT, OTHER, ROW = "number", "text", "other", "row"

KEYS = ("kind", "column_name", "num", "txt")


def value_counts(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), others: Sequence[str] = (),
                 rows: bool = False, texts: bool = False) -> DataFrame:
    """The settled counts of the listed columns.  ``texts`` keeps whole and
    decimal numbers as text too, so that large ones stay apart."""
    q = lambda c: F.col(f"`{c}`")
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def entry(kind: str, name: str, num: Column, txt: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("column_name"), num.alias("num"), txt.alias("txt"))
    kinds = dict(df.dtypes)
    exact = {c: q(c).cast("string") for c in numeric if texts and kinds[c] not in ("double", "float")}      # -0.0 and 0.0 are one value
    entries = [entry(NUMBER, c, F.nanvl(q(c).cast("double"), none), exact.get(c, text)) for c in numeric]
    entries += [entry(TEXT, c, none, q(c).cast("string")) for c in categorical]
    entries += [entry(OTHER, c, F.when(q(c).isNotNull(), 1.0), text) for c in others]
    if rows:
        listed = [*numeric, *categorical, *others]
        nulls = reduce(lambda a, c: a + q(c).isNull().cast("int"), listed, F.lit(0))
        entries.append(entry(ROW, "", nulls.cast("double"), text))
    if not entries:
        return df.sparkSession.createDataFrame([], "kind string, column_name string, num double, txt string, n long")
    return materialize(df.select(F.inline(F.array(*entries))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """The counts of a table from those of its disjoint parts."""
    return reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.sum("n").alias("n"))


def _null() -> Column:
    return F.when(F.col("kind") == TEXT, F.col("txt").isNull()).otherwise(F.col("num").isNull())


def _named(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column, in the given list, also of columns without entries."""
    return counts.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")


def missing_by_column(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG4: (column_name, missing, missing_share, n_rows)."""
    per = counts.where(F.col("kind") != ROW).groupBy("column_name").agg(
        F.sum(F.when(_null(), F.col("n")).otherwise(0)).alias("missing"), F.sum("n").alias("n_rows"))
    out = F.broadcast(_named(counts, columns)).join(per, "column_name", "left")
    zero = F.lit(0).cast("long")
    return out.select("column_name", F.coalesce("missing", zero).alias("missing"),
                      F.coalesce(F.try_divide(F.col("missing"), F.col("n_rows")), F.lit(0.0)).alias("missing_share"),
                      F.coalesce("n_rows", zero).alias("n_rows"))


def missing_of_rows(counts: DataFrame, n_columns: int) -> DataFrame:
    """AGG4 roll-up of counts with ``rows``: the row that ``validate.missing_summary``
    gives of the table itself."""
    per = counts.groupBy("kind", "column_name").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == ROW, F.col("n") * F.col("num"))).alias("cells"),
        F.sum(F.when((F.col("kind") == ROW) & (F.col("num") > 0), F.col("n")).otherwise(0)).alias("rows"),
        F.sum(F.when((F.col("kind") != ROW) & _null(), F.col("n")).otherwise(0)).alias("missing"))
    row = F.col("kind") == ROW
    s = per.agg(F.coalesce(F.max(F.when(row, F.col("n"))), F.lit(0)).alias("n_rows"),
                F.coalesce(F.max(F.when(row, F.col("cells"))), F.lit(0.0)).cast("long").alias("missing_cells"),
                F.count_if(~row & (F.col("missing") > 0)).cast("int").alias("columns_with_missing"),
                F.coalesce(F.max(F.when(row, F.col("rows"))), F.lit(0)).alias("rows_with_missing"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select("n_rows", F.lit(n_columns).alias("n_columns"), "missing_cells",
                    share(F.col("missing_cells"), F.col("n_rows") * F.lit(n_columns)).alias("missing_share"),
                    "columns_with_missing", "rows_with_missing",
                    share(F.col("rows_with_missing"), F.col("n_rows")).alias("rows_with_missing_share"))


def _numbers(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("kind") == NUMBER) & F.col("num").isNotNull())


def describe_counts(counts: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """AGG3: per numeric column count, mean, sample std, min, quantiles, max."""
    c = _numbers(counts)
    base = c.groupBy("column_name").agg(
        F.sum("n").alias("count"), (F.sum(F.col("n") * F.col("num")) / F.sum("n")).alias("mean"),
        F.min("num").alias("min"), F.max("num").alias("max"))
    mean = F.broadcast(base.select("column_name", F.col("mean").alias("_mean")))            # one row per column
    squares = c.join(mean, "column_name").groupBy("column_name").agg(
        F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("num") - F.col("_mean")) ** 2), F.sum("n") - 1)).alias("std"))
    qs = quantiles_of_counts(c, "num", "n", probs, ["column_name"])
    names = {float(p): f"p{int(round(p * 100))}" for p in probs}
    wide = qs.groupBy("column_name").agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for p, n in names.items()])
    out = F.broadcast(_named(counts, columns)).join(base, "column_name", "left").join(squares, "column_name", "left").join(wide, "column_name", "left")
    return out.select("column_name", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "mean", "std", "min", *names.values(), "max")


def distinct_of(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG6: (column_name, n_distinct, has_null); null is no value."""
    some = F.coalesce("txt", F.col("num").cast("string")).isNotNull()
    per = counts.where(F.col("kind").isin(NUMBER, TEXT)).groupBy("column_name").agg(
        F.count_if(some).alias("n_distinct"), F.max(~some).alias("has_null"))
    out = F.broadcast(_named(counts, columns)).join(per, "column_name", "left")
    return out.select("column_name", F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"), "has_null")


def modes_of(counts: DataFrame) -> DataFrame:
    """(column_name, mode, mode_count): the most frequent value, smallest text on ties."""
    shown = F.coalesce("txt", F.col("num").cast("string"))
    c = counts.where(F.col("kind").isin(NUMBER, TEXT)).select("column_name", shown.alias("value"), "n").where("value is not null")
    return c.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.max("n").alias("mode_count"))


def outliers_of(counts: DataFrame, k: float) -> DataFrame:
    """AGG19: values outside [Q1 - k IQR, Q3 + k IQR] per numeric column."""
    c = _numbers(counts)
    qs = quantiles_of_counts(c, "num", "n", [0.25, 0.75], ["column_name"])
    b = qs.groupBy("column_name").agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
                                      F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"))
    spread = k * (F.col("q3") - F.col("q1"))
    b = b.select("column_name", "q1", "q3", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))
    out = (F.col("num") < F.col("lower")) | (F.col("num") > F.col("upper"))
    n = c.join(F.broadcast(b), "column_name").groupBy("column_name").agg(F.sum(F.when(out, F.col("n")).otherwise(0)).alias("n_outliers"))
    return b.join(F.broadcast(n), "column_name")                                             # one row per column


def fills_of(counts: DataFrame, numeric: Sequence[str], categorical: Sequence[str], unknown: str) -> dict:
    """IMP1 + IMP2: the exact median of each numeric column that has values, the
    mode of each text column (``unknown`` without values): one value per column."""
    out = {}
    if numeric:
        med = quantiles_of_counts(_numbers(counts), "num", "n", [0.5], ["column_name"])
        out.update({r["column_name"]: r["value"] for r in med.collect() if r["column_name"] in set(numeric)})
    if categorical:
        found = {r["column_name"]: r["mode"] for r in modes_of(counts.where(F.col("kind") == TEXT)).collect()}
        out.update({c: found.get(c, unknown) for c in categorical})
    return out


def filled(counts: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """The counts of the table whose nulls were replaced (row entries are left out)."""
    num, txt = F.col("num"), F.col("txt")
    for c, v in values.items():
        here = F.col("column_name") == c
        if isinstance(v, str):
            txt = F.when(here & (F.col("kind") == TEXT) & F.col("txt").isNull(), F.lit(v)).otherwise(txt)
        else:
            num = F.when(here & (F.col("kind") == NUMBER) & F.col("num").isNull(), F.lit(float(v))).otherwise(num)
    return counts.where(F.col("kind") != ROW).select("kind", "column_name", num.alias("num"), txt.alias("txt"), "n")
