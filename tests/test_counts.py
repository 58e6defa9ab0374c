"""Value counts against pandas; how often a table is scanned."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.operators import clean, counts as VC, profile, validate
from tabulon.plans.preparation import prepare


def frame(seed=2, n=500):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 5, n), 1)
    x[rng.random(n) < 0.1] = np.nan
    big = 2**60 + rng.integers(0, 40, n)
    s = rng.choice(["a", "b", "c", None], n, p=[0.4, 0.4, 0.1, 0.1])
    return pd.DataFrame({"id": np.arange(n), "x": x, "big": big, "s": s, "gone": [None] * n})


SCHEMA = "id long, x double, big long, s string, gone string"


def spark_frame(spark, pdf):
    rows = [(int(r.id), None if math.isnan(r.x) else float(r.x), int(r.big), r.s, None) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, SCHEMA)


def counted(spark, df):
    """``df`` behind a step that counts the rows read, and a reader of the count."""
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(tick, df.schema), lambda: seen.value


def test_profiles_match_pandas(spark):
    pdf = frame()
    df = spark_frame(spark, pdf)
    d = profile.describe(df, ["x", "big"]).toPandas().set_index("column_name")
    want = pdf["x"].describe()
    for got, name in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert abs(d.loc["x", got] - want[name]) < 1e-9
    distinct = {r.column_name: (r.n_distinct, r.has_null) for r in
                VC.distinct_of(VC.value_counts(df, ["x", "big"], ["s", "gone"], texts=True), ["x", "big", "s", "gone"]).collect()}
    assert distinct == {"x": (pdf["x"].nunique(), True), "big": (pdf["big"].nunique(), False), "s": (3, True), "gone": (0, True)}
    q = {r.column_name: r for r in profile.quality_profile(df, "t", ["x", "big"], ["s", "gone"]).collect()}
    assert q["s"].missing == pdf["s"].isna().sum() and q["gone"].most_common is None
    top = pdf["big"].value_counts()
    assert q["big"].mode_count == top.max() and q["big"].most_common == min(str(v) for v in top[top == top.max()].index)
    o = profile.iqr_outliers(df, ["x"], 0.5).first()
    q1, q3 = pdf["x"].quantile([0.25, 0.75])
    assert o.n_outliers == ((pdf["x"] < q1 - 0.5 * (q3 - q1)) | (pdf["x"] > q3 + 0.5 * (q3 - q1))).sum()


def test_counts_of_days_merge(spark):
    df = spark_frame(spark, frame())
    cols = (["x", "big"], ["s"])
    days = [VC.value_counts(df.where(F.col("id") % 3 == k), *cols) for k in range(3)]
    merged, whole = VC.merge_counts(*days), VC.value_counts(df, *cols)
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()
    a, b = (tuple(VC.describe_counts(c, ["x"]).first())[1:] for c in (merged, whole))
    assert np.allclose(a, b, rtol=1e-12)


def test_missing_summary_equals_the_scan(spark):
    df = spark_frame(spark, frame())
    counts = VC.value_counts(df, ["x"], ["s"], ["id", "big", "gone"], rows=True)
    assert VC.missing_of_rows(counts, 5).collect() == validate.missing_summary(df).collect()
    key = lambda r: r.column_name
    got = VC.missing_by_column(counts, df.columns).select("column_name", "missing", "missing_share", "n_rows").collect()
    assert sorted(got, key=key) == sorted(validate.missing_counts(df).collect(), key=key)


@pytest.mark.parametrize("what", ["describe", "quality", "outliers", "distinct", "impute"])
def test_a_profile_reads_its_table_once(spark, what):
    df, read = counted(spark, spark_frame(spark, frame()))
    if what == "impute":
        clean.median_fill_values(df, ["x", "big"])
    else:
        {"describe": lambda: profile.describe(df, ["x", "big"]), "quality": lambda: profile.quality_profile(df, "t", ["x"], ["s"]),
         "outliers": lambda: profile.iqr_outliers(df, ["x"]), "distinct": lambda: profile.distinct_profile(df, ["s"])}[what]().collect()
    assert read() == 500


def test_preparation_reads_the_raw_table_once(spark):
    pdf = frame()
    df, read = counted(spark, spark_frame(spark, pdf))
    p = prepare(df, ["big", "nowhere"], ["x"], ["s", "gone"], required=["x"], min_rows=100)
    check, quality, desc = p.validation.first(), p.quality.first(), p.describe.first()
    assert read() == 500
    assert check.n_rows == 500 and check.missing_cells == pdf.isna().sum().sum() and check.required_present
    assert (quality.missing_before, quality.missing_after) == (pdf.isna().sum().sum(), 0)
    filled = pdf["x"].fillna(pdf["x"].median())
    assert desc["count"] == 500 and abs(desc["mean"] - filled.mean()) < 1e-9 and abs(desc["p25"] - filled.quantile(0.25)) < 1e-9
    assert p.fill_values["gone"] == C.UNKNOWN_CATEGORY and p.table.where("x is null or s is null or gone is null").isEmpty()


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    p = prepare(df, [], ["x"], ["s"])
    assert p.validation.first().n_rows == 0 and p.quality.first().missing_before == 0
    assert [tuple(r)[:3] for r in p.describe.collect()] == [("x", 0, None)]
    assert p.fill_values == {"s": C.UNKNOWN_CATEGORY}
    assert [tuple(r) for r in profile.distinct_profile(df, ["s"]).collect()] == [("s", 0, None)]
