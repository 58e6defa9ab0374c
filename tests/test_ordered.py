"""The two-level ordered scans against plain single-machine computations."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabulon.operators.ordered import (exact_quantiles, first_after, hash_order, key_ranges, lagged, row_numbers, running_sums,
                                       strata_ranks, top_n_per_key, trailing)


def _frame(spark, n=400, groups=3, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.integers(0, groups, n).astype("int64"),
                        "v": np.round(rng.normal(0, 10, n), 1),   # many ties
                        "w": rng.integers(0, 5, n).astype("int64")})
    return pdf, spark.createDataFrame(pdf)


def test_running_sums_match_cumsum(spark):
    pdf, df = _frame(spark)
    agg = df.groupBy("g", "v").agg(F.sum("w").alias("w"))
    for desc in (False, True):
        out = running_sums(agg, "v", ["w"], ["g"], descending=desc, n_buckets=5).toPandas()
        exp = pdf.groupby(["g", "v"], as_index=False)["w"].sum().sort_values(["g", "v"], ascending=[True, not desc])
        exp["w_run"] = exp.groupby("g")["w"].cumsum()
        exp["next_value"] = exp.groupby("g")["v"].shift(-1)
        m = out.merge(exp, on=["g", "v"], suffixes=("", "_e"))
        assert len(m) == len(exp)
        assert (m["w_run"] == m["w_run_e"]).all()
        assert ((m["next_value"] == m["next_value_e"]) | (m["next_value"].isna() & m["next_value_e"].isna())).all()


def test_running_sums_without_groups(spark):
    pdf, df = _frame(spark)
    agg = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    out = running_sums(agg, "v", ["n"], n_buckets=7).orderBy("v").toPandas()
    assert (out["n_run"].to_numpy() == np.cumsum(out["n"].to_numpy())).all()


def test_exact_quantiles_match_numpy(spark):
    pdf, df = _frame(spark)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = exact_quantiles(df, "v", probs, ["g"]).toPandas()
    for (g, q), val in out.set_index(["g", "q"])["value"].items():
        exp = np.percentile(pdf.loc[pdf.g == g, "v"], q * 100)
        assert abs(val - exp) < 1e-9


def test_even_count_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert exact_quantiles(df, "v", [0.5]).first()["value"] == 1.5


def test_quantiles_skip_null_and_empty_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", 3.0), ("b", None)], "g string, v double")
    out = {r["g"]: r["value"] for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert out == {"a": 3.0}


def test_strata_ranks_are_hash_order(spark):
    pdf, df = _frame(spark)
    df = df.withColumn("k", F.monotonically_increasing_id())
    r = strata_ranks(df, "g", "k", 42, digits=1).toPandas()
    ref = df.select("g", "k", hash_order(42, "k").alias("h")).toPandas()
    ref["rank"] = ref.sort_values(["h", "k"]).groupby("g").cumcount() + 1
    m = r.merge(ref, on=["g", "k"])
    assert (m["_rank"] == m["rank"]).all()
    assert (r.groupby("g")["_rank"].max() == r.groupby("g").size()).all()


def test_top_n_per_key_matches_row_number(spark):
    pdf, df = _frame(spark)
    df = df.withColumn("k", F.monotonically_increasing_id())
    out = top_n_per_key(df, ["g"], [F.col("v").desc(), F.col("k")], 3).toPandas()
    exp = pdf.assign(k=df.toPandas()["k"]).sort_values(["v", "k"], ascending=[False, True]).groupby("g").head(3)
    assert sorted(out["k"]) == sorted(exp["k"])


def _as_of(rows):
    """The first target of the key at or after each row's time."""
    out = {}
    for k, t, i, target in rows:
        if k is not None and t is not None:
            later = [(u, j) for k2, u, j, tg in rows if k2 == k and tg and u is not None and u >= t]
            out[i] = min(later) if later else None
    return out


def test_first_after_with_and_without_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(t), i, bool(x < 0.2)) for i, (k, t, x) in enumerate(zip(
        np.where(rng.random(1500) < 0.6, 0, rng.integers(1, 30, 1500)), rng.integers(0, 400, 1500), rng.random(1500)))]
    rows += [(None, 5, 2000, True), (0, None, 2001, False), (99, 7, 2002, False)]
    df = spark.createDataFrame(rows, "k int, t int, i int, is_target boolean").withColumn("target", F.when(F.col("is_target"), F.struct("t", "i")))
    assert key_ranges(df, "k", "t", 10_000) is None or key_ranges(df, "k", "t", 10_000).count() == 0
    assert key_ranges(df, "k", "t", 40).where("k = 0").select(F.size("_bounds")).first()[0] > 10
    for per_range in (None, 40, 7):
        got = {r.i: tuple(r.first_after) if r.first_after else None for r in first_after(df, "k", "t", "target", per_range).collect()}
        assert got == _as_of(rows)


def test_row_numbers_split_equal_values(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("v"), F.col("id")).repartition(7)
    got = row_numbers(df, [F.col("v"), F.col("id")])
    pdf = got.toPandas().sort_values(["v", "id"])
    assert pdf["row_number"].tolist() == list(range(1, 4001)) and list(pdf.columns) == ["v", "id", "row_number"]
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    assert row_numbers(df.limit(0), [F.col("v")]).count() == 0


def test_lagged_and_trailing_match_windows(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300).astype("int64"), "t": rng.permutation(3000)[:300].astype("int64") - 500,
                        "x": rng.integers(0, 9, 300).astype("int64")}).sort_values(["g", "t"])
    df = spark.createDataFrame(pdf)
    for keys in ([], ["g"]):
        by = pdf.sort_values(keys + ["t"])
        prev = by.groupby("g")["x"].shift() if keys else by["x"].shift()
        got = lagged(df, "t", ["x"], keys, width=37).toPandas().sort_values(keys + ["t"])
        assert got["previous_x"].fillna(-1).tolist() == prev.fillna(-1).tolist()
        want = [int(by.loc[(by["t"] <= t) & (by["t"] >= t - 50) & ((by["g"] == g) | (not keys)), "x"].sum()) for g, t in zip(by["g"], by["t"])]
        for width in (51, 1000):
            got = trailing(df, "t", 50, {"s": F.sum("x")}, keys, width).toPandas().sort_values(keys + ["t"])
            assert got["s"].tolist() == want and len(got) == 300


def test_a_row_meets_few_of_the_bounds(spark):
    from tabulon.operators import ordered
    rows = [(float(v), n) for v in (-3, 0, 0.5, 1, 7, 199, 200, 500) for n in range(0, 40, 3)] + [(None, 2), (float("nan"), 5)]
    d = spark.createDataFrame(rows, "_o double, n int").withColumn("_bounds", F.expr("transform(sequence(1, n), i -> double(i div 2))"))
    d = d.withColumn("_bounds", F.when(F.col("n") > 0, F.col("_bounds")).otherwise(F.array().cast("array<double>")))
    plain = F.size(F.filter("_bounds", lambda b: b < F.col("_o")))
    assert d.where(plain != ordered._bounds_below("_bounds", "_o", 39)).count() == 0
    sums = ordered.running_sums(spark.range(50).select(F.col("id").alias("v"), F.lit(1).alias("n")), "v", ["n"], n_buckets=16)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate([8,4,2,1]" in plan and "filter(_bounds" not in plan
    assert [r.n_run for r in sums.orderBy("v").collect()] == list(range(1, 51))
