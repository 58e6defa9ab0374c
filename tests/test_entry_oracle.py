"""The driver contract: entry() and every registered query against its DuckDB
oracle on the smallest supplied tables (the same check the driver runs)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tabulon.plans.catalog import load_all
from tabulon.sources import supplied as SP
from tabulon.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SLOW = ("mdl6", "mdl7", "exp1_perm", "str1", "mdl8")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and {r["column_name"] for r in rows} == {"c_acctbal", "n_orders", "total_spend"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)),
                        key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in load_all().items() if q.sql))
def test_query_matches_oracle(spark, duck, name):
    s = E.queries()[name](spark, SF).toPandas()
    d = duck.execute(E.oracle_sql()[name]).df()
    sc, sr = _rows(s)
    dc, dr = _rows(d)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


@pytest.mark.parametrize("name", sorted(n for n, q in load_all().items() if not q.sql))
def test_rows_only_query_runs(spark, name):
    if name.startswith(SLOW):
        pytest.skip("model training: exercised by tools/oracle_check.py")
    assert E.queries()[name](spark, SF).count() >= 0


def test_scores_at_the_pole_of_their_rule(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(i, f"c{i}", i % 5, b, "AUTO") for i, b in enumerate([-60.0, 1.0, -60.0, -59.99, None, -60.01, 60.0] * 6)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(sf + "/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 30 AS o_custkey, 'O' AS o_orderstatus, 10.5D AS o_totalprice, TIMESTAMP_NTZ '2000-01-01 00:00:00' AS o_orderdate, "
              "'1-URGENT' AS o_orderpriority FROM range(60)").write.parquet(sf + "/orders.parquet")
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-10 00:00:00' AS ts, id AS user_id, 'view' AS event_type, id * 25.0D - 75.0D AS value "
              "FROM range(6)").write.parquet(sf + "/events.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    got, want = (_rows(x) for x in (E.queries()["src3_batch_bodies"](spark, sf).toPandas(), con.execute(E.oracle_sql()["src3_batch_bodies"]).df()))
    assert got == want and any(-math.inf in r for r in got[1])
    log = SP.prediction_log(spark, sf).select("prediction_id", "churn_probability")
    assert _rows(log.toPandas()) == _rows(con.execute(f"WITH {SP.PREDLOG_SQL} SELECT prediction_id, churn_probability FROM predlog").df())


def test_query_keys_trace_to_inventory():
    import re
    ids = ("src", "snk", "prj", "flt", "cst", "imp", "val", "jon", "agg", "win", "ord", "smp", "scl",
           "drf", "tst", "dec", "alr", "fea", "mdl", "sco", "exp", "evl", "reg", "str", "prep")
    for name, q in load_all().items():
        assert re.match(r"^[a-z]+[0-9]*_", name) and name.split("_")[0].rstrip("0123456789") in ids, name
        assert q.build.__doc__, name
