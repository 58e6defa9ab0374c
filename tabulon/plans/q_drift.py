"""Queries: drift and retrain decisions (DRF1-7, DEC1-2, TST1 on a pair)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.config import DEFAULT_DRIFT, DriftConfig
from tabulon.operators import drift as D
from tabulon.operators import validate as V
from tabulon.plans.catalog import query
from tabulon.sources import supplied as SP
from tabulon.sources.tables import read_table

LI_SPLIT = "1999-01-01 00:00:00"
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CAT = ["l_returnflag", "l_linestatus"]


def _lineitem_pair(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_shipdate", *LI_NUM, *LI_CAT)
    t = F.lit(LI_SPLIT).cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < t), li.where(F.col("l_shipdate") >= t)


LI_PAIR_SQL = f"""ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{LI_SPLIT}'),
cur AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{LI_SPLIT}')"""


def _numeric_sql(cols) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value, 1 AS a, 0 AS b FROM ref "
        f"UNION ALL SELECT '{c}', CAST({c} AS DOUBLE), 0, 1 FROM cur" for c in cols)
    return f"""nlong AS (SELECT * FROM ({long}) WHERE value IS NOT NULL),
ncounts AS (SELECT column_name, value, sum(a) AS a, sum(b) AS b FROM nlong GROUP BY column_name, value),
ntot AS (SELECT column_name, CAST(sum(a) AS BIGINT) AS n_ref, CAST(sum(b) AS BIGINT) AS n_cur,
         stddev_pop(CASE WHEN a = 1 THEN value END) AS ref_std FROM nlong GROUP BY column_name),
nrun AS (SELECT column_name, value,
   sum(a) OVER (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_run,
   sum(b) OVER (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b_run,
   lead(value) OVER (PARTITION BY column_name ORDER BY value) AS next_value FROM ncounts),
nper AS (SELECT r.column_name, max(abs(a_run / n_ref - b_run / n_cur)) AS ks,
   sum(abs(a_run / n_ref - b_run / n_cur) * coalesce(next_value - value, 0)) AS wasserstein
   FROM nrun r JOIN ntot t ON r.column_name = t.column_name GROUP BY r.column_name),
ndrift AS (SELECT t.column_name, n_ref, n_cur, ks, {D.ks_p_value_sql('ks', 'n_ref', 'n_cur')} AS ks_p_value,
   wasserstein, wasserstein / greatest(coalesce(ref_std, 0), 0.001) AS wasserstein_norm
   FROM ntot t LEFT JOIN nper p ON t.column_name = p.column_name)"""


def _categorical_sql(cols) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), '<null>') AS value, 1 AS a, 0 AS b FROM ref "
        f"UNION ALL SELECT '{c}', coalesce(CAST({c} AS VARCHAR), '<null>'), 0, 1 FROM cur" for c in cols)
    return f"""clong AS ({long}),
ccounts AS (SELECT column_name, value, sum(a) AS a, sum(b) AS b FROM clong GROUP BY column_name, value),
ctot AS (SELECT column_name, CAST(sum(a) AS BIGINT) AS n_ref, CAST(sum(b) AS BIGINT) AS n_cur,
         count(*) AS k FROM ccounts GROUP BY column_name),
cj AS (SELECT c.*, n_ref, n_cur, a / n_ref AS p, b / n_cur AS q FROM ccounts c JOIN ctot t ON c.column_name = t.column_name),
cdrift AS (SELECT column_name, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur, count(*) AS n_categories,
   sum(power(a - (a + b) * n_ref / (n_ref + n_cur), 2) / ((a + b) * n_ref / (n_ref + n_cur))
     + power(b - (a + b) * n_cur / (n_ref + n_cur), 2) / ((a + b) * n_cur / (n_ref + n_cur))) AS chi2,
   count(*) - 1 AS dof,
   sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                   + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS jensen_shannon,
   sum((greatest(q, {D.PSI_FLOOR}) - greatest(p, {D.PSI_FLOOR})) * ln(greatest(q, {D.PSI_FLOOR}) / greatest(p, {D.PSI_FLOOR}))) AS psi
   FROM cj GROUP BY column_name)"""


def _events_pair(spark, sf, drifted=False):
    return SP.reference_current(spark, sf, drifted)


NUM_OUT = ("column_name, n_ref, n_cur, round(ks, 6) AS ks, round(ks_p_value, 6) AS ks_p_value, "
           "round(wasserstein, 6) AS wasserstein, round(wasserstein_norm, 6) AS wasserstein_norm")
CAT_OUT = ("column_name, n_ref, n_cur, n_categories, round(chi2, 6) AS chi2, dof, "
           "round(jensen_shannon, 6) AS jensen_shannon, round(psi, 6) AS psi")


@query("drf1_ks_wasserstein", f"WITH {SP.refcur_sql(False)}, {_numeric_sql(['value'])} SELECT {NUM_OUT} FROM ndrift")
def drf1_ks_wasserstein(spark, sf):
    """DRF1 + DRF2: KS statistic / p-value and Wasserstein of events.value across the split."""
    ref, cur = _events_pair(spark, sf)
    return D.numeric_drift(ref, cur, ["value"])


@query("drf1_ks_wasserstein_drifted", f"WITH {SP.refcur_sql(True)}, {_numeric_sql(['value'])} SELECT {NUM_OUT} FROM ndrift")
def drf1_ks_wasserstein_drifted(spark, sf):
    """DRF1 + DRF2 on the drifted copy (current value × 1.2): drift must fire."""
    ref, cur = _events_pair(spark, sf, True)
    return D.numeric_drift(ref, cur, ["value"])


@query("drf2_numeric_drift_lineitem", f"WITH {LI_PAIR_SQL}, {_numeric_sql(LI_NUM)} SELECT {NUM_OUT} FROM ndrift")
def drf2_numeric_drift_lineitem(spark, sf):
    """DRF1 + DRF2 on four lineitem columns at once (one shuffle for all columns)."""
    ref, cur = _lineitem_pair(spark, sf)
    return D.numeric_drift(ref, cur, LI_NUM)


def _cat_select(df):
    return df.drop("chi2_p_value")


@query("drf3_chi_square_js", f"WITH {SP.refcur_sql(False)}, {_categorical_sql(['event_type'])} SELECT {CAT_OUT} FROM cdrift")
def drf3_chi_square_js(spark, sf):
    """DRF3 + DRF4: chi-square statistic, Jensen-Shannon distance and PSI of event_type."""
    ref, cur = _events_pair(spark, sf)
    return _cat_select(D.categorical_drift(ref, cur, ["event_type"]))


@query("drf4_js_drifted", f"WITH {SP.refcur_sql(True)}, {_categorical_sql(['event_type'])} SELECT {CAT_OUT} FROM cdrift")
def drf4_js_drifted(spark, sf):
    """DRF4 on the recoded copy: Jensen-Shannon must exceed the threshold."""
    ref, cur = _events_pair(spark, sf, True)
    return _cat_select(D.categorical_drift(ref, cur, ["event_type"]))


def chi2_sf_sql(x: str, dof: str, terms: int = 2000) -> str:
    """Chi-square survival function in SQL: 1 - P(dof/2, x/2) with the
    regularised lower gamma as a log-space series (any degrees of freedom)."""
    y, a = f"({x} / 2.0)", f"({dof} / 2.0)"
    series = (f"list_sum(list_transform(range({terms}), lambda n: "
              f"exp(-{y} + ({a} + n) * ln({y}) - lgamma({a} + n + 1))))")
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(least(1 - {series}, 1.0), 0.0) END"


@query("drf3_chi_square_p_value", f"""WITH {LI_PAIR_SQL}, {_categorical_sql(LI_CAT)}
SELECT column_name, n_ref, n_cur, n_categories, round(chi2, 6) AS chi2, dof,
  round({chi2_sf_sql('chi2', 'dof')}, 6) AS chi2_p_value,
  round(jensen_shannon, 6) AS jensen_shannon, round(psi, 6) AS psi FROM cdrift""")
def drf3_chi_square_p_value(spark, sf):
    """DRF3 with the p-value for lineitem's categories (odd and even degrees
    of freedom; the Python helper runs once per column result)."""
    ref, cur = _lineitem_pair(spark, sf)
    return D.categorical_drift(ref, cur, LI_CAT)


def _column_drift_sql(ref_cur: str, num, cat) -> str:
    parts = []
    if num:
        parts.append(f"""SELECT column_name, 'numeric' AS kind, n_ref, n_cur,
  'wasserstein_norm' AS test, wasserstein_norm AS score, CAST(0.1 AS DOUBLE) AS threshold,
  coalesce(wasserstein_norm >= 0.1, false) AS drifted
  FROM ndrift""")
    if cat:
        parts.append(f"""SELECT column_name, 'categorical' AS kind, n_ref, n_cur,
  'jensen_shannon' AS test, jensen_shannon AS score, CAST(0.1 AS DOUBLE) AS threshold,
  coalesce(jensen_shannon >= 0.1, false) AS drifted FROM cdrift""")
    ctes = [ref_cur]
    if num:
        ctes.append(_numeric_sql(num))
    if cat:
        ctes.append(_categorical_sql(cat))
    return "WITH " + ",\n".join(ctes) + ",\ncoldrift AS (" + " UNION ALL ".join(parts) + ")"


_COL_OUT = ("column_name, kind, n_ref, n_cur, test, round(score, 6) AS score, threshold, drifted, "
            "CASE WHEN n_cur = 0 THEN 'no_current_data' WHEN n_ref = 0 THEN 'no_reference_data' ELSE 'ok' END AS status")


@query("drf6_column_drift", _column_drift_sql(LI_PAIR_SQL, LI_NUM, LI_CAT) + f" SELECT {_COL_OUT} FROM coldrift")
def drf6_column_drift(spark, sf):
    """DRF6 per column: the chosen test, its score and the drift flag."""
    ref, cur = _lineitem_pair(spark, sf)
    return D.column_drift(ref, cur, LI_NUM, LI_CAT)


_DS_SQL = """ds AS (SELECT count(*) AS n_columns, count(*) FILTER (WHERE drifted) AS n_drifted,
   coalesce(count(*) FILTER (WHERE drifted) / count(*), 0.0) AS share_drifted,
   coalesce(count(*) FILTER (WHERE drifted) / count(*), 0.0) >= 0.5 AS dataset_drift,
   coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE drifted), '') AS drifted_columns
   FROM coldrift)"""


@query("drf6_dataset_drift", _column_drift_sql(LI_PAIR_SQL, LI_NUM, LI_CAT) + ", " + _DS_SQL +
       " SELECT n_columns, n_drifted, round(share_drifted, 6) AS share_drifted, dataset_drift, drifted_columns FROM ds")
def drf6_dataset_drift(spark, sf):
    """DRF6: dataset drift = share of drifted columns >= 0.5, with the names."""
    ref, cur = _lineitem_pair(spark, sf)
    return D.dataset_drift(D.column_drift(ref, cur, LI_NUM, LI_CAT))


@query("drf6_dataset_drift_events", _column_drift_sql(SP.refcur_sql(True), ["value"], ["event_type"]) + ", "
       + _DS_SQL + " SELECT n_columns, n_drifted, round(share_drifted, 6) AS share_drifted, dataset_drift, drifted_columns FROM ds")
def drf6_dataset_drift_events(spark, sf):
    """DRF6 on the drifted events copy (both columns drift)."""
    ref, cur = _events_pair(spark, sf, True)
    return D.dataset_drift(D.column_drift(ref, cur, ["value"], ["event_type"]))


@query("drf7_drift_summary", _column_drift_sql(LI_PAIR_SQL, LI_NUM, LI_CAT) + ", " + _DS_SQL + """
SELECT dataset_drift, n_drifted, n_columns, round(share_drifted, 6) AS share_drifted,
  CASE WHEN drifted_columns = '' THEN NULL
       WHEN len(string_split(drifted_columns, ',')) > 5
       THEN concat(array_to_string(list_slice(string_split(drifted_columns, ','), 1, 5), ', '), ' and ',
                   CAST(len(string_split(drifted_columns, ',')) - 5 AS VARCHAR), ' more')
       ELSE array_to_string(string_split(drifted_columns, ','), ', ') END AS drifted_preview,
  CASE WHEN dataset_drift THEN 'retrain' ELSE 'monitor' END AS action,
  (SELECT count(*) FROM ref) AS reference_samples, (SELECT count(*) FROM cur) AS current_samples FROM ds""")
def drf7_drift_summary(spark, sf):
    """DRF7: drift summary with the action retrain / monitor."""
    ref, cur = _lineitem_pair(spark, sf)
    seen = D.pair_counts(ref, cur, LI_NUM, LI_CAT)
    return D.drift_summary(D.dataset_drift(D.column_drift(ref, cur, LI_NUM, LI_CAT, counts=seen)), seen)


@query("drf5_target_drift", _column_drift_sql(LI_PAIR_SQL, [], ["l_returnflag"]) + f" SELECT {_COL_OUT} FROM coldrift")
def drf5_target_drift(spark, sf):
    """DRF5: drift of the target column (l_returnflag as the class label)."""
    ref, cur = _lineitem_pair(spark, sf)
    return D.target_drift(ref, cur, "l_returnflag")


_TESTS_SQL = """tests AS (
  SELECT count(*) FILTER (WHERE c_acctbal IS NULL) AS m1, count(*) FILTER (WHERE c_mktsegment IS NULL) AS m2,
         count(*) FILTER (WHERE c_acctbal IS NULL OR c_mktsegment IS NULL) AS rows_missing, count(*) AS n FROM entity),
tcount AS (SELECT (CASE WHEN ((m1 > 0)::INT + (m2 > 0)::INT) < 5 THEN 0 ELSE 1 END)
                + (CASE WHEN rows_missing / n < 0.1 THEN 0 ELSE 1 END)
                + (CASE WHEN rows_missing <= 0 THEN 0 ELSE 1 END) AS tests_failed FROM tests)"""


@query("dec1_retrain_decision", _column_drift_sql(LI_PAIR_SQL, LI_NUM, LI_CAT) + ", " + _DS_SQL + ", "
       + SP.ENTITY_SQL + ", " + _TESTS_SQL + """,
td AS (SELECT coalesce(bool_or(drifted), false) AS target_drift FROM coldrift WHERE column_name = 'l_returnflag')
SELECT dataset_drift, target_drift, CAST(tests_failed AS BIGINT) AS tests_failed,
  dataset_drift OR target_drift OR tests_failed > 0 AS retrain_needed,
  concat_ws('; ', CASE WHEN dataset_drift THEN 'Dataset drift detected' END,
                  CASE WHEN target_drift THEN 'Target drift detected' END,
                  CASE WHEN tests_failed > 0 THEN concat(CAST(tests_failed AS VARCHAR), ' data quality tests failed') END) AS reasons
FROM ds, td, tcount""")
def dec1_retrain_decision(spark, sf):
    """DEC1: retrain if dataset drift, target drift or failed data tests; reasons listed."""
    ref, cur = _lineitem_pair(spark, sf)
    cd = D.column_drift(ref, cur, LI_NUM, LI_CAT)
    ds = D.dataset_drift(cd)
    td = cd.where(F.col("column_name") == "l_returnflag")
    ent = SP.entity_table(spark, sf).select("c_acctbal", "c_mktsegment")
    return D.retrain_decision(ds, td, V.test_suite(ent))


def _moved_pair(spark, sf):
    """The lineitem pair with a moved target: half of the current returns recoded."""
    ref, cur = _lineitem_pair(spark, sf)
    moved = F.when(F.col("l_quantity") > 25, "R").otherwise(F.col("l_returnflag"))
    gaps = F.when(F.col("l_quantity") < 8, None).otherwise(F.col("l_tax"))
    return ref, cur.withColumn("l_returnflag", moved).withColumn("l_tax", gaps)


_MOVED_SQL = LI_PAIR_SQL.replace("cur AS (SELECT * FROM lineitem", """cur AS (SELECT * REPLACE (
  CASE WHEN l_quantity > 25 THEN 'R' ELSE l_returnflag END AS l_returnflag, CASE WHEN l_quantity < 8 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem""")


@query("dec2_validation_summary", _column_drift_sql(_MOVED_SQL, LI_NUM, LI_CAT) + ", " + _DS_SQL + """,
t AS (SELECT bool_or(drifted) AS target_drift FROM coldrift WHERE column_name = 'l_returnflag'),
q AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_tax IS NULL) AS m FROM cur),
f AS (SELECT CAST((m / n >= 0.1)::INT + (m > 0)::INT AS BIGINT) AS tests_failed FROM q)
SELECT dataset_drift, target_drift, tests_failed, dataset_drift OR target_drift OR tests_failed > 0 AS retrain_needed,
  concat_ws('; ', CASE WHEN dataset_drift THEN 'Dataset drift detected' END, CASE WHEN target_drift THEN 'Target drift detected' END,
                  CASE WHEN tests_failed > 0 THEN concat(CAST(tests_failed AS VARCHAR), ' data quality tests failed') END) AS reasons,
  (SELECT count(*) FROM ref) AS reference_rows, (SELECT count(*) FROM cur) AS current_rows,
  7 AS reference_columns, 7 AS current_columns FROM ds, t, f""")
def dec2_validation_summary(spark, sf):
    """DEC2: validation summary row (flags, reasons, counts of both tables) of a pair
    whose target has drifted and whose current table misses values."""
    ref, cur = _moved_pair(spark, sf)
    seen = D.pair_counts(ref, cur, LI_NUM, LI_CAT)
    ds = D.dataset_drift(D.column_drift(ref, cur, LI_NUM, LI_CAT, counts=seen))
    td = D.target_drift(ref, cur, "l_returnflag", counts=seen)
    return D.validation_summary(D.retrain_decision(ds, td, V.test_suite(cur)), ref, cur, seen)


@query("drf6_column_drift_p_value", f"""WITH {LI_PAIR_SQL}, {_numeric_sql(LI_NUM)}, {_categorical_sql(LI_CAT)},
s AS (SELECT column_name, 'numeric' AS kind, n_ref, n_cur, 'ks' AS test, ks_p_value AS score FROM ndrift
  UNION ALL SELECT column_name, 'categorical', n_ref, n_cur, 'chi_square', {chi2_sf_sql('chi2', 'dof')} FROM cdrift)
SELECT column_name, kind, n_ref, n_cur, test, round(score, 6) AS score, CAST(0.05 AS DOUBLE) AS threshold,
  coalesce(score < 0.05, false) AS drifted, 'ok' AS status FROM s""")
def drf6_column_drift_p_value(spark, sf):
    """DRF6 decided by the p-values of the KS and chi-square tests."""
    ref, cur = _lineitem_pair(spark, sf)
    return D.column_drift(ref, cur, LI_NUM, LI_CAT, DriftConfig(decide_by="p_value"))


@query("flt5_drift_segment_gate", f"""WITH {SP.refcur_sql(False)},
c AS (SELECT 'value_' || event_type AS column_name, value AS v, sum(a) AS a, sum(b) AS b FROM
        (SELECT event_type, value, 1 AS a, 0 AS b FROM ref UNION ALL SELECT event_type, value, 0 AS a, 1 AS b FROM cur)
      WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb,
        lead(v) OVER w - v AS step, sum(a * v) OVER p / nullif(sum(a) OVER p, 0) AS m FROM c
      WINDOW w AS (PARTITION BY column_name ORDER BY v), p AS (PARTITION BY column_name)),
d AS (SELECT column_name, CAST(any_value(na) AS BIGINT) AS n_ref, CAST(any_value(nb) AS BIGINT) AS n_cur,
        sum(abs(ca / na - cb / nb) * coalesce(step, 0)) / greatest(coalesce(sqrt(sum(a * (v - m) * (v - m)) / any_value(na)), 0), 0.001) AS score
      FROM r GROUP BY column_name)
SELECT column_name, n_ref, n_cur, round(score, 6) AS score,
  CASE WHEN n_ref < 50 OR n_cur < 50 THEN 'insufficient' ELSE 'ok' END AS status,
  coalesce(score >= 0.1, false) AND NOT (n_ref < 50 OR n_cur < 50) AS drifted FROM d""")
def flt5_drift_segment_gate(spark, sf):
    """FLT5 (drift side): drift of value within every event type the tables
    hold; a segment under 50 rows on either side is ``insufficient``."""
    ref, cur = _events_pair(spark, sf)
    per = D.segment_drift(ref, cur, "value", "event_type").select(
        "column_name", "n_ref", "n_cur", F.col("wasserstein_norm").alias("score"),
        F.coalesce(F.col("wasserstein_norm") >= DEFAULT_DRIFT.distance_cut, F.lit(False)).alias("drifted"))
    return D.with_sample_gate(per).select("column_name", "n_ref", "n_cur", "score", "status", "drifted")


@query("drf3_chi_square_p_value_events", f"""WITH {SP.refcur_sql(False)}, {_categorical_sql(['event_type'])}
SELECT column_name, round(chi2, 6) AS chi2, dof,
  round(exp(-chi2 / 2) * list_sum(list_transform(range(dof // 2), lambda i: pow(chi2 / 2, i) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE))), 6)
    AS chi2_p_value
FROM cdrift""")
def drf3_chi_square_p_value_events(spark, sf):
    """DRF3 p-value on event_type (dof 4, even: the oracle uses the closed form
    e^(-x/2) Σ_{i<dof/2} (x/2)^i / i!)."""
    ref, cur = _events_pair(spark, sf)
    return D.categorical_drift(ref, cur, ["event_type"]).select("column_name", "chi2", "dof", "chi2_p_value")
