"""Queries: scans, cleaning, validation, profiles (SRC, PRJ, CST, IMP, VAL, AGG1-6, 15, 19, 21, TST1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.functions import scalar as S
from tabulon.operators import clean, profile, validate
from tabulon.operators import validate as V
from tabulon.plans.catalog import query, ts_text, ts_text_sql
from tabulon.plans.preparation import prepare
from tabulon.sources import supplied as SP
from tabulon.sources.tables import read_table

E = SP.ENTITY_SQL
NUM = list(SP.ENTITY_NUMERIC)
CAT = list(SP.ENTITY_CATEGORICAL)
DROP = ("c_name", "Customer ID", "Lat Long")


def _entity(spark, sf):
    return SP.entity_table(spark, sf).withColumn("last_order", ts_text("last_order"))


ENTITY_COLS_SQL = (f"c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment, "
                   f"n_orders, round(total_spend, 6) AS total_spend, {ts_text_sql('last_order')} AS last_order, churn")


@query("src2_entity_table", f"WITH {E} SELECT {ENTITY_COLS_SQL} FROM entity")
def src2_entity_table(spark, sf):
    """SRC2: parquet scans → the entity table (customer ⟕ aggregated orders)."""
    return _entity(spark, sf)


@query("agg1_validate", f"""WITH {E},
m AS (SELECT count(*) AS n_rows,
  CAST(sum((c_custkey IS NULL)::INT + (c_name IS NULL)::INT + (c_nationkey IS NULL)::INT
   + (c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT + (n_orders IS NULL)::INT
   + (total_spend IS NULL)::INT + (last_order IS NULL)::INT + (churn IS NULL)::INT) AS BIGINT) AS missing_cells
  FROM entity)
SELECT n_rows, 9 AS n_columns, missing_cells, round(missing_cells / (n_rows * 9.0), 6) AS missing_share,
  n_rows >= 1000 AS has_min_rows, missing_cells / (n_rows * 9.0) <= 0.3 AS missing_ok,
  false AS required_present, 'Monthly Charges, Total Charges, Tenure Months, Churn' AS missing_required,
  false AS is_valid FROM m""")
def agg1_validate(spark, sf):
    """AGG1: rows, missing share, required columns, overall flag."""
    return validate.validate_table(SP.entity_table(spark, sf))


@query("prj1_drop_columns", f"WITH {E} SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, "
       f"c_mktsegment, n_orders, round(total_spend, 6) AS total_spend, {ts_text_sql('last_order')} AS last_order, "
       f"churn FROM entity")
def prj1_drop_columns(spark, sf):
    """PRJ1: drop listed columns that exist (the rest are reported)."""
    df, report = clean.drop_listed(_entity(spark, sf), DROP)
    assert report.not_found == ("Customer ID", "Lat Long")
    return df


_MED = ("(SELECT quantile_cont(c_acctbal, 0.5) FROM entity)", "(SELECT quantile_cont(total_spend, 0.5) FROM entity)")


@query("imp1_median_fill", f"""WITH {E}
SELECT c_custkey, round(coalesce(c_acctbal, {_MED[0]}), 6) AS c_acctbal,
       n_orders, round(coalesce(total_spend, {_MED[1]}), 6) AS total_spend FROM entity""")
def imp1_median_fill(spark, sf):
    """IMP1: numeric nulls → exact interpolated column median."""
    ent = SP.entity_table(spark, sf).select("c_custkey", *NUM)
    values = clean.median_fill_values(ent, NUM)
    return clean.fill(ent, values)


_MODE = ("(SELECT c_mktsegment FROM entity WHERE c_mktsegment IS NOT NULL "
         "GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)")


@query("imp2_mode_fill", f"""WITH {E}
SELECT c_custkey, coalesce(c_mktsegment, {_MODE}) AS c_mktsegment FROM entity""")
def imp2_mode_fill(spark, sf):
    """IMP2: text nulls → most frequent value, smallest on ties."""
    ent = SP.entity_table(spark, sf).select("c_custkey", *CAT)
    return clean.fill(ent, clean.mode_fill_values(ent, CAT))


def _describe_sql(table: str, cols) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, "
            f"round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM {table}")
    return " UNION ALL ".join(parts)


DESC_COLS = ["c_acctbal", "n_orders", "total_spend", "c_nationkey", "churn"]


@query("agg3_describe", f"WITH {E} {_describe_sql('entity', DESC_COLS)}")
def agg3_describe(spark, sf):
    """AGG3: count, mean, std, min, quartiles (exact), max per numeric column."""
    return profile.describe(SP.entity_table(spark, sf), DESC_COLS)


_PREP_SQL = f"""{E},
prepared AS (
  SELECT c_custkey, c_nationkey, coalesce(c_acctbal, {_MED[0]}) AS c_acctbal,
         coalesce(c_mktsegment, {_MODE}) AS c_mktsegment, n_orders,
         coalesce(total_spend, {_MED[1]}) AS total_spend, last_order, churn
  FROM entity)"""


@query("prep_describe_prepared", f"WITH {_PREP_SQL} {_describe_sql('prepared', NUM)}")
def prep_describe_prepared(spark, sf):
    """Entry 1 end to end: validate → drop → impute (median/mode) → describe."""
    p = prepare(SP.entity_table(spark, sf), DROP, NUM, CAT,
                required=C.REQUIRED_COLUMNS, min_rows=C.MIN_SAMPLES,
                max_missing_share=C.MAX_MISSING_SHARE)
    return p.describe


# --- requests: decode, validate, map to model columns ---------------------------

from tabulon.operators import score as SC  # noqa: E402
from tabulon.sources.tables import REQUEST_FIELDS, decode_requests  # noqa: E402

REQ = f"{E}, {SP.REQUEST_SQL}"
_ABSENT_DOUBLES = ("avg_monthly_gb_download", "avg_monthly_long_distance_charges",
                   "total_extra_data", "total_long_distance", "total_revenue")
_LONGS = ("tenure_months", "age", "satisfaction_score")
_DOUBLES = ("monthly_charges", "total_charges", "cltv", "population")
_NEVER_SENT = ("streaming_tv", "streaming_movies", "streaming_music", "unlimited_data")


def _request_column_sql(name: str, default) -> str:
    """The SQL twin of one decoded request field (defaults as in SRC3)."""
    if name == "multiple_lines":
        return f"coalesce({name}, '{default}') AS {name}"
    if name in _NEVER_SENT:
        return f"'{default}' AS {name}"          # not in the fixture's requests: default only
    if name in _ABSENT_DOUBLES:
        return f"CAST(NULL AS DOUBLE) AS {name}"
    if name in _LONGS:
        return f"CAST({name} AS BIGINT) AS {name}"
    if name in _DOUBLES:
        return f"round({name}, 6) AS {name}"
    return name


_REQ_COLS = ", ".join(["customer_id"] + [_request_column_sql(n, d) for n, _, d in REQUEST_FIELDS])


def _requests(spark, sf):
    return decode_requests(SP.request_table(spark, sf))


@query("src3_decode_requests", f"WITH {REQ} SELECT {_REQ_COLS} FROM req")
def src3_decode_requests(spark, sf):
    """SRC3: JSON request bodies → typed columns, optional fields defaulted."""
    return _requests(spark, sf)


@query("src3_batch_bodies", f"""WITH {REQ},
b AS (SELECT *, customer_id // 10 AS body, row_number() OVER (PARTITION BY customer_id // 10 ORDER BY customer_id) - 1 AS item FROM req),
p AS (SELECT *, monthly_charges / (monthly_charges + 60.0) AS p, body % 3 <> 1 AS probs, body % 4 = 2 AS expl FROM b)
SELECT body, item AS item_index, 'batch_' || item AS customer_id, CAST(p >= 0.5 AS INTEGER) AS churn_prediction,
  CASE WHEN probs THEN round(p, 6) END AS churn_probability,
  CASE WHEN p < 0.3 THEN 'Low' WHEN p < 0.7 THEN 'Medium' ELSE 'High' END AS risk_level,
  CASE WHEN probs THEN round(greatest(p, 1 - p), 6) END AS confidence, 'rule-1' AS model_version,
  CASE WHEN expl THEN 'monthly_charges' END AS explanation FROM p WHERE monthly_charges IS NOT NULL""")
def src3_batch_bodies(spark, sf):
    """SRC3: batch bodies of ten requests, decoded to items with their position and
    scored by a stated rule; the bodies' flags hide probabilities and explanations."""
    req = SP.request_table(spark, sf)
    body = F.floor(F.col("customer_id") / 10).cast("long")
    items = req.groupBy(body.alias("body")).agg(F.array_sort(F.collect_list(F.struct("customer_id", "value"))).alias("items"))
    flags = F.concat(F.when(F.col("body") % 3 == 1, ', "include_probabilities": false').otherwise(""),
                     F.when(F.col("body") % 4 == 2, ', "include_explanations": true').otherwise(""))
    text = F.concat(F.lit('{"customers": ['), F.concat_ws(",", "items.value"), F.lit("]"), flags, F.lit("}"))
    rows = decode_requests(items.select("body", text.alias("value")), batch=True).where("monthly_charges is not null")
    rows = rows.withColumn("p", S.saturation("monthly_charges", 60.0)).withColumn("why", F.lit("monthly_charges"))
    return SC.batch_rows(rows, "p", "rule-1", explanation="why", keep=["body", "item_index"]).drop("timestamp")


@query("src2_float_range", "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value >= 40 AND value <= 60 AND NOT isnan(value)")
def src2_float_range(spark, sf):
    """SRC2: a range of a floating-point column that reaches the parquet scan."""
    return read_table(spark, sf, "events", between={"value": (40.0, 60.0)}).select("event_id", "user_id", "value")


def _rules_sql():
    from tabulon.operators.validate import REQUEST_RULE_NAMES
    conds = {
        "phone_service_required": "phone_service IS NOT NULL AND trim(phone_service) <> ''",
        "internet_service_required": "internet_service IS NOT NULL AND trim(internet_service) <> ''",
        "contract_required": "contract IS NOT NULL AND trim(contract) <> ''",
        "monthly_charges_positive": "monthly_charges > 0",
        "tenure_months_non_negative": "tenure_months >= 0",
        "cltv_non_negative": "cltv >= 0",
        "age_non_negative": "age >= 0",
        "population_non_negative": "population >= 0",
        "satisfaction_score_range": "satisfaction_score BETWEEN 1 AND 5",
    }
    assert list(REQUEST_RULE_NAMES) == list(conds)
    return conds


_RULES = _rules_sql()
_VIOL_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN coalesce({c}, false) THEN NULL ELSE '{n}' END" for n, c in _RULES.items()) + ")"


@query("val1_request_violations", f"""WITH {REQ}
SELECT customer_id, {_VIOL_SQL} AS violations, {_VIOL_SQL} = '' AS is_valid FROM req""")
def val1_request_violations(spark, sf):
    """VAL1: failed rule names per request and the valid flag."""
    v = V.violations(_requests(spark, sf), V.request_rules())
    return v.select("customer_id", F.array_join("violations", ",").alias("violations"), "is_valid")


@query("val1_valid_quarantine_split", f"""WITH {REQ}
SELECT CASE WHEN {_VIOL_SQL} = '' THEN 'valid' ELSE 'quarantine' END AS part, count(*) AS n FROM req GROUP BY 1""")
def val1_valid_quarantine_split(spark, sf):
    """VAL1: sizes of the valid and quarantined parts."""
    valid, bad = V.split_valid(_requests(spark, sf), V.request_rules())
    return (valid.select(F.lit("valid").alias("part")).unionByName(bad.select(F.lit("quarantine").alias("part")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n")))


@query("val2_violation_counts", f"WITH {REQ} " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS n_violations FROM req"
    for n, c in _RULES.items()))
def val2_violation_counts(spark, sf):
    """VAL2: schema violations counted per rule (zeros kept)."""
    return V.violation_counts(_requests(spark, sf), V.request_rules())


_FEAT_SQL = f"""customer_id,
  round(monthly_charges, 6) AS "Monthly Charge",
  round(CASE WHEN total_charges IS NULL OR total_charges = 0 THEN monthly_charges * tenure_months ELSE total_charges END, 6) AS "Total Charges",
  CAST(tenure_months AS BIGINT) AS "Tenure in Months",
  CAST(coalesce(phone_service = 'Yes', false) AS INTEGER) AS "Phone Service",
  CAST(coalesce(coalesce(multiple_lines, 'No') = 'Yes', false) AS INTEGER) AS "Multiple Lines",
  CAST(coalesce(internet_service = 'Yes', false) AS INTEGER) AS "Internet Service",
  0 AS "Streaming TV", 0 AS "Streaming Movies", contract AS "Contract", round(cltv, 6) AS "CLTV",
  CASE lower(internet_type) WHEN 'cable' THEN 1 WHEN 'dsl' THEN 2 WHEN 'fiber optic' THEN 3 ELSE 0 END AS "Internet Type",
  0 AS "Streaming Music", CAST(age AS BIGINT) AS "Age", CAST(NULL AS DOUBLE) AS "Avg Monthly GB Download",
  CAST(NULL AS DOUBLE) AS "Avg Monthly Long Distance Charges", round(population, 6) AS "Population",
  CAST(satisfaction_score AS BIGINT) AS "Satisfaction Score", CAST(NULL AS DOUBLE) AS "Total Extra Data Charges",
  CAST(NULL AS DOUBLE) AS "Total Long Distance Charges", CAST(NULL AS DOUBLE) AS "Total Revenue", 0 AS "Unlimited Data\""""


@query("prj5_request_features", f"WITH {REQ} SELECT {_FEAT_SQL} FROM req")
def prj5_request_features(spark, sf):
    """PRJ5 + CST2-6: request fields → model columns (flags, code maps, derived total)."""
    return SC.request_features(_requests(spark, sf))


@query("cst2_cst4_code_maps", f"""WITH {REQ}
SELECT customer_id,
  CASE lower(internet_type) WHEN 'cable' THEN 1 WHEN 'dsl' THEN 2 WHEN 'fiber optic' THEN 3 ELSE 0 END AS internet_type_code,
  CASE contract WHEN 'Month-to-month' THEN 0 WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 ELSE 0 END AS contract_code,
  CAST(coalesce(phone_service = 'Yes', false) AS INTEGER) AS phone_service_flag FROM req""")
def cst2_cst4_code_maps(spark, sf):
    """CST2 / CST3 / CST4: category code maps (unknown → 0) and Yes/No flags."""
    r = _requests(spark, sf)
    return r.select("customer_id",
                    S.code_map("internet_type", C.INTERNET_TYPE_CODES, case_insensitive=True).alias("internet_type_code"),
                    S.code_map("contract", C.CONTRACT_CODES).alias("contract_code"),
                    S.yes_to_int("phone_service").alias("phone_service_flag"))


@query("cst1_text_to_number", """SELECT l_orderkey, l_linenumber,
  round(TRY_CAST(trim(CASE WHEN l_linenumber = 1 THEN ' ' ELSE CAST(l_extendedprice AS VARCHAR) END) AS DOUBLE), 6) AS price
FROM lineitem""")
def cst1_text_to_number(spark, sf):
    """CST1: numbers stored as text with blanks → double, bad values → null."""
    m = SP.messy_lineitem(spark, sf)
    return m.select("l_orderkey", "l_linenumber", S.to_number("price_text").alias("price"))


@query("imp1_median_fill_lineitem", """SELECT l_orderkey, l_linenumber,
  round(coalesce(nullif(l_discount, 0.0), (SELECT quantile_cont(nullif(l_discount, 0.0), 0.5) FROM lineitem)), 6) AS l_discount
FROM lineitem""")
def imp1_median_fill_lineitem(spark, sf):
    """IMP1 on the largest table: nulled discounts filled with the exact median."""
    m = SP.messy_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_discount")
    return clean.fill(m, clean.median_fill_values(m, ["l_discount"]))


# --- projections and filters ------------------------------------------------------

@query("prj2_common_columns", f"WITH {E} SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM entity")
def prj2_common_columns(spark, sf):
    """PRJ2: keep the columns two tables share (entity vs customer)."""
    a, _ = clean.common_columns(SP.entity_table(spark, sf), read_table(spark, sf, "customer"))
    return a


@query("prj3_prj4_prj6_model_matrix", f"""WITH {E}
SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal,
  CAST(n_orders AS DOUBLE) AS n_orders, round(total_spend, 6) AS total_spend, churn FROM entity""")
def prj3_prj4_prj6_model_matrix(spark, sf):
    """PRJ3 + PRJ4 + PRJ6: numeric columns by type, integers to double, target kept as int."""
    from tabulon.roles import ColumnRoles
    ent = SP.entity_table(spark, sf)
    roles = ColumnRoles.infer(ent, key="c_custkey", target="churn")
    matrix = clean.split_target(ent.select("c_custkey", *roles.numeric, "churn"), "churn")
    return clean.ints_to_double(matrix, exclude=["c_custkey", "churn"])


def _disp_sql(c, numeric=True):
    if not numeric:
        return f"coalesce(CAST({c} AS VARCHAR), 'Not Available')"
    x = f"CAST({c} AS DOUBLE)"
    return (f"CASE WHEN {c} IS NULL THEN 'Not Available' WHEN {x} = floor({x}) "
            f"THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {x}) END")


@query("prj7_unpivot_record", f"""WITH {E}
SELECT c_custkey, 'C Acctbal' AS feature, {_disp_sql('c_acctbal')} AS display_value FROM entity
UNION ALL SELECT c_custkey, 'C Mktsegment', {_disp_sql('c_mktsegment', False)} FROM entity
UNION ALL SELECT c_custkey, 'N Orders', {_disp_sql('n_orders')} FROM entity
UNION ALL SELECT c_custkey, 'Total Spend', {_disp_sql('total_spend')} FROM entity""")
def prj7_unpivot_record(spark, sf):
    """PRJ7: every record as (feature, display value) rows, formatted for display."""
    return clean.unpivot_record(SP.entity_table(spark, sf), "c_custkey",
                                ["c_acctbal", "c_mktsegment", "n_orders", "total_spend"])


@query("flt1_pick_entity", f"WITH {E} SELECT {ENTITY_COLS_SQL} FROM entity WHERE c_custkey = 42")
def flt1_pick_entity(spark, sf):
    """FLT1: one customer by key (the filter reaches the parquet scan)."""
    return clean.pick_entity(_entity(spark, sf), "c_custkey", 42)


@query("flt4_time_slices", """WITH m AS (SELECT max(ts) AS hi FROM events)
SELECT 'reference' AS slice, count(*) AS n, round(avg(value), 6) AS avg_value FROM events, m WHERE ts >= hi - INTERVAL 30 DAY
UNION ALL SELECT 'current', count(*), round(avg(value), 6) FROM events, m WHERE ts >= hi - INTERVAL 7 DAY""")
def flt4_time_slices(spark, sf):
    """FLT4: last 30 days (reference) vs last 7 days (current) before the newest event."""
    ev = read_table(spark, sf, "events").select("ts", "value")
    ref, cur = clean.time_slices(ev, "ts")
    summ = lambda d, name: d.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value")) \
        .select(F.lit(name).alias("slice"), "n", "avg_value")
    return summ(ref, "reference").unionByName(summ(cur, "current"))


# --- profiles -------------------------------------------------------------------

@query("agg2_before_after", f"""WITH {_PREP_SQL},
b AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal IS NULL) + count(*) FILTER (WHERE c_mktsegment IS NULL)
        + count(*) FILTER (WHERE total_spend IS NULL) + count(*) FILTER (WHERE last_order IS NULL) AS m FROM entity)
SELECT n AS rows_before, 9 AS columns_before, n AS rows_after, 8 AS columns_after, 1 AS columns_dropped,
  CAST(m AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after, CAST(m AS BIGINT) AS missing_filled,
  'bigint:2,double:2,int:2,string:2,timestamp_ntz:1' AS types_before,
  'bigint:2,double:2,int:2,string:1,timestamp_ntz:1' AS types_after FROM b""")
def agg2_before_after(spark, sf):
    """AGG2: shapes and missing counts before and after preparation."""
    p = prepare(SP.entity_table(spark, sf), DROP, NUM, CAT)
    return p.quality


@query("agg4_missing_counts", f"WITH {E} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_share, count(*) AS n_rows FROM entity"
    for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_orders", "total_spend",
              "last_order", "churn"]))
def agg4_missing_counts(spark, sf):
    """AGG4: missing count and share per column (one pass)."""
    return V.missing_counts(SP.entity_table(spark, sf))


@query("agg4_missing_summary", f"""WITH {E}
SELECT count(*) AS n_rows, 9 AS n_columns,
  count(*) FILTER (WHERE c_acctbal IS NULL) + count(*) FILTER (WHERE c_mktsegment IS NULL) AS missing_cells,
  round((count(*) FILTER (WHERE c_acctbal IS NULL) + count(*) FILTER (WHERE c_mktsegment IS NULL)) / (count(*) * 9.0), 6) AS missing_share,
  (count(*) FILTER (WHERE c_acctbal IS NULL) > 0)::INT + (count(*) FILTER (WHERE c_mktsegment IS NULL) > 0)::INT AS columns_with_missing,
  count(*) FILTER (WHERE c_acctbal IS NULL OR c_mktsegment IS NULL) AS rows_with_missing,
  round(count(*) FILTER (WHERE c_acctbal IS NULL OR c_mktsegment IS NULL) / count(*), 6) AS rows_with_missing_share
FROM entity""")
def agg4_missing_summary(spark, sf):
    """AGG4: missing cells, columns with missing, rows with missing."""
    return V.missing_summary(SP.entity_table(spark, sf))


@query("agg5_class_distribution", f"""WITH {E}
SELECT churn AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM entity GROUP BY churn""")
def agg5_class_distribution(spark, sf):
    """AGG5: class counts and shares of the target."""
    return profile.class_distribution(SP.entity_table(spark, sf), "churn")


@query("agg6_distinct_profile", """SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS n_distinct,
  bool_or(o_orderstatus IS NULL) AS has_null FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), bool_or(o_orderpriority IS NULL) FROM orders""")
def agg6_distinct_profile(spark, sf):
    """AGG6: distinct count (nulls skipped) and null presence per categorical column."""
    return profile.distinct_profile(read_table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("agg6_distinct_values", f"""WITH {E}
SELECT DISTINCT 'c_mktsegment' AS column_name, c_mktsegment AS value FROM entity
UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders""")
def agg6_distinct_values(spark, sf):
    """AGG6: distinct values per column, null kept (the category lists stored with a model)."""
    a = profile.distinct_values(SP.entity_table(spark, sf), ["c_mktsegment"])
    b = profile.distinct_values(read_table(spark, sf, "orders"), ["o_orderpriority"])
    return a.unionByName(b).distinct()


_LI_IQR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg19_iqr_outliers", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 3.0 * (q3 - q1), 6) AS lower,
  round(q3 + 3.0 * (q3 - q1), 6) AS upper,
  (SELECT count(*) FROM lineitem WHERE {c} < q1 - 3.0 * (q3 - q1) OR {c} > q3 + 3.0 * (q3 - q1)) AS n_outliers
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in _LI_IQR))
def agg19_iqr_outliers(spark, sf):
    """AGG19: IQR outlier counts (k = 3.0) with exact quartiles."""
    return profile.iqr_outliers(read_table(spark, sf, "lineitem"), _LI_IQR)


def _qp_sql(tag: str, table: str) -> str:
    parts = []
    for c in ("value", "event_type"):
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT '{tag}' AS dataset, '{c}' AS column_name, count(*) AS n_rows,
  count(*) FILTER (WHERE {c} IS NULL) AS missing, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_share,
  count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c}) / count(*), 6) AS distinct_share,
  (SELECT {v} FROM {table} WHERE {c} IS NOT NULL GROUP BY {v} ORDER BY count(*) DESC, {v} LIMIT 1) AS most_common,
  (SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {v} ORDER BY count(*) DESC, {v} LIMIT 1) AS mode_count
  FROM {table}""")
    return " UNION ALL ".join(parts)


@query("agg21_quality_profile", f"WITH {SP.refcur_sql(False)} {_qp_sql('reference', 'ref')} UNION ALL {_qp_sql('current', 'cur')}")
def agg21_quality_profile(spark, sf):
    """AGG21: data-quality profile (missing, distinct, most common) of both tables."""
    ref, cur = SP.reference_current(spark, sf)
    a = profile.quality_profile(ref, "reference", ["value"], ["event_type"])
    b = profile.quality_profile(cur, "current", ["value"], ["event_type"])
    return a.unionByName(b)


@query("tst1_test_suite", f"""WITH {E},
s AS (SELECT count(*) AS n, (count(*) FILTER (WHERE c_acctbal IS NULL) > 0)::INT + (count(*) FILTER (WHERE c_mktsegment IS NULL) > 0)::INT AS cols,
   count(*) FILTER (WHERE c_acctbal IS NULL OR c_mktsegment IS NULL) AS rows_m FROM entity)
SELECT 'columns_with_missing_values' AS test, CAST(cols AS DOUBLE) AS value, CAST(5.0 AS DOUBLE) AS "limit",
  CASE WHEN cols < 5 THEN 'SUCCESS' ELSE 'FAIL' END AS status FROM s
UNION ALL SELECT 'rows_with_missing_values_share', round(rows_m / n, 6), CAST(0.1 AS DOUBLE), CASE WHEN rows_m / n < 0.1 THEN 'SUCCESS' ELSE 'FAIL' END FROM s
UNION ALL SELECT 'rows_with_missing_values_count', CAST(rows_m AS DOUBLE), CAST(0.0 AS DOUBLE), CASE WHEN rows_m <= 0 THEN 'SUCCESS' ELSE 'FAIL' END FROM s""")
def tst1_test_suite(spark, sf):
    """TST1: missing-value test suite with status per test."""
    return V.test_suite(SP.entity_table(spark, sf))


@query("val3_unseen_entities", """WITH cur AS (SELECT CASE WHEN event_id % 97 = 0 THEN user_id + 1000000 ELSE user_id END AS user_id
  FROM events WHERE ts >= TIMESTAMP '2024-01-22')
SELECT DISTINCT user_id FROM cur WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-22')""")
def val3_unseen_entities(spark, sf):
    """VAL3 / JON5: values in the current table (new users are planted) that the
    reference never had (anti join)."""
    ev = read_table(spark, sf, "events").select("event_id", "ts", "user_id")
    t = F.lit(SP.DRIFT_SPLIT_TS).cast("timestamp_ntz")
    new = F.when(F.col("event_id") % 97 == 0, F.col("user_id") + 1000000).otherwise(F.col("user_id"))
    return V.unseen_values(ev.where(F.col("ts") >= t).withColumn("user_id", new), ev.where(F.col("ts") < t), "user_id")


@query("val3_unseen_categories", f"""WITH {E},
cur AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN 'SPACECRAFT' WHEN c_custkey % 17 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
   CASE WHEN c_custkey % 19 = 0 THEN '-1' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM entity)
SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS n FROM cur
 WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM entity WHERE c_mktsegment IS NOT NULL) GROUP BY 2
UNION ALL SELECT 'nation', nation, count(*) FROM cur WHERE nation NOT IN (SELECT CAST(c_nationkey AS VARCHAR) FROM entity) GROUP BY 2""")
def val3_unseen_categories(spark, sf):
    """VAL3 / JON5: categories absent from the lists stored at training (exact lists
    and a Bloom sketch); new segments and nations are planted in the checked table."""
    import uuid

    from tabulon.operators import model as MD
    from tabulon.session import scratch_path
    ent = SP.entity_table(spark, sf).select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    path = scratch_path(spark, f"seen-{uuid.uuid4().hex}")
    MD.save_seen_values(profile.distinct_values(ent, ["c_mktsegment", "nation"]), path)
    segment = (F.when(F.col("c_custkey") % 13 == 0, "SPACECRAFT").when(F.col("c_custkey") % 17 == 0, F.lower("c_mktsegment"))
               .otherwise(F.col("c_mktsegment")))
    new = ent.withColumn("c_mktsegment", segment).withColumn("nation", F.when(F.col("c_custkey") % 19 == 0, "-1").otherwise(F.col("nation")))
    return MD.unseen_categories(new, path)


@query("snk7_run_stamp", """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_stamp FROM events""")
def snk7_run_stamp(spark, sf):
    """SNK7 / SCL11: ``%Y%m%d_%H%M%S`` stamps as partition values."""
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", S.run_stamp("ts").alias("run_stamp"))


@query("scl_text_functions", f"""WITH {SP.PREDLOG_SQL}
SELECT prediction_id,
  CASE WHEN churn_probability < 0.3 THEN 'Low' WHEN churn_probability < 0.7 THEN 'Medium' ELSE 'High' END AS risk_level,
  round(greatest(churn_probability, 1 - churn_probability), 6) AS confidence,
  CASE WHEN churn_probability >= 0.5 THEN 'Will Churn' ELSE 'Will Not Churn' END AS label_text,
  printf('%.1f%%', churn_probability * 100) AS probability_text,
  printf('%.3f', value) AS value_text, 'Event ' || upper(left(event_type, 1)) || lower(substr(event_type, 2)) || ' Of User' AS spaced_title,
  trim(CASE WHEN prediction_id % 3 = 0 THEN '  ' ELSE event_type END) = '' AS blank, starts_with(event_type, 'P') AS starts_upper,
  upper(left(event_type, 1)) || lower(substr(event_type, 2)) AS event_title,
  upper(event_type) AS event_upper, starts_with(event_type, 'p') AS starts_p, contains(event_type, 'ie') AS has_ie,
  round(churn_probability - 0.5, 6) AS delta_from_half,
  CAST(churn_probability >= 0.5 AS INTEGER) AS churn_flag
FROM predlog""")
def scl_text_functions(spark, sf):
    """SCL1-8, SCL13-14: tiers, confidence, label and number text, title case, tests."""
    log = SP.prediction_log(spark, sf)
    p = F.col("churn_probability")
    return log.select(
        "prediction_id", S.risk_tier(p).alias("risk_level"), S.confidence(p).alias("confidence"),
        S.label_text((p >= 0.5).cast("int")).alias("label_text"),
        S.percent_text(p, 1).alias("probability_text"), S.number_text("value", 3).alias("value_text"),
        S.title_words(F.concat(F.lit("event_"), "event_type", F.lit("_of_user"))).alias("spaced_title"),
        S.is_blank(F.when(F.col("prediction_id") % 3 == 0, "  ").otherwise(F.col("event_type"))).alias("blank"),
        F.col("event_type").startswith("P").alias("starts_upper"),
        S.title_words("event_type").alias("event_title"), F.upper("event_type").alias("event_upper"),
        F.col("event_type").startswith("p").alias("starts_p"), F.col("event_type").contains("ie").alias("has_ie"),
        (p - 0.5).alias("delta_from_half"), (p >= 0.5).cast("int").alias("churn_flag"))


@query("scl16_json_field", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  coalesce(json_extract_string(props, '$.missing'), 'default') AS missing_field FROM events""")
def scl16_json_field(spark, sf):
    """SCL16: nested field access with defaults (JSON text)."""
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
                     F.coalesce(F.get_json_object("props", "$.missing"), F.lit("default")).alias("missing_field"))
