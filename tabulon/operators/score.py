"""Serving-side preprocessing and scoring (PRJ5, CST2-6, SCO1, SCO3).

The request → model-column mapping is a single projection of built-in
expressions; the same fitted pipeline then scores a whole table or a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.functions import scalar as S

# Request field → model column (FIXTURES A1 / A2 names).
MODEL_NAMES = {
    "monthly_charges": "Monthly Charge", "total_charges": "Total Charges",
    "tenure_months": "Tenure in Months", "phone_service": "Phone Service",
    "multiple_lines": "Multiple Lines", "internet_service": "Internet Service",
    "streaming_tv": "Streaming TV", "streaming_movies": "Streaming Movies",
    "contract": "Contract", "cltv": "CLTV", "internet_type": "Internet Type",
    "streaming_music": "Streaming Music", "age": "Age",
    "avg_monthly_gb_download": "Avg Monthly GB Download",
    "avg_monthly_long_distance_charges": "Avg Monthly Long Distance Charges",
    "population": "Population", "satisfaction_score": "Satisfaction Score",
    "total_extra_data": "Total Extra Data Charges",
    "total_long_distance": "Total Long Distance Charges",
    "total_revenue": "Total Revenue", "unlimited_data": "Unlimited Data",
}
YES_NO_FIELDS = ("phone_service", "multiple_lines", "internet_service", "streaming_tv",
                 "streaming_movies", "streaming_music", "unlimited_data")


def request_features(req: DataFrame, keep=("customer_id",)) -> DataFrame:
    """PRJ5 + CST2-6: typed request columns → model columns.

    Yes/No flags become 0/1 (only "Yes" is 1), internet type gets the one
    stored code map (case-insensitive, unknown → 0), contract stays a
    category for the fitted encoder, total charges are derived from monthly ×
    tenure when null or 0.
    """
    cols = [F.col(k) for k in keep if k in req.columns]
    for field, name in MODEL_NAMES.items():
        if field not in req.columns:
            continue
        if field in YES_NO_FIELDS:
            e = S.yes_to_int(field)
        elif field == "internet_type":
            e = S.code_map(field, C.INTERNET_TYPE_CODES, case_insensitive=True)
        elif field == "total_charges":
            e = S.derive_total("total_charges", "monthly_charges", "tenure_months")
        else:
            e = F.col(field)
        cols.append(e.alias(name))
    return req.select(*cols)


def _scored_columns(prob: str, model_version: str | None, id_col: str, ts: str | None) -> list[Column]:
    return [
        F.col(id_col).cast("string").alias("customer_id"),
        (F.col(prob) >= C.LABEL_CUT).cast("int").alias("churn_prediction"),
        F.col(prob).alias("churn_probability"),
        S.risk_tier(prob).alias("risk_level"),
        S.confidence(prob).alias("confidence"),
        (F.col(ts) if ts else F.current_timestamp()).alias("timestamp"),
        F.lit(model_version).cast("string").alias("model_version")]


def scored_rows(pred: DataFrame, prob: str = "churn_probability", model_version: str | None = None,
                id_col: str = "customer_id", ts: str | None = None) -> DataFrame:
    """SCO1 tail: label, tier, confidence, time and version for each scored row
    (the row's own time when ``ts`` names it)."""
    return pred.select(*_scored_columns(prob, model_version, id_col, ts))


def batch_rows(pred: DataFrame, prob: str = "churn_probability", model_version: str | None = None, ts: str | None = None,
               explanation: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """SCO1 tail of batch bodies: as ``scored_rows``, with the flags of each body:
    probability and confidence are null without ``include_probabilities``, and
    ``explanation`` (the column of that name, when there is one) is null without
    ``include_explanations``."""
    shown = F.col("include_probabilities")
    d = pred.select(*keep, "include_probabilities", "include_explanations", *_scored_columns(prob, model_version, "customer_id", ts),
                    (F.col(explanation) if explanation else F.lit(None).cast("string")).alias("explanation"))
    d = d.withColumns({c: F.when(shown, F.col(c)) for c in ("churn_probability", "confidence")})
    return d.withColumn("explanation", F.when(F.col("include_explanations"), F.col("explanation"))).drop("include_probabilities", "include_explanations")


def prediction_log_rows(pred: DataFrame, features: Sequence[str], prob: str = "churn_probability",
                        model_version: str | None = None, id_col: str = "customer_id", ts: str | None = None) -> DataFrame:
    """SCO3: (timestamp, entity id, features struct, prediction struct), one log
    row per scored row, in one projection."""
    p = F.struct(*_scored_columns(prob, model_version, id_col, ts))
    d = pred.select(F.struct(*[F.col(f"`{c}`") for c in features]).alias("features"), p.alias("prediction"))
    return d.select(F.col("prediction.timestamp").alias("timestamp"), F.col("prediction.customer_id").alias("customer_id"),
                    "features", "prediction")


def append_prediction_log(log: DataFrame, path: str, date_col: str = "log_date") -> str:
    """SCO3 writer: log rows appended under their date, so readers prune by date."""
    log.withColumn(date_col, F.to_date("timestamp")).write.mode("append").partitionBy(date_col).parquet(path)
    return path
