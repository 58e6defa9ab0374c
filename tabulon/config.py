"""Configuration values.

The values below marked FIXED VALUES must equal the studied pipeline's for
the results to agree; everything else is our own parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- FIXED VALUES (must match the studied pipeline) -------------------------
# Columns dropped from the raw customer table before training.
DROP_COLUMNS = (
    "Customer ID", "Lat Long", "Latitude", "Longitude", "Zip Code", "City",
    "State", "Country", "Quarter", "Churn Reason", "Churn Score",
    "Churn Category", "Category", "Customer Status", "Dependents",
    "Device Protection Plan", "Gender", "Under 30", "Married",
    "Number of Dependents", "Number of Referrals", "Payment Method", "Offer",
    "Online Backup", "Online Security", "Paperless Billing", "Partner",
    "Premium Tech Support", "Referred a Friend", "Senior Citizen",
    "Total Refunds",
)
# Validation limits of the raw table.
MIN_SAMPLES = 1000
MAX_MISSING_SHARE = 0.3
REQUIRED_COLUMNS = ("Monthly Charges", "Total Charges", "Tenure Months", "Churn")
# Split and folds.
TEST_SIZE = 0.2
CV_FOLDS = 5
RANDOM_SEED = 42
# Risk tiers: p < 0.3 Low, p < 0.7 Medium, else High; label cut 0.5.
TIER_LOW_CUT = 0.3
TIER_HIGH_CUT = 0.7
LABEL_CUT = 0.5
TIERS = ("Low", "Medium", "High")
# Text for all-null categorical columns after imputation.
UNKNOWN_CATEGORY = "Unknown"
# Missing-value text in record display.
NOT_AVAILABLE = "Not Available"
# Drift and monitoring thresholds.
DRIFT_THRESHOLD = 0.1
ACCURACY_DROP = 0.05
VOLUME_CHANGE = 0.5
VOLUME_ABOVE_BASELINE = 0.15
OUTLIER_IQR_FACTOR = 3.0
REFERENCE_WINDOW_DAYS = 30
CURRENT_WINDOW_DAYS = 7
MIN_DRIFT_SAMPLES = 50
MIN_PERFORMANCE_SAMPLES = 10
MONITOR_WINDOW = "5 minutes"
LOG_CAPACITY = 1000
MONITOR_LAST_N = 100
HEALTH_LAST_N = 10
LOAD_TEST_PASS_RATE = 95.0
# Test-suite limits: columns with missing values < 5, rows with missing share < 0.10.
TEST_MAX_COLUMNS_WITH_MISSING = 5
TEST_MAX_ROWS_WITH_MISSING_SHARE = 0.10
# Request codes for categorical fields at serving time.
CONTRACT_CODES = {"Month-to-month": 0, "One year": 1, "Two year": 2}
INTERNET_TYPE_CODES = {"cable": 1, "dsl": 2, "fiber optic": 3}

# Alert rules: name, condition over named metrics, severity, description, channels.
ALERT_RULES = (
    ("model_accuracy_drop", "accuracy < 0.80", "high",
     "Model accuracy dropped below acceptable threshold", ("slack", "email")),
    ("data_drift_detected", "drift_score > 0.1", "medium",
     "Significant data drift detected", ("slack",)),
    ("high_prediction_latency", "prediction_latency_ms > 1000", "medium",
     "Prediction latency exceeds 1 second", ("slack",)),
    ("service_unavailable", "service_health != 'healthy'", "critical",
     "Core service is unavailable", ("slack", "email", "sms")),
    ("low_prediction_confidence", "avg_confidence < 0.75", "low",
     "Average prediction confidence is low", ("email",)),
)
# Built-in report alerts: (type, condition, severity, message, metric).
REPORT_ALERTS = (
    ("performance", "accuracy < 0.80", "high",
     "Model accuracy below acceptable threshold (80%)", "accuracy"),
    ("data_quality", "missing_values_percentage > 0.10", "medium",
     "High percentage of missing values detected", "missing_values_percentage"),
    ("system", "prediction_latency_ms > 500", "medium",
     "High prediction latency detected", "prediction_latency_ms"),
)
# Monitor alerts: (type, condition, severity, message).
MONITOR_ALERTS = (
    ("LOW_CONFIDENCE", "avg_confidence < 0.7", "warning",
     "Average model confidence is low"),
    ("NO_PREDICTIONS", "n_predictions = 0", "info",
     "No recent predictions detected"),
    ("DATA_DRIFT_DETECTED", "drift_detected", "warning",
     "Data drift detected in recent predictions"),
)
# Optional feature stage (off by default): variance threshold for selection.
FEATURE_SELECTION_THRESHOLD = 0.01
# Retrain reasons (the last one takes the number of failed tests first).
REASON_DATASET_DRIFT = "Dataset drift detected"
REASON_TARGET_DRIFT = "Target drift detected"
REASON_TESTS_FAILED = " data quality tests failed"
# Recommended actions per tier (four per tier).
TIER_ACTIONS = {
    "High": ("Contact within 24-48 hours", "Offer retention package or discount",
             "Assign dedicated account manager", "Conduct satisfaction survey"),
    "Medium": ("Reach out within 1-2 weeks", "Highlight unused services and benefits",
               "Enroll in loyalty program", "Monitor usage patterns closely"),
    "Low": ("Continue excellent customer service", "Consider upselling opportunities",
            "Encourage referrals", "Quarterly satisfaction check-in"),
}
# --- end of FIXED VALUES -----------------------------------------------------


#: Days whose mean volume is the baseline of the next day (our choice).
BASELINE_DAYS = 7

#: Category values (of all categorical columns together) that a model may take.
MAX_CATEGORIES = 10_000


@dataclass(frozen=True)
class DriftConfig:
    """Our drift contract (see README): the caller names what decides, at every
    size: ``distance`` (with a threshold) or ``p_value`` (of the test)."""
    decide_by: str = "distance"
    p_value_cut: float = 0.05
    distance_cut: float = DRIFT_THRESHOLD
    dataset_share: float = 0.5
    ks_series_terms: int = 100


@dataclass(frozen=True)
class ScaleConfig:
    """Knobs for the two-level ordered scans (KS, AUC, exact quantiles).  Range
    buckets, and so sort tasks, grow with ``spark.sql.shuffle.partitions``."""
    buckets_per_partition: int = 4
    quantile_accuracy: int = 10000
    rank_hash_digits: int = 3   # 16**3 = 4096 hash buckets for stratified ranks
    range_rows: int = 250       # rows of one key below which its range is not cut


DEFAULT_DRIFT = DriftConfig()
DEFAULT_SCALE = ScaleConfig()
