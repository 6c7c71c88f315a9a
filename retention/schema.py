"""Subscriber schema and the fixed value domains of the churn rules."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: these must equal the source system's for equal results ----------
GENDERS = ["Male", "Female"]
MULTIPLE_LINES = ["Yes", "No", "No phone service"]
INTERNET_SERVICES = ["DSL", "Fiber optic", "No"]
ADDON_VALUES = ["Yes", "No", "No internet service"]
CONTRACT_TYPES = ["Month-to-month", "One year", "Two year"]
PAYMENT_METHODS = [
    "Electronic check",
    "Mailed check",
    "Bank transfer (automatic)",
    "Credit card (automatic)",
]
ADDON_COLUMNS = [
    "online_security",
    "online_backup",
    "device_protection",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
]
SEGMENTS = [
    "high_value_low_risk",
    "high_value_high_risk",
    "low_value_low_risk",
    "low_value_high_risk",
    "new_customers",
    "churned",
]
# --- end of fixed values ---------------------------------------------------------------

BOOL_COLUMNS = ["senior_citizen", "partner", "dependents", "phone_service", "paperless_billing"]
DOUBLE_COLUMNS = ["monthly_charges", "total_charges"]
INT_COLUMNS = ["tenure_months"]
ENUM_DOMAINS = {
    "gender": GENDERS,
    "multiple_lines": MULTIPLE_LINES,
    "internet_service": INTERNET_SERVICES,
    **{c: ADDON_VALUES for c in ADDON_COLUMNS},
    "contract_type": CONTRACT_TYPES,
    "payment_method": PAYMENT_METHODS,
}

# Input fields in record order (20 inputs + id), then label and timestamps.
INPUT_COLUMNS = [
    "customer_id",
    "gender",
    "senior_citizen",
    "partner",
    "dependents",
    "phone_service",
    "multiple_lines",
    "internet_service",
    *ADDON_COLUMNS,
    "contract_type",
    "paperless_billing",
    "payment_method",
    "monthly_charges",
    "total_charges",
    "tenure_months",
]
REQUIRED_COLUMNS = INPUT_COLUMNS + ["churn"]
RECORD_COLUMNS = INPUT_COLUMNS + ["churn", "created_at", "updated_at"]


def _type_of(name: str) -> T.DataType:
    if name in BOOL_COLUMNS or name == "churn":
        return T.BooleanType()
    if name in DOUBLE_COLUMNS:
        return T.DoubleType()
    if name in INT_COLUMNS:
        return T.IntegerType()
    if name in ("created_at", "updated_at"):
        return T.TimestampType()
    return T.StringType()


SUBSCRIBER_SCHEMA = T.StructType([T.StructField(c, _type_of(c), True) for c in REQUIRED_COLUMNS])
RECORD_SCHEMA = T.StructType([T.StructField(c, _type_of(c), True) for c in RECORD_COLUMNS])
# CSV input is read as text and typed by ``coerce_types`` so bad cells become nulls
# instead of failing or silently shifting the row.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in REQUIRED_COLUMNS])

SCORED_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("prediction", T.BooleanType()),
        T.StructField("probability_churn", T.DoubleType()),
        T.StructField("probability_stay", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("customer_segment", T.StringType()),
        T.StructField("lifetime_value", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("prediction_timestamp", T.TimestampType()),
    ]
)

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)
