"""The 31-column serving feature encoding, as integer/double Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: feature slots in serving order ---------------------------------------
FEATURE_NAMES = [
    "senior_citizen", "partner", "dependents", "phone_service", "paperless_billing",
    "monthly_charges", "total_charges", "tenure_months", "gender_male",
    "multiple_lines_no_phone_service", "multiple_lines_yes",
    "internet_service_fiber_optic", "internet_service_yes",
    "online_security_no_internet_service", "online_security_yes",
    "online_backup_no_internet_service", "online_backup_yes",
    "device_protection_no_internet_service", "device_protection_yes",
    "tech_support_no_internet_service", "tech_support_yes",
    "streaming_tv_no_internet_service", "streaming_tv_yes",
    "streaming_movies_no_internet_service", "streaming_movies_yes",
    "contract_type_one_year", "contract_type_two_year",
    "payment_method_bank_transfer_automatic", "payment_method_credit_card_automatic",
    "payment_method_electronic_check", "payment_method_mailed_check",
]
# indicator slot -> (source column, value it tests)
INDICATORS = {
    "multiple_lines_no_phone_service": ("multiple_lines", "No phone service"),
    "multiple_lines_yes": ("multiple_lines", "Yes"),
    "internet_service_fiber_optic": ("internet_service", "Fiber optic"),
    # never 1 for valid data (the domain has no "Yes"); kept so the slot layout is unchanged
    "internet_service_yes": ("internet_service", "Yes"),
    "online_security_no_internet_service": ("online_security", "No internet service"),
    "online_security_yes": ("online_security", "Yes"),
    "online_backup_no_internet_service": ("online_backup", "No internet service"),
    "online_backup_yes": ("online_backup", "Yes"),
    "device_protection_no_internet_service": ("device_protection", "No internet service"),
    "device_protection_yes": ("device_protection", "Yes"),
    "tech_support_no_internet_service": ("tech_support", "No internet service"),
    "tech_support_yes": ("tech_support", "Yes"),
    "streaming_tv_no_internet_service": ("streaming_tv", "No internet service"),
    "streaming_tv_yes": ("streaming_tv", "Yes"),
    "streaming_movies_no_internet_service": ("streaming_movies", "No internet service"),
    "streaming_movies_yes": ("streaming_movies", "Yes"),
    "contract_type_one_year": ("contract_type", "One year"),
    "contract_type_two_year": ("contract_type", "Two year"),
    "payment_method_bank_transfer_automatic": ("payment_method", "Bank transfer (automatic)"),
    "payment_method_credit_card_automatic": ("payment_method", "Credit card (automatic)"),
    "payment_method_electronic_check": ("payment_method", "Electronic check"),
    "payment_method_mailed_check": ("payment_method", "Mailed check"),
}
# --- end of fixed values ----------------------------------------------------------------

FLAG_FEATURES = ["senior_citizen", "partner", "dependents", "phone_service", "paperless_billing"]
NUMERIC_FEATURES = ["monthly_charges", "total_charges", "tenure_months"]


def feature_columns() -> list[Column]:
    """One aliased Column per slot of ``FEATURE_NAMES``."""
    cols: list[Column] = []
    for name in FEATURE_NAMES:
        if name in FLAG_FEATURES:
            cols.append(F.coalesce(F.col(name), F.lit(False)).cast("int").alias(name))
        elif name in NUMERIC_FEATURES:
            cols.append(F.col(name).cast("double").alias(name))
        elif name == "gender_male":
            cols.append(F.coalesce(F.lower(F.col("gender")) == "male", F.lit(False)).cast("int").alias(name))
        else:
            src, value = INDICATORS[name]
            cols.append(F.coalesce(F.col(src) == value, F.lit(False)).cast("int").alias(name))
    return cols
