"""Business rules as Column expressions.

Each function returns a ``Column``; nothing here runs Python per row, so a chain of
``withColumn`` calls collapses into one whole-stage-codegen projection.
Null inputs fall to the ``otherwise`` branch; rows with null required fields are
expected to be quarantined by ``validate`` before scoring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..schema import ADDON_COLUMNS

# --- fixed values: recommendation texts shown to the user (D15) ------------------------
OUTREACH_ACTIONS = [
    "Immediate outreach - Contact customer within 24 hours",
    "Retention offer - Prepare personalized discount or upgrade",
    "Personal call - Schedule call with customer success team",
]
PRIORITY_ACTION = "Priority intervention - This customer has very high churn probability"
VIP_ACTION = "VIP treatment - High-value customer requiring special attention"
GENERAL_ACTIONS = [
    "Analyze usage patterns - Review customer's service usage",
    "Survey feedback - Collect feedback on service satisfaction",
    "Technical support - Offer proactive technical assistance",
]
LOYALTY_ACTIONS = [
    "Continue excellent service - Maintain current service quality",
    "Loyalty rewards - Consider loyalty program or small perks",
    "Upselling opportunity - Customer is stable, consider service upgrades",
    "Regular check-ins - Schedule periodic satisfaction reviews",
    "Engagement programs - Invite to customer community or events",
]
# --- end of fixed values ---------------------------------------------------------------


def _c(name_or_col) -> Column:
    return F.col(name_or_col) if isinstance(name_or_col, str) else name_or_col


def _flag(cond: Column) -> Column:
    """Boolean condition as 0/1 integer, null counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def churned() -> Column:
    """True only for a known positive label; a null label counts as active."""
    return F.coalesce(F.col("churn"), F.lit(False))


# D1
def is_high_value(t: Thresholds = DEFAULT) -> Column:
    return F.col("monthly_charges") > F.lit(t.high_value_monthly)


# D2
def has_premium_services() -> Column:
    return F.coalesce(F.greatest(*[F.col(c) == "Yes" for c in ADDON_COLUMNS]), F.lit(False))


# D3
def service_count() -> Column:
    parts = [
        _flag(F.col("phone_service")),
        _flag(F.col("multiple_lines") == "Yes"),
        _flag(F.col("internet_service") != "No"),
    ] + [_flag(F.col(c) == "Yes") for c in ADDON_COLUMNS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


# Lines counted when not "No", so "No phone service" counts one (training-path form)
def services_count_raw() -> Column:
    parts = [
        _flag(F.col("phone_service")),
        _flag(F.col("multiple_lines") != "No"),
        _flag(F.col("internet_service") != "No"),
    ] + [_flag(F.col(c) == "Yes") for c in ADDON_COLUMNS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


# D5
def avg_monthly_charge() -> Column:
    # try_divide: a (quarantined) tenure of -1 yields null instead of failing the job
    return F.try_divide(F.col("total_charges"), F.col("tenure_months") + F.lit(1))


# D6
def lifetime_value(assume_active: bool = False) -> Column:
    """Churned: monthly x tenure; otherwise monthly x (tenure + expected remaining months).
    ``assume_active`` ignores the label (a subscriber being scored has no outcome yet)."""
    tenure = F.col("tenure_months")
    remaining = F.when(tenure < 12, 24).when(tenure < 24, 36).otherwise(48)
    if assume_active:
        return F.col("monthly_charges") * (tenure + remaining)
    return F.when(churned(), F.col("monthly_charges") * tenure).otherwise(
        F.col("monthly_charges") * (tenure + remaining)
    )


# D7
def risk_score(services: Column | None = None) -> Column:
    """Rule score 0-100 (raw maximum 125, capped)."""
    sc = service_count() if services is None else services
    contract = (
        F.when(F.col("contract_type") == "Month-to-month", 30.0)
        .when(F.col("contract_type") == "One year", 15.0)
        .otherwise(0.0)
    )
    payment = (
        F.when(F.col("payment_method").isin("Mailed check", "Bank transfer (automatic)"), 20.0)
        .when(F.col("payment_method") == "Credit card (automatic)", 10.0)
        .otherwise(0.0)
    )
    services_part = F.when(sc <= 3, 25.0).when(sc <= 6, 15.0).when(sc <= 9, 5.0).otherwise(0.0)
    tenure = F.col("tenure_months")
    tenure_part = F.when(tenure < 12, 20.0).when(tenure < 24, 10.0).when(tenure < 36, 5.0).otherwise(0.0)
    mc = F.col("monthly_charges")
    charge_part = F.when(mc > 100, 15.0).when(mc > 80, 10.0).when(mc > 60, 5.0).otherwise(0.0)
    senior = F.when(F.coalesce(F.col("senior_citizen"), F.lit(False)), 5.0).otherwise(0.0)
    single = F.when(
        ~F.coalesce(F.col("partner"), F.lit(False)) & ~F.coalesce(F.col("dependents"), F.lit(False)), 10.0
    ).otherwise(0.0)
    raw = contract + payment + services_part + tenure_part + charge_part + senior + single
    return F.least(raw, F.lit(100.0))


# D8
def rule_segment(score: Column | None = None, t: Thresholds = DEFAULT) -> Column:
    rs = risk_score() if score is None else score
    hv = is_high_value(t)
    hr = rs >= F.lit(t.high_risk_score)
    return (
        F.when(churned(), "churned")
        .when(F.col("tenure_months") < t.new_customer_months, "new_customers")
        .when(hv & ~hr, "high_value_low_risk")
        .when(hv & hr, "high_value_high_risk")
        .when(~hv & ~hr, "low_value_low_risk")
        .otherwise("low_value_high_risk")
    )


# D9
def prediction_segment(probability: Column | str = "probability_churn", t: Thresholds = DEFAULT) -> Column:
    hv = F.coalesce(is_high_value(t), F.lit(False))
    hr = F.coalesce(is_high_risk(probability), F.lit(False))
    return F.concat(
        F.when(hv, "high").otherwise("low"), F.lit("_value_"), F.when(hr, "high").otherwise("low"), F.lit("_risk")
    )


# D10
def risk_level_probability(probability: Column | str = "probability_churn") -> Column:
    p = _c(probability)
    return F.when(p < 0.3, "low").when(p < 0.5, "medium").when(p < 0.7, "high").otherwise("critical")


# D12
def confidence(probability: Column | str = "probability_churn", n_classes: int = 2) -> Column:
    """Top class probability minus the second; a one-class model is fully confident."""
    if n_classes == 1:
        return F.lit(1.0)
    return F.abs(F.lit(2.0) * _c(probability) - F.lit(1.0))


# D11
def risk_level_confidence(probability: Column | str = "probability_churn", conf: Column | None = None) -> Column:
    p = _c(probability)
    c = confidence(p) if conf is None else conf
    return (
        F.when((p > 0.8) & (c > 0.7), "Critical")
        .when((p > 0.6) & (c > 0.5), "High")
        .when((p > 0.4) & (c > 0.3), "Medium")
        .otherwise("Low")
    )


# D18
def risk_level_display(probability: Column | str = "probability_churn") -> Column:
    p = _c(probability)
    return F.when(p < 0.4, "Low").when(p < 0.6, "Medium").when(p <= 0.8, "High").otherwise("Critical")


def risk_level(probability: Column | str = "probability_churn", scale: str = "confidence") -> Column:
    if scale == "confidence":
        return risk_level_confidence(probability)
    if scale == "probability":
        return risk_level_probability(probability)
    if scale == "display":
        return risk_level_display(probability)
    raise ValueError(f"unknown risk-level scale {scale!r}")


# D13
def probability_stay(probability: Column | str = "probability_churn") -> Column:
    return F.lit(1.0) - _c(probability)


# D14
def is_high_risk(probability: Column | str = "probability_churn") -> Column:
    return _c(probability) >= F.lit(0.5)


# D15
def recommendations(
    prediction: Column | str = "prediction",
    level: Column | str = "risk_level",
    probability: Column | str = "probability_churn",
    segment: Column | str = "customer_segment",
) -> Column:
    """Ordered list of actions for one scored subscriber."""
    pred, lvl, p, seg = _c(prediction), _c(level), _c(probability), _c(segment)
    outreach = F.when(lvl.isin("High", "Critical"), F.array(*[F.lit(a) for a in OUTREACH_ACTIONS])).otherwise(
        F.array().cast("array<string>")
    )
    priority = F.when(p > 0.7, F.array(F.lit(PRIORITY_ACTION))).otherwise(F.array().cast("array<string>"))
    vip = F.when(seg == "high_value_high_risk", F.array(F.lit(VIP_ACTION))).otherwise(
        F.array().cast("array<string>")
    )
    churn_list = F.concat(outreach, priority, vip, F.array(*[F.lit(a) for a in GENERAL_ACTIONS]))
    return F.when(F.coalesce(pred, F.lit(False)), churn_list).otherwise(
        F.array(*[F.lit(a) for a in LOYALTY_ACTIONS])
    )
