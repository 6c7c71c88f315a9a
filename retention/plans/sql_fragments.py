"""DuckDB SQL for the oracle side of each registered query.

These strings restate the rules in plain ANSI SQL over the pre-registered test tables;
they are the independent check of the DataFrame implementation, not used by it.
"""

from __future__ import annotations

from ..fixtures import RULE_SCORED_CTE, subscriber_sql_oracle

ADDONS = ["online_security", "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies"]


def _yes(c: str) -> str:
    return f"(CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END)"


SERVICE_COUNT = (
    "((CASE WHEN COALESCE(phone_service, false) THEN 1 ELSE 0 END) + "
    + _yes("multiple_lines")
    + " + (CASE WHEN internet_service <> 'No' THEN 1 ELSE 0 END) + "
    + " + ".join(_yes(a) for a in ADDONS)
    + ")"
)
SERVICES_RAW = (
    "((CASE WHEN COALESCE(phone_service, false) THEN 1 ELSE 0 END) + "
    "(CASE WHEN multiple_lines <> 'No' THEN 1 ELSE 0 END) + "
    "(CASE WHEN internet_service <> 'No' THEN 1 ELSE 0 END) + " + " + ".join(_yes(a) for a in ADDONS) + ")"
)


def risk_sql(sc: str = "service_count") -> str:
    return f"""CAST(LEAST(
  (CASE WHEN contract_type = 'Month-to-month' THEN 30 WHEN contract_type = 'One year' THEN 15 ELSE 0 END)
 + (CASE WHEN payment_method IN ('Mailed check', 'Bank transfer (automatic)') THEN 20
         WHEN payment_method = 'Credit card (automatic)' THEN 10 ELSE 0 END)
 + (CASE WHEN {sc} <= 3 THEN 25 WHEN {sc} <= 6 THEN 15 WHEN {sc} <= 9 THEN 5 ELSE 0 END)
 + (CASE WHEN tenure_months < 12 THEN 20 WHEN tenure_months < 24 THEN 10 WHEN tenure_months < 36 THEN 5 ELSE 0 END)
 + (CASE WHEN monthly_charges > 100 THEN 15 WHEN monthly_charges > 80 THEN 10 WHEN monthly_charges > 60 THEN 5 ELSE 0 END)
 + (CASE WHEN COALESCE(senior_citizen, false) THEN 5 ELSE 0 END)
 + (CASE WHEN NOT COALESCE(partner, false) AND NOT COALESCE(dependents, false) THEN 10 ELSE 0 END),
 100) AS DOUBLE)"""


SEGMENT_SQL = """CASE WHEN COALESCE(churn, false) THEN 'churned'
  WHEN tenure_months < 6 THEN 'new_customers'
  WHEN monthly_charges > 70 AND NOT (risk_score >= 70) THEN 'high_value_low_risk'
  WHEN monthly_charges > 70 AND risk_score >= 70 THEN 'high_value_high_risk'
  WHEN NOT (monthly_charges > 70) AND NOT (risk_score >= 70) THEN 'low_value_low_risk'
  ELSE 'low_value_high_risk' END"""

LIFETIME_SQL = """CASE WHEN COALESCE(churn, false) THEN monthly_charges * tenure_months
  ELSE monthly_charges * (tenure_months + CASE WHEN tenure_months < 12 THEN 24 WHEN tenure_months < 24 THEN 36 ELSE 48 END) END"""

PREMIUM_SQL = "COALESCE(" + " OR ".join(f"{a} = 'Yes'" for a in ADDONS) + ", false)"


def with_subs(body: str, extra_ctes: str = "") -> str:
    """``WITH subs AS (<derived subscriber view>) [, more CTEs] <body>``."""
    ctes = f"subs AS ({subscriber_sql_oracle()})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


FEATURES_CTE = f"""feat AS (
  SELECT *, {SERVICE_COUNT} AS service_count, {SERVICES_RAW} AS services_count_raw FROM subs),
scored AS (SELECT *, {risk_sql()} AS risk_score FROM feat),
rules AS (
  SELECT *, monthly_charges > 70 AS is_high_value, {PREMIUM_SQL} AS has_premium_services,
         total_charges / (tenure_months + 1) AS avg_monthly_charge,
         {LIFETIME_SQL} AS lifetime_value,
         {SEGMENT_SQL} AS segment
  FROM scored)"""

# subscribers after P2 (missing total charges imputed), then the rule columns
IMPUTED = "(SELECT * REPLACE (COALESCE(total_charges, monthly_charges * tenure_months) AS total_charges) FROM subs)"
IMPUTED_FEATURES_CTE = FEATURES_CTE.replace("FROM subs)", f"FROM {IMPUTED})", 1)
# the rule-score stand-in for scored rows (probability = rule score / 100)
SCORED_CTES = IMPUTED_FEATURES_CTE + ",\n" + RULE_SCORED_CTE

RISK_LEVEL_SQL = (
    "CASE WHEN probability_churn > 0.8 AND abs(2.0 * probability_churn - 1.0) > 0.7 THEN 'Critical' "
    "WHEN probability_churn > 0.6 AND abs(2.0 * probability_churn - 1.0) > 0.5 THEN 'High' "
    "WHEN probability_churn > 0.4 AND abs(2.0 * probability_churn - 1.0) > 0.3 THEN 'Medium' ELSE 'Low' END"
)


def quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


# written out, as an independent check of the schema
DOMAINS = {
    "gender": ["Male", "Female"],
    "multiple_lines": ["Yes", "No", "No phone service"],
    "internet_service": ["DSL", "Fiber optic", "No"],
    **{a: ["Yes", "No", "No internet service"] for a in ADDONS},
    "contract_type": ["Month-to-month", "One year", "Two year"],
    "payment_method": ["Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)"],
}
INPUTS = [
    "gender", "senior_citizen", "partner", "dependents", "phone_service", "multiple_lines", "internet_service", *ADDONS,
    "contract_type", "paperless_billing", "payment_method", "monthly_charges", "total_charges", "tenure_months",
]


def errors_sql() -> str:
    """The validation codes as SQL, in the same fixed order as the rules."""
    parts = []
    for name in INPUTS:
        parts.append(f"CASE WHEN {name} IS NULL THEN 'missing_{name}' END")
    for name, dom in DOMAINS.items():
        parts.append(
            f"CASE WHEN {name} IS NOT NULL AND {name} NOT IN ({', '.join(quote(v) for v in dom)}) THEN 'invalid_{name}' END"
        )
    parts += [
        "CASE WHEN monthly_charges <= 0 THEN 'monthly_charges_not_positive' END",
        "CASE WHEN total_charges < 0 THEN 'total_charges_negative' END",
        "CASE WHEN tenure_months < 0 THEN 'tenure_months_negative' END",
        "CASE WHEN tenure_months > 0 AND total_charges < monthly_charges * tenure_months * 0.8 "
        "THEN 'total_charges_inconsistent' END",
        "CASE WHEN (NOT phone_service AND multiple_lines <> 'No phone service') OR "
        "(phone_service AND multiple_lines = 'No phone service') THEN 'multiple_lines_inconsistent' END",
        "CASE WHEN internet_service = 'No' AND ("
        + " OR ".join(f"{a} NOT IN ('No internet service', 'No')" for a in ADDONS)
        + ") THEN 'internet_addons_inconsistent' END",
    ]
    return "concat_ws(',', " + ", ".join(parts) + ")"
