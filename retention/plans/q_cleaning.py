"""Registered queries: cleaning, predicates, validation, scoring rules (P, V, D9-D18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import rules
from ..fixtures import clean_subscribers
from ..operators import cleaning, features
from ..schema import REQUIRED_COLUMNS
from .catalog import register
from .sql_fragments import IMPUTED, SCORED_CTES, errors_sql, quote, with_subs

_errors_sql = errors_sql
_q = quote


@register(
    "validation_quarantine",
    oracle=with_subs(f"SELECT customer_id, error FROM (SELECT customer_id, {_errors_sql()} AS error FROM {IMPUTED} x) e "
                     "WHERE error <> ''"),
)
def q_validation_quarantine(spark, sf_dir):
    """V1 (V2-V7): quarantined rows with their rule codes."""
    _, bad = cleaning.validate(clean_subscribers(spark, sf_dir))
    return bad.select("customer_id", "error")


@register(
    "valid_subscribers",
    oracle=with_subs(f"SELECT {', '.join(REQUIRED_COLUMNS)} FROM (SELECT *, {_errors_sql()} AS error FROM {IMPUTED} x) e "
                     "WHERE error = ''"),
)
def q_valid_subscribers(spark, sf_dir):
    """P5 / V1: all rows that pass every rule."""
    return cleaning.find_all(clean_subscribers(spark, sf_dir)).select(*REQUIRED_COLUMNS)


@register("churned_subscribers", oracle=with_subs("SELECT customer_id, tenure_months, monthly_charges FROM subs WHERE churn"))
def q_churned(spark, sf_dir):
    """Known churned subscribers."""
    df = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir))
    return cleaning.find_churned(df).select("customer_id", "tenure_months", "monthly_charges")


@register(
    "active_subscribers",
    oracle=with_subs("SELECT customer_id, tenure_months, monthly_charges FROM subs WHERE NOT churn"),
)
def q_active(spark, sf_dir):
    """Known active subscribers (null labels excluded)."""
    df = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir))
    return cleaning.find_active(df).select("customer_id", "tenure_months", "monthly_charges")


LOOKUP_ID = "CUST-0000042"


@register(
    "find_by_id",
    oracle=with_subs(f"SELECT {', '.join(REQUIRED_COLUMNS)} FROM subs WHERE customer_id = '{LOOKUP_ID}' LIMIT 1"),
)
def q_find_by_id(spark, sf_dir):
    """Point lookup of one subscriber id (the filter reaches the scan)."""
    df = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir))
    return cleaning.find_by_id(df, LOOKUP_ID).select(*REQUIRED_COLUMNS)


def _rec_sql(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


# fixed values: the recommendation texts written out, as an independent check of functions/rules.py
_OUTREACH = [
    "Immediate outreach - Contact customer within 24 hours",
    "Retention offer - Prepare personalized discount or upgrade",
    "Personal call - Schedule call with customer success team",
]
_PRIORITY = "Priority intervention - This customer has very high churn probability"
_VIP = "VIP treatment - High-value customer requiring special attention"
_GENERAL = [
    "Analyze usage patterns - Review customer's service usage",
    "Survey feedback - Collect feedback on service satisfaction",
    "Technical support - Offer proactive technical assistance",
]
_LOYALTY = [
    "Continue excellent service - Maintain current service quality",
    "Loyalty rewards - Consider loyalty program or small perks",
    "Upselling opportunity - Customer is stable, consider service upgrades",
    "Regular check-ins - Schedule periodic satisfaction reviews",
    "Engagement programs - Invite to customer community or events",
]


def _recommendations_sql() -> str:
    out = " || ".join(
        [
            f"CASE WHEN risk_level IN ('High', 'Critical') THEN {_rec_sql(_OUTREACH)} ELSE [] END",
            f"CASE WHEN probability_churn > 0.7 THEN [{_q(_PRIORITY)}] ELSE [] END",
            f"CASE WHEN customer_segment = 'high_value_high_risk' THEN [{_q(_VIP)}] ELSE [] END",
            _rec_sql(_GENERAL),
        ]
    )
    return (
        f"array_to_string(CASE WHEN COALESCE(prediction, false) THEN {out} "
        f"ELSE {_rec_sql(_LOYALTY)} END, '|')"
    )


PREDICTION_RULES_SQL = with_subs(
    f"""
SELECT customer_id, prediction, probability_churn, probability_stay, confidence, risk_level,
       risk_level_probability, risk_level_display, is_high_risk, customer_segment,
       {_recommendations_sql()} AS recommendations
FROM (
  SELECT *,
    CASE WHEN probability_churn > 0.8 AND confidence > 0.7 THEN 'Critical'
         WHEN probability_churn > 0.6 AND confidence > 0.5 THEN 'High'
         WHEN probability_churn > 0.4 AND confidence > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM (
    SELECT customer_id, prediction, probability_churn,
      1.0 - probability_churn AS probability_stay,
      abs(2.0 * probability_churn - 1.0) AS confidence,
      CASE WHEN probability_churn < 0.3 THEN 'low' WHEN probability_churn < 0.5 THEN 'medium'
           WHEN probability_churn < 0.7 THEN 'high' ELSE 'critical' END AS risk_level_probability,
      CASE WHEN probability_churn < 0.4 THEN 'Low' WHEN probability_churn < 0.6 THEN 'Medium'
           WHEN probability_churn <= 0.8 THEN 'High' ELSE 'Critical' END AS risk_level_display,
      probability_churn >= 0.5 AS is_high_risk,
      (CASE WHEN monthly_charges > 70 THEN 'high' ELSE 'low' END) || '_value_' ||
      (CASE WHEN probability_churn >= 0.5 THEN 'high' ELSE 'low' END) || '_risk' AS customer_segment
    FROM rs) a) b
""",
    SCORED_CTES,
)


@register("prediction_rules", oracle=PREDICTION_RULES_SQL)
def q_prediction_rules(spark, sf_dir):
    """D9-D15, D18 on a scored table (stand-in probability = rule score / 100)."""
    s = fixtures.rule_scored(spark, sf_dir)
    p = F.col("probability_churn")
    out = s.select(
        "customer_id",
        "prediction",
        "probability_churn",
        rules.probability_stay(p).alias("probability_stay"),
        rules.confidence(p).alias("confidence"),
        rules.risk_level(p, "probability").alias("risk_level_probability"),
        rules.risk_level(p, "display").alias("risk_level_display"),
        rules.is_high_risk(p).alias("is_high_risk"),
        rules.prediction_segment(p).alias("customer_segment"),
        "monthly_charges",
    )
    out = out.withColumn("risk_level", rules.risk_level_confidence(p, F.col("confidence")))
    out = out.withColumn("recommendations", F.array_join(rules.recommendations(), "|"))
    return out.drop("monthly_charges")


# the 31 slots written out, as an independent check of functions/encoding.py
_ENCODING_SLOTS = """
  senior_citizen AS senior_citizen, partner AS partner, dependents AS dependents, phone_service AS phone_service,
  paperless_billing AS paperless_billing, lower(gender) = 'male' AS gender_male,
  multiple_lines = 'No phone service' AS multiple_lines_no_phone_service, multiple_lines = 'Yes' AS multiple_lines_yes,
  internet_service = 'Fiber optic' AS internet_service_fiber_optic, internet_service = 'Yes' AS internet_service_yes,
  online_security = 'No internet service' AS online_security_no_internet_service, online_security = 'Yes' AS online_security_yes,
  online_backup = 'No internet service' AS online_backup_no_internet_service, online_backup = 'Yes' AS online_backup_yes,
  device_protection = 'No internet service' AS device_protection_no_internet_service, device_protection = 'Yes' AS device_protection_yes,
  tech_support = 'No internet service' AS tech_support_no_internet_service, tech_support = 'Yes' AS tech_support_yes,
  streaming_tv = 'No internet service' AS streaming_tv_no_internet_service, streaming_tv = 'Yes' AS streaming_tv_yes,
  streaming_movies = 'No internet service' AS streaming_movies_no_internet_service, streaming_movies = 'Yes' AS streaming_movies_yes,
  contract_type = 'One year' AS contract_type_one_year, contract_type = 'Two year' AS contract_type_two_year,
  payment_method = 'Bank transfer (automatic)' AS payment_method_bank_transfer_automatic,
  payment_method = 'Credit card (automatic)' AS payment_method_credit_card_automatic,
  payment_method = 'Electronic check' AS payment_method_electronic_check,
  payment_method = 'Mailed check' AS payment_method_mailed_check"""


def _encoding_sql() -> str:
    return (
        "SELECT customer_id, CAST(COALESCE(COLUMNS(* EXCLUDE (customer_id, monthly_charges, total_charges, tenure_months)), false) AS INTEGER), "
        "monthly_charges, total_charges, CAST(tenure_months AS DOUBLE) AS tenure_months FROM (SELECT customer_id, "
        f"monthly_charges, total_charges, tenure_months, {_ENCODING_SLOTS} FROM {IMPUTED} x) e"
    )


@register("feature_encoding", oracle=with_subs(_encoding_sql()))
def q_feature_encoding(spark, sf_dir):
    """The 31-slot serving encoding per subscriber."""
    return features.encode_features(clean_subscribers(spark, sf_dir))


@register(
    "filter_results",
    oracle=with_subs(
        "SELECT customer_id, probability_churn, risk_level FROM ("
        "SELECT *, CASE WHEN probability_churn > 0.8 AND abs(2.0 * probability_churn - 1.0) > 0.7 THEN 'Critical' "
        "WHEN probability_churn > 0.6 AND abs(2.0 * probability_churn - 1.0) > 0.5 THEN 'High' "
        "WHEN probability_churn > 0.4 AND abs(2.0 * probability_churn - 1.0) > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level "
        "FROM rs) x WHERE prediction IN (true) AND risk_level IN ('High', 'Critical')",
        SCORED_CTES,
    ),
)
def q_filter_results(spark, sf_dir):
    """Scored rows with churn predicted and level High/Critical."""
    s = fixtures.rule_scored(spark, sf_dir).withColumn("risk_level", rules.risk_level("probability_churn"))
    return cleaning.filter_results(s, predictions=[True], risk_levels=["High", "Critical"]).select(
        "customer_id", "probability_churn", "risk_level"
    )


def _dated_subscribers(spark, sf_dir):
    """Subscribers with created_at / updated_at = first / last order time (stand-in)."""
    subs = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir))
    orders = fixtures.read_table(spark, sf_dir, "orders")
    span = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at")
    )
    return subs.join(span, fixtures.customer_key(F.col("customer_id")) == F.col("o_custkey"), "left").drop("o_custkey")


RECORD_TEXT_SQL = with_subs(
    f"SELECT {', '.join(REQUIRED_COLUMNS)}, "
    "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') AS updated_at "
    "FROM subs s LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS created_at, MAX(o_orderdate) AS updated_at "
    "FROM orders GROUP BY o_custkey) o "
    "ON CAST(regexp_extract(s.customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) = o.o_custkey"
)


@register("record_text", oracle=RECORD_TEXT_SQL)
def q_record_text(spark, sf_dir):
    """Project to the record fields with ISO-8601 timestamp text."""
    return cleaning.to_record(_dated_subscribers(spark, sf_dir))


@register("record_roundtrip", oracle=with_subs(f"SELECT {', '.join(REQUIRED_COLUMNS)} FROM subs"))
def q_record_roundtrip(spark, sf_dir):
    """Record text back to typed fields (from_record . to_record is the identity)."""
    back = cleaning.from_record(cleaning.to_record(_dated_subscribers(spark, sf_dir)))
    return back.select(*REQUIRED_COLUMNS)


@register("guarded_batch", oracle=with_subs("SELECT CAST(COUNT(*) AS BIGINT) AS rows_accepted FROM subs"))
def q_guarded_batch(spark, sf_dir):
    """V8 + V9: a batch passes the not-empty guard and the (unset) size guard."""
    df = cleaning.check_batch_size(cleaning.require_not_empty(fixtures.subscribers(spark, sf_dir)), None)
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows_accepted"))


@register(
    "validation_all_rules",
    oracle=with_subs(f"SELECT customer_id, error FROM (SELECT customer_id, {_errors_sql()} AS error FROM broken) e WHERE error <> ''",
                     fixtures.BROKEN_CTE),
)
def q_validation_all_rules(spark, sf_dir):
    """P1 + V2-V7: text cells that break each kind of rule, quarantined with their codes."""
    _, bad = cleaning.validate(cleaning.coerce_types(fixtures.broken_subscribers(spark, sf_dir)))
    return bad.select("customer_id", "error")


def _accepted(check) -> bool:
    try:
        check()
    except (cleaning.EmptyBatchError, cleaning.BatchTooLargeError):
        return False
    return True


@register(
    "guard_limits",
    oracle=with_subs(
        "SELECT 'at_limit' AS guard, CAST(COUNT(*) AS BIGINT) AS max_rows, true AS accepted FROM subs "
        "UNION ALL SELECT 'over_limit', CAST(COUNT(*) - 1 AS BIGINT), false FROM subs "
        "UNION ALL SELECT 'no_rows', CAST(NULL AS BIGINT), false"
    ),
)
def q_guard_limits(spark, sf_dir):
    """V8 + V9: a batch at its row limit passes; one row more, or no row, is refused."""
    subs = fixtures.subscribers(spark, sf_dir)
    n = subs.count()
    rows = [
        ("at_limit", n, _accepted(lambda: cleaning.check_batch_size(subs, n))),
        ("over_limit", n - 1, _accepted(lambda: cleaning.check_batch_size(subs, n - 1))),
        ("no_rows", None, _accepted(lambda: cleaning.require_not_empty(subs.filter("customer_id IS NULL")))),
    ]
    return spark.createDataFrame(rows, "guard string, max_rows bigint, accepted boolean")
