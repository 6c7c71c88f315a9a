"""Registered queries: rule features and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import rules
from ..operators import analytics, cleaning, features
from .catalog import register
from .sql_fragments import FEATURES_CTE, with_subs


clean_subscribers = fixtures.clean_subscribers


@register(
    "segment_metrics",
    oracle=with_subs(
        """
SELECT names.segment,
       CAST(COALESCE(a.n, 0) AS BIGINT) AS customer_count,
       COALESCE(a.mc_sum / a.n / 100.0, 0.0) AS avg_monthly_charges,
       COALESCE(a.t_sum / a.n, 0.0) AS avg_tenure_months,
       COALESCE(a.rev / 100.0, 0.0) AS total_revenue
FROM (VALUES ('high_value_low_risk'), ('high_value_high_risk'), ('low_value_low_risk'),
             ('low_value_high_risk'), ('new_customers'), ('churned')) AS names(segment)
LEFT JOIN (
  SELECT segment, COUNT(*) AS n, SUM(mc) AS mc_sum, SUM(tenure_months) AS t_sum, SUM(mc * tenure_months) AS rev
  FROM (SELECT segment, CAST(round(monthly_charges * 100) AS BIGINT) AS mc, tenure_months FROM rules) g
  GROUP BY segment) a ON a.segment = names.segment
""",
        FEATURES_CTE,
    ),
)
def q_segment_metrics(spark, sf_dir):
    """A2 over D3 -> D7 -> D8 on the cleaned subscriber table."""
    return analytics.segment_metrics(features.add_rule_features(clean_subscribers(spark, sf_dir)))


@register(
    "rule_features",
    oracle=with_subs(
        """
SELECT customer_id, is_high_value, has_premium_services, service_count, services_count_raw,
       avg_monthly_charge, lifetime_value, risk_score, segment
FROM rules
""",
        FEATURES_CTE.replace("FROM subs)", "FROM (SELECT * REPLACE (COALESCE(total_charges, monthly_charges * tenure_months) AS total_charges) FROM subs))", 1),
    ),
)
def q_rule_features(spark, sf_dir):
    """D1-D8 per subscriber (after P1/P2)."""
    df = features.add_rule_features(clean_subscribers(spark, sf_dir))
    return df.select(
        "customer_id", "is_high_value", "has_premium_services", "service_count", "services_count_raw",
        "avg_monthly_charge", "lifetime_value", "risk_score", "segment",
    )


@register(
    "at_risk_customers",
    oracle=with_subs(
        "SELECT customer_id, risk_score, monthly_charges, tenure_months FROM rules "
        "WHERE NOT COALESCE(churn, false) AND risk_score >= 70",
        FEATURES_CTE,
    ),
)
def q_at_risk(spark, sf_dir):
    """A1: active (or unlabelled) subscribers with rule score >= 70."""
    df = features.add_rule_features(clean_subscribers(spark, sf_dir))
    return analytics.at_risk(df).select("customer_id", "risk_score", "monthly_charges", "tenure_months")


@register(
    "summary_statistics",
    oracle=with_subs(
        """
SELECT CAST(COUNT(*) AS BIGINT) AS total_customers,
       CAST(COUNT(*) FILTER (WHERE churn) AS BIGINT) AS churned_customers,
       COALESCE(COUNT(*) FILTER (WHERE churn) / NULLIF(COUNT(*), 0), 0.0) AS churn_rate,
       COALESCE(SUM(tenure_months) / COUNT(tenure_months), 0.0) AS average_tenure,
       COALESCE(SUM(CAST(round(monthly_charges * 100) AS BIGINT)) / COUNT(monthly_charges) / 100.0, 0.0)
         AS average_monthly_charges
FROM subs
"""
    ),
)
def q_summary_statistics(spark, sf_dir):
    """A3/A4: totals, churned count, churn rate over all rows, averages."""
    return analytics.summary_statistics(cleaning.coerce_types(fixtures.subscribers(spark, sf_dir)))


from ..operators import evaluation, model  # noqa: E402
from .sql_fragments import IMPUTED_FEATURES_CTE as _IMPUTED_FC  # noqa: E402
from .sql_fragments import RISK_LEVEL_SQL as _RL  # noqa: E402
from .sql_fragments import SCORED_CTES as _SCORED  # noqa: E402
from .sql_fragments import errors_sql as _errors_sql  # noqa: E402


def _nulls_sql() -> str:
    from ..schema import REQUIRED_COLUMNS as _R

    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, COUNT(*) AS n FROM subs" for c in _R
    )
    return (
        "SELECT column_name, CAST(null_count AS BIGINT) AS null_count, "
        "COALESCE(null_count / NULLIF(n, 0), 0.0) AS null_share, null_count > n * 0.10 AS high_nulls FROM (" + rows + ") x"
    )


@register("null_profile", oracle=with_subs(_nulls_sql()))
def q_null_profile(spark, sf_dir):
    """A5: nulls per column in one pass (unpivoted)."""
    return analytics.null_profile(cleaning.coerce_types(fixtures.subscribers(spark, sf_dir)))


def _quality_sql() -> str:
    from ..schema import REQUIRED_COLUMNS as _R

    nulls = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in _R)
    return f"""
SELECT total_samples, '' AS missing_columns, missing_values, COALESCE(cr, 0.0) AS churn_rate,
       COALESCE(LEAST(cr, ar), 0.0) AS minority_share, COALESCE(LEAST(cr, ar) < 0.1, false) AS imbalance_warning,
       total_samples < 100 AS too_small_error, false AS missing_columns_error
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS total_samples, CAST({nulls} AS BIGINT) AS missing_values,
             COUNT(*) FILTER (WHERE churn) / NULLIF(COUNT(churn), 0) AS cr,
             COUNT(*) FILTER (WHERE NOT churn) / NULLIF(COUNT(churn), 0) AS ar FROM subs) x"""


@register("data_quality_profile", oracle=with_subs(_quality_sql()))
def q_data_quality(spark, sf_dir):
    """A5: size, missing columns, total nulls, class shares and warnings (one row)."""
    return analytics.data_quality_profile(cleaning.coerce_types(fixtures.subscribers(spark, sf_dir)))


@register(
    "batch_summary",
    oracle=with_subs(
        f"""
SELECT CAST(COUNT(*) AS BIGINT) AS processed_count, CAST(COUNT(*) FILTER (WHERE prediction) AS BIGINT) AS high_risk_count,
       CAST(COUNT(*) FILTER (WHERE NOT prediction) AS BIGINT) AS low_risk_count,
       COALESCE(COUNT(*) FILTER (WHERE prediction) * 100.0::DOUBLE / NULLIF(COUNT(*), 0), 0.0) AS predicted_churn_pct,
       round(AVG(abs(2.0 * probability_churn - 1.0)), 6) AS avg_confidence,
       CAST(COUNT(*) FILTER (WHERE {_RL} IN ('High', 'Critical')) AS BIGINT) AS high_risk_level_count,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM rse WHERE error <> '') AS error_count
FROM rse WHERE error = ''""",
        _SCORED + ",\nrse AS (SELECT *, " + _errors_sql() + " AS error FROM rs)",
    ),
)
def q_batch_summary(spark, sf_dir):
    """Summary of a scored batch; quarantined (V1) rows counted as errors."""
    s = fixtures.rule_scored(spark, sf_dir)
    ok, bad = cleaning.validate(s)
    ok = ok.withColumn("confidence", rules.confidence("probability_churn")).withColumn("risk_level", rules.risk_level("probability_churn"))
    out = analytics.batch_summary(ok, bad)
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@register(
    "risk_level_distribution",
    oracle=with_subs(
        f"SELECT value, CAST(COUNT(*) AS BIGINT) AS count, COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM rs) AS percent "
        f"FROM (SELECT {_RL} AS value FROM rs) x GROUP BY value",
        _SCORED,
    ),
)
def q_risk_distribution(spark, sf_dir):
    """Count and percent per risk level, most frequent first."""
    s = fixtures.rule_scored(spark, sf_dir).withColumn("risk_level", rules.risk_level("probability_churn"))
    return analytics.distribution(s, "risk_level")


@register(
    "segment_distribution",
    oracle=with_subs(
        "SELECT segment AS value, CAST(COUNT(*) AS BIGINT) AS count, COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM rules) AS percent "
        "FROM rules GROUP BY segment",
        _IMPUTED_FC,
    ),
)
def q_segment_distribution(spark, sf_dir):
    """Count and percent per rule segment."""
    return analytics.distribution(features.add_rule_features(clean_subscribers(spark, sf_dir)), "segment")


@register(
    "probability_histogram",
    oracle=with_subs(
        """
SELECT b.bin, b.bin / 20.0::DOUBLE AS bin_start, (b.bin + 1) / 20.0::DOUBLE AS bin_end, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b
LEFT JOIN (SELECT CAST(LEAST(FLOOR(probability_churn * 20), 19) AS INTEGER) AS bin, COUNT(*) AS n FROM rs
           WHERE probability_churn IS NOT NULL GROUP BY 1) c ON c.bin = b.bin""",
        _SCORED,
    ),
)
def q_histogram(spark, sf_dir):
    """20 equal-width probability bins (all present)."""
    return analytics.probability_histogram(fixtures.rule_scored(spark, sf_dir))


@register(
    "probability_stats",
    oracle=with_subs(
        "SELECT round(AVG(probability_churn), 6) AS mean, round(MEDIAN(probability_churn), 6) AS median, "
        "round(STDDEV_SAMP(probability_churn), 6) AS std, MIN(probability_churn) AS min, MAX(probability_churn) AS max FROM rs",
        _SCORED,
    ),
)
def q_probability_stats(spark, sf_dir):
    """Mean, exact interpolated median (distributed), sample std, min, max."""
    st = analytics.probability_stats(fixtures.rule_scored(spark, sf_dir))
    return st.select(*[F.round(c, 6).alias(c) if c in ("mean", "median", "std") else F.col(c) for c in st.columns])


SPLIT_SQL = "substr(md5(customer_id || '42'), 1, 8) < '33333333'"


@register(
    "stratified_split",
    oracle=with_subs(f"SELECT customer_id, churn, {SPLIT_SQL} AS is_test FROM subs WHERE churn IS NOT NULL"),
)
def q_split(spark, sf_dir):
    """Hash-based test/train assignment (share 0.2, seed 42), no shuffle."""
    df = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir)).filter(F.col("churn").isNotNull())
    return model.stratified_split(df).select("customer_id", "churn", "is_test")


@register(
    "stratified_split_exact",
    oracle=with_subs(
        """
SELECT customer_id, churn, rn <= round(n * 0.2) AS is_test FROM (
  SELECT customer_id, churn,
         row_number() OVER (PARTITION BY churn ORDER BY substr(md5(customer_id || '42'), 1, 8) || customer_id) AS rn,
         COUNT(*) OVER (PARTITION BY churn) AS n
  FROM subs WHERE churn IS NOT NULL) x"""
    ),
)
def q_split_exact(spark, sf_dir):
    """T1 exact: per class exactly round(0.2 n) test rows by hash order (distributed)."""
    df = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir)).filter(F.col("churn").isNotNull())
    return model.stratified_split(df, exact=True).select("customer_id", "churn", "is_test")


@register(
    "class_weights",
    oracle=with_subs(
        "SELECT churn, CAST(COUNT(*) AS BIGINT) AS n_class, "
        "(SELECT COUNT(*) FROM subs WHERE churn IS NOT NULL) / (2.0::DOUBLE * COUNT(*)) AS class_weight "
        "FROM subs WHERE churn IS NOT NULL GROUP BY churn"
    ),
)
def q_class_weights(spark, sf_dir):
    """Balanced class weights."""
    return model.class_weights(cleaning.coerce_types(fixtures.subscribers(spark, sf_dir)))


@register(
    "evaluation_metrics",
    oracle=with_subs(
        """
SELECT CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tn AS BIGINT) AS tn,
       CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END AS accuracy, p AS precision, r AS recall,
       CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0 END AS f1_score,
       round((SELECT SUM(pos * (cneg - neg + neg * 0.5::DOUBLE)) / (SUM(pos) * MAX(tneg)) FROM auc), 6) AS roc_auc
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r
      FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE churn AND prediction) AS tp,
                   COUNT(*) FILTER (WHERE NOT churn AND prediction) AS fp,
                   COUNT(*) FILTER (WHERE churn AND NOT prediction) AS fn,
                   COUNT(*) FILTER (WHERE NOT churn AND NOT prediction) AS tn
            FROM rs WHERE churn IS NOT NULL) c) m""",
        _SCORED
        + """,
sc AS (SELECT probability_churn AS s, COUNT(*) FILTER (WHERE churn) AS pos, COUNT(*) FILTER (WHERE NOT churn) AS neg
       FROM rs WHERE churn IS NOT NULL GROUP BY probability_churn),
auc AS (SELECT pos, neg, SUM(neg) OVER (ORDER BY s) AS cneg, SUM(neg) OVER () AS tneg FROM sc)""",
    ),
)
def q_evaluation(spark, sf_dir):
    """T5 on a fixed score column: confusion counts, accuracy/precision/recall/F1, mid-rank AUC."""
    m = evaluation.evaluate(fixtures.rule_scored(spark, sf_dir))
    return m.withColumn("roc_auc", F.round("roc_auc", 6))
