"""Derived columns (D1-D8, D16) added to a typed subscriber table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import rules
from ..functions.encoding import feature_columns


def add_rule_features(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """D1-D8 in one projection: service count is computed once and reused by the score,
    the score once and reused by the segment (Catalyst collapses the chain)."""
    return (
        df.withColumn("is_high_value", rules.is_high_value(t))
        .withColumn("has_premium_services", rules.has_premium_services())
        .withColumn("service_count", rules.service_count())
        .withColumn("services_count_raw", rules.services_count_raw())
        .withColumn("avg_monthly_charge", rules.avg_monthly_charge())
        .withColumn("lifetime_value", rules.lifetime_value())
        .withColumn("risk_score", rules.risk_score(F.col("service_count")))
        .withColumn("segment", rules.rule_segment(F.col("risk_score"), t))
    )


def encode_features(df: DataFrame, keep: tuple[str, ...] = ("customer_id",)) -> DataFrame:
    """The 31 serving feature columns (plus ``keep`` columns)."""
    return df.select(*[F.col(k) for k in keep if k in df.columns], *feature_columns())
