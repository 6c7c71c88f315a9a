"""Registered queries: drift from stored profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..operators import cleaning, drift_profile
from ..session import scratch_path
from .catalog import register
from .q_monitoring import (
    CATEGORICAL_BODY, LABEL_BODY, ROUND6, SHIFT, _categorical_ctes, _drift_summary_ctes, _numeric_drift_sql, _pair,
)
from .sql_fragments import with_subs


def _profiles(spark, pair):
    return [drift_profile.write_profile(df, scratch_path(spark, "profile")) for df in pair]


def _mixed_profiles(spark, sf_dir):
    return _profiles(spark, [cleaning.coerce_types(df) for df in fixtures.mixed_pair(spark, sf_dir)])


@register("profile_numeric_drift", oracle=_numeric_drift_sql(SHIFT))
def q_profile_numeric_drift(spark, sf_dir):
    """M1 + M2 of the shifted pair from two stored profiles; equal to the result over the rows."""
    d = drift_profile.numeric_drift(*_profiles(spark, _pair(spark, sf_dir, SHIFT)))
    return d.select(*[F.round(c, 6).alias(c) if c in ROUND6 else F.col(c) for c in d.columns])


@register(
    "profile_categorical_drift",
    oracle=with_subs(
        f'SELECT "column", round(total_variation_distance, 9) AS total_variation_distance, drift_detected, severity FROM ({CATEGORICAL_BODY}) c',
        fixtures.MIXED_PAIR_CTES + ",\n" + _categorical_ctes()),
)
def q_profile_categorical_drift(spark, sf_dir):
    """M3 of a pair with other shares, from two stored profiles."""
    found = drift_profile.categorical_drift(*_mixed_profiles(spark, sf_dir), report_all=True)
    return found.withColumn("total_variation_distance", F.round("total_variation_distance", 9))


@register("profile_label_drift", oracle=with_subs(LABEL_BODY, fixtures.MIXED_PAIR_CTES))
def q_profile_label_drift(spark, sf_dir):
    """M4 of a pair with other shares, from two stored profiles."""
    return drift_profile.label_drift(*_mixed_profiles(spark, sf_dir))


@register("profile_drift_summary", oracle=with_subs("SELECT drift_detected, severity, action FROM dsum", _drift_summary_ctes()))
def q_profile_drift_summary(spark, sf_dir):
    """S7 + M5: the reference profile merged from the profiles of three parts of the reference,
    stored once and loaded again, against the profile of the shifted current side."""
    cur, ref = _pair(spark, sf_dir, SHIFT)
    k = F.pmod(F.xxhash64("customer_id"), F.lit(3))
    parts = _profiles(spark, [ref.filter(k == i) for i in range(3)])
    path = scratch_path(spark, "reference-profile")
    drift_profile.merge_profiles(parts, path)
    reference, _ = drift_profile.create_or_load_profile(spark, cur, path)
    return drift_profile.drift_summary(*_profiles(spark, [cur]), reference)
