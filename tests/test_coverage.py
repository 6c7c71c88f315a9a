"""The registered queries meet every rule code, severity and trend, not only the common ones."""

import __spark_entry__ as entry
from retention.functions.validation import rule_checks
from tests.conftest import SF_SMALL


def _values(spark, name, column):
    return {r[0] for r in entry.queries()[name](spark, SF_SMALL).select(column).distinct().collect()}


def test_each_kind_of_rule_breaks_some_row(spark):
    seen = {code for text in _values(spark, "validation_all_rules", "error") for code in text.split(",")}
    ranges = {code for _, code in rule_checks() if not code.startswith(("missing_", "invalid_"))}
    assert ranges <= seen
    assert {"invalid_gender", "invalid_contract_type", "invalid_payment_method"} <= seen
    # cells without a value, and cells not readable as number, flag or whole months
    assert {"missing_contract_type", "missing_monthly_charges", "missing_partner", "missing_tenure_months"} <= seen


def test_every_trend_and_degradation_severity_occurs(spark):
    assert _values(spark, "degradation_cases", "trend") >= {"stable", "unknown", "insufficient_data"}
    moving = _values(spark, "performance_degradation", "trend") | _values(spark, "degradation_cases", "trend")
    assert moving >= {"increasing", "decreasing"}
    assert {"NONE", "CRITICAL"} <= _values(spark, "degradation_cases", "severity")


def test_drift_severities_occur(spark):
    assert _values(spark, "categorical_drift_mixed", "severity") == {"NONE", "LOW", "MEDIUM"}
    assert _values(spark, "label_drift_mixed", "severity") == {"HIGH"}
    assert entry.queries()["drift_stop"](spark, SF_SMALL).first()["stopped"]


def test_registry_gate_has_passing_and_failing_versions(spark):
    row = entry.queries()["registry_gate"](spark, SF_SMALL).first()
    assert 0 < row["passing"] < row["registered"] and row["current_version"]
