"""Drift from stored profiles equals drift over the rows, and reads no row."""

import pytest

from retention import fixtures
from retention.operators import cleaning, drift_profile, monitoring
from retention.session import scratch_path
from tests.conftest import SF_SMALL
from tests.test_plans import assert_no_global_order, plan_text


def _rounded(df):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())


def _write(spark, df, **kw):
    return drift_profile.write_profile(df, scratch_path(spark, "profile"), **kw)


@pytest.fixture(scope="module")
def pair(spark):
    return [cleaning.coerce_types(df) for df in fixtures.drift_pair(spark, SF_SMALL, 60.0)]


def test_equal_to_the_rows(spark, pair):
    cur, ref = (_write(spark, df) for df in pair)
    assert _rounded(drift_profile.numeric_drift(cur, ref)) == _rounded(monitoring.numeric_drift(*pair))
    assert _rounded(drift_profile.categorical_drift(cur, ref, report_all=True)) == _rounded(monitoring.categorical_drift(*pair, report_all=True))
    assert _rounded(drift_profile.label_drift(cur, ref)) == _rounded(monitoring.label_drift(*pair))


def test_merged_parts_equal_the_whole(spark, pair):
    rows = pair[0]
    parts = [_write(spark, p) for p in rows.randomSplit([0.2, 0.5, 0.3], 7)]
    merged = drift_profile.merge_profiles(parts, scratch_path(spark, "merged"))
    whole = _write(spark, rows)
    order = ["kind", "column", "num", "text"]
    assert merged.values.select(*order, "n").exceptAll(whole.values.select(*order, "n")).isEmpty()
    assert merged.values.count() == whole.values.count()
    assert _rounded(merged.columns.na.fill(0.0)) == _rounded(whole.columns.na.fill(0.0))


def test_a_drift_run_reads_profiles_only(spark, pair):
    path = scratch_path(spark, "reference")
    _, created = drift_profile.create_or_load_profile(spark, pair[1], path)
    again, repeated = drift_profile.create_or_load_profile(spark, pair[0], path)  # the stored one stays
    assert created and not repeated
    cur = _write(spark, pair[0])
    plan = drift_profile.drift_summary(cur, again)
    files = {f.split("/values/")[0].split("/columns/")[0].rsplit("/", 1)[1] for f in plan.inputFiles()}
    assert len(files) == 2 and all("profile" in f or "reference" in f for f in files)
    assert_no_global_order(plan_text(drift_profile.categorical_drift(cur, again)))
    building = plan_text(drift_profile._value_counts(pair[1], [("number", "monthly_charges"), ("category", "gender"), ("label", "churn")]))
    assert building.count("FileScan") == 1 and "partial_count" in building


def test_nulls_nan_empty_and_missing_columns(spark):
    schema = "tenure_months int, monthly_charges double, gender string, churn boolean, extra string"
    rows = [(1, 2.0, "F", True, "x"), (1, float("nan"), None, False, None), (None, None, None, None, None), (3, 2.0, "M", True, "y")]
    df, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    ref = spark.createDataFrame([(4, 1.0, "F", False), (4, 1.5, "F", True)], "tenure_months int, monthly_charges double, gender string, churn boolean")
    for a, b in ((df, ref), (none, ref), (ref.drop("gender"), df)):
        x, y = _write(spark, a), _write(spark, b)
        for one, two in ((drift_profile.numeric_drift(x, y), monitoring.numeric_drift(a, b)),
                         (drift_profile.label_drift(x, y), monitoring.label_drift(a, b))):
            assert str(_rounded(one)) == str(_rounded(two))
        if "gender" in a.columns:
            assert _rounded(drift_profile.categorical_drift(x, y, report_all=True)) == _rounded(monitoring.categorical_drift(a, b, report_all=True))
    with pytest.raises(ValueError):
        _write(spark, df.select("extra"))
