"""Plan checks: no Python UDFs in SQL-checked queries, no single-partition windows in
the distributed order operators, filters reach the parquet scan."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from retention import fixtures
from retention.operators import monitoring, ordered
from tests.conftest import SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_feeds(text):
    """Operators that consume a single-partition exchange.  A final global aggregate of
    per-task partial rows is fine; a window or sort over all rows is not."""
    lines = text.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and i + 1 < len(lines):
            out.append(lines[i + 1].strip().lstrip("+- :").split("(")[0].split(" ")[0])
    return out


def assert_no_global_order(text):
    for child in single_partition_feeds(text):
        assert child == "HashAggregate", f"single-partition exchange feeds {child}"
    assert "partial_" in text or "SinglePartition" not in text


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_python_udf(spark, name):
    text = plan_text(entry.queries()[name](spark, SF_SMALL))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert marker not in text, f"{name} runs Python per row: {marker}"


def test_ks_has_no_single_partition_window(spark):
    cur, ref = fixtures.drift_pair(spark, SF_SMALL, 60.0)
    text = plan_text(monitoring.ks_two_sample(cur, ref, ["monthly_charges"]))
    assert_no_global_order(text)
    assert "rangepartitioning" not in text.lower()  # ranges are literals: no sampled exchange whose bounds could differ


def test_median_and_sequence_have_no_single_partition(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("p"))
    assert_no_global_order(plan_text(ordered.exact_median(df, "p")))
    assert_no_global_order(plan_text(ordered.sequence_numbers(df, "p")))


def test_point_lookup_pushes_filter(spark):
    from retention.operators import cleaning

    df = cleaning.find_by_id(fixtures.subscribers(spark, SF_SMALL), "CUST-0000042")
    text = plan_text(df)
    assert "PushedFilters: [IsNotNull(customer_id), EqualTo(customer_id,CUST-0000042)]" in text


def test_top_rows_per_model_limited_before_shuffle(spark):
    log = fixtures.metric_log(spark, SF_SMALL)
    text = plan_text(monitoring.performance_degradation(log))
    assert "WindowGroupLimit" in text


def test_latest_version_and_update_plans(spark):
    from retention.operators import tables

    base, changes = fixtures.change_feed(spark, SF_SMALL)
    text = plan_text(tables.latest_per_key(changes, "change_seq"))
    assert "WindowGroupLimit" in text and "SortAggregate" not in text
    assert "Subquery" not in plan_text(tables.update_existing(base, changes, "change_seq")[0])  # no new ids are planned


def test_report_is_one_lazy_plan(spark):
    from retention.operators import analytics

    data = fixtures.subscribers(spark, SF_SMALL)
    metrics = spark.createDataFrame([(0.9, 0.8, 0.7, 0.6)], "accuracy double, precision double, recall double, f1_score double")
    checks = spark.createDataFrame([(True,), (False,)], "passed boolean")
    row = analytics.run_report(data, data.limit(7), metrics, checks).first()
    assert (row.processed_samples, row.precision, row.validation_passed) == (7, 0.8, False)
    assert row.original_samples == row.total_samples == data.count()


def test_bucketed_base_is_not_shuffled_by_upsert(spark):
    """With the base stored bucketed by id, the anti join reads it in place (only the
    change set is shuffled), even when neither side may be broadcast."""
    import uuid

    from retention.operators import tables
    from retention.session import scratch_path
    from retention.sources.writers import save_bucketed

    base, changes = fixtures.change_feed(spark, SF_SMALL)
    name = f"subs_bucketed_{uuid.uuid4().hex[:8]}"
    stored = save_bucketed(base, name, scratch_path(spark, "bucketed"), buckets=8)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        out = tables.upsert(stored, changes, "change_seq")
        lines = plan_text(out).splitlines()
        j = next(i for i, l in enumerate(lines) if "SortMergeJoin" in l and "LeftAnti" in l)
        scan = next(i for i in range(j, len(lines)) if f"default.{name}" in lines[i])
        assert not any("Exchange" in l for l in lines[j + 1:scan])
        assert out.count() == tables.upsert(base, changes, "change_seq").count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
