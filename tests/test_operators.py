"""Edge cases of the aggregate, table and monitoring operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retention.operators import analytics, cleaning, monitoring, ordered, tables
from retention.schema import METRICS_SCHEMA, SUBSCRIBER_SCHEMA
from tests.test_rules import EX1, frame


def test_empty_table_gives_zeros(spark):
    empty = spark.createDataFrame([], SUBSCRIBER_SCHEMA)
    seg = analytics.segment_metrics(empty).collect()
    assert len(seg) == 6 and all(r.customer_count == 0 and r.total_revenue == 0.0 for r in seg)
    (s,) = analytics.summary_statistics(empty).collect()
    assert (s.total_customers, s.churn_rate, s.average_tenure) == (0, 0.0, 0.0)
    with pytest.raises(cleaning.EmptyBatchError):
        cleaning.require_not_empty(empty)


def test_batch_size_guard(spark):
    df = spark.range(5)
    cleaning.check_batch_size(df, 5)
    with pytest.raises(cleaning.BatchTooLargeError):
        cleaning.check_batch_size(df, 4)


def test_all_invalid_batch(spark):
    bad = frame(spark, dict(EX1, gender="X", monthly_charges=-1.0))
    ok, q = cleaning.validate(bad)
    assert ok.count() == 0
    assert q.first().error == "invalid_gender,monthly_charges_not_positive"


def test_running_totals_match_global_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g"),
                                     F.lit(1).alias("one"))
    agg = df.groupBy("g", "v").agg(F.sum("one").alias("n"))
    out = ordered.running_totals(agg, "v", ["n"], groups=["g"], num_partitions=7).collect()
    by_g = {}
    for r in sorted(out, key=lambda r: (r.g, r.v)):
        by_g.setdefault(r.g, 0)
        by_g[r.g] += r.n
        assert r.cum_n == by_g[r.g]
    assert all(r.total_n == by_g[r.g] for r in out)


def test_exact_median(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 3, 3, 9, 10]], "p double")
    assert ordered.exact_median(df, "p").first().median == 4.0
    df2 = spark.createDataFrame([(float(x),) for x in [5, 1, 3]], "p double")
    assert ordered.exact_median(df2, "p").first().median == 3.0


def test_new_ids(spark):
    base = spark.createDataFrame([("CUST-0007",), ("CUST-12-3",), ("X-99",), (None,)], "customer_id string")
    rows = spark.createDataFrame([(None, 2), (None, 1), ("CUST-0100", 3)], "customer_id string, seq int")
    out = {r.seq: r.customer_id for r in tables.assign_new_ids(base.select("customer_id"), rows, "seq").collect()}
    assert out == {1: "CUST-0013", 2: "CUST-0014", 3: "CUST-0100"}
    empty = spark.createDataFrame([], "customer_id string")
    out = tables.assign_new_ids(empty, rows.filter("seq = 1"), "seq").first()
    assert out.customer_id == "CUST-0001"


def test_upsert_keeps_latest_and_unchanged_columns(spark):
    base = spark.createDataFrame([("A", 1.0, "x"), ("B", 2.0, "y")], "customer_id string, v double, note string")
    changes = spark.createDataFrame([("A", 5.0, 1), ("A", 6.0, 2), ("C", 7.0, 1)], "customer_id string, v double, seq int")
    out = {r.customer_id: (r.v, r.note) for r in tables.upsert(base, changes, "seq").collect()}
    assert out == {"A": (6.0, "x"), "B": (2.0, "y"), "C": (7.0, None)}
    remaining, report = tables.delete(base, spark.createDataFrame([("A",), ("Z",)], "customer_id string"))
    assert [r.customer_id for r in remaining.collect()] == ["B"]
    assert {(r.customer_id, r.deleted) for r in report.collect()} == {("A", True), ("Z", False)}


def _log(spark, model_id, accs):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(model_id, t0 + dt.timedelta(days=i), a, a, a, a, "1.0.0", f"{model_id}-{i:03d}") for i, a in enumerate(accs)]
    return spark.createDataFrame(rows, METRICS_SCHEMA)


def test_degradation_fleet(spark):
    stable = _log(spark, "stable", [0.85] * 12)
    falling = _log(spark, "falling", [0.9] * 7 + [0.85, 0.8, 0.75, 0.7, 0.65])
    short = _log(spark, "short", [0.9] * 4)
    odd = _log(spark, "six", [0.8, 0.8, 0.8, 0.8, 0.0, 0.7])
    out = {r.model_id: r for r in monitoring.performance_degradation(stable.union(falling).union(short).union(odd)).collect()}
    assert "short" not in out
    assert out["stable"].severity == "NONE" and out["stable"].trend == "stable"
    f = out["falling"]
    assert f.window_size == 5 and f.baseline_accuracy == pytest.approx(0.9)
    assert f.recent_accuracy == pytest.approx(0.75)
    assert f.max_degradation == pytest.approx(1 / 6) and f.severity == "HIGH" and f.trend == "decreasing"
    s = out["six"]  # n=6: w=3, baseline=3 rows; the 0.0 run is skipped in the means
    assert s.window_size == 3 and s.recent_accuracy == pytest.approx(0.75) and s.trend == "unknown"


def test_retain_newest(spark):
    from retention.sources.writers import retain_newest

    log = _log(spark, "m", [0.5 + i / 1000 for i in range(60)])
    kept = retain_newest(log, 50).collect()
    assert len(kept) == 50 and min(r.run_id for r in kept) == "m-010"


def test_ks_identical_and_shifted(spark):
    a = spark.range(0, 500).select((F.col("id") / 10).alias("x"))
    b = spark.range(0, 500).select((F.col("id") / 10 + 100).alias("x"))
    same = monitoring.ks_two_sample(a, a, ["x"]).first()
    assert same.ks_statistic == 0.0 and same.ks_pvalue == 1.0
    far = monitoring.ks_two_sample(a, b, ["x"]).first()
    assert far.ks_statistic == 1.0 and far.ks_pvalue < 1e-10


def test_alerts(spark):
    drift = spark.createDataFrame([(True, "HIGH", "warn")], "drift_detected boolean, severity string, action string")
    metrics = spark.createDataFrame([("m1", 0.79, 0.9, 0.9, 0.9)], "model_id string, accuracy double, precision double, recall double, f1_score double")
    out = monitoring.alerts(drift, None, metrics, None).collect()
    assert {(r.type, r.severity) for r in out} == {("DATA_DRIFT", "HIGH"), ("LOW_ACCURACY", "WARNING")}


def test_checkpoint_root_fallback_does_not_touch_conf():
    """Where spark.checkpoint.dir is unset, one folder per application is registered
    with the context; the (unmodifiable) core setting itself is never written."""
    from retention import session

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):  # pragma: no cover - must not be called
            raise AssertionError("core config written")

    class Ctx:
        applicationId = "app-test-fallback"
        _dir = None

        def getCheckpointDir(self):
            return self._dir

        def setCheckpointDir(self, d):
            self._dir = d

    class Sess:
        conf = Conf()
        sparkContext = Ctx()

    s = Sess()
    root = session.checkpoint_root(s)
    assert s.sparkContext.getCheckpointDir() == root
    assert session.checkpoint_root(s) == root
    assert session.scratch_path(s, "t").startswith(root.rstrip("/") + "/t-")


def test_drift_stop_action(spark):
    from retention.config import Thresholds

    t = Thresholds(drift_action="stop")
    num = spark.createDataFrame([(True, "CRITICAL")], "drift_detected boolean, severity string")
    lab = spark.createDataFrame([], "drift_detected boolean, severity string")
    cat = spark.createDataFrame([], "drift_detected boolean")
    summary = monitoring.drift_summary(num, lab, cat, t)
    assert summary.first().action == "stop"
    with pytest.raises(monitoring.DriftStop):
        monitoring.enforce_drift_action(summary, t)
    warn = monitoring.drift_summary(num, lab, cat)
    assert monitoring.enforce_drift_action(warn).first().action == "warn"


def test_quality_and_validation_gates(spark):
    from retention.operators import model

    small = frame(spark, EX1)
    with pytest.raises(analytics.DataQualityError):
        analytics.require_quality(analytics.data_quality_profile(small))
    missing = small.drop("payment_method")
    prof = analytics.data_quality_profile(missing).first()
    assert prof.missing_columns == "payment_method" and prof.missing_columns_error
    good = spark.createDataFrame([(0.9, 0.8, 0.7, 0.75)], "accuracy double, precision double, recall double, f1_score double")
    bad = spark.createDataFrame([(0.9, 0.6, 0.7, 0.65)], "accuracy double, precision double, recall double, f1_score double")
    model.require_valid(model.validation_summary(model.validate_metrics(good)))
    with pytest.raises(model.ModelValidationError):
        model.require_valid(model.validation_summary(model.validate_metrics(bad)))
    fails = {r.metric: r.passed for r in model.validate_metrics(bad).collect()}
    assert fails == {"accuracy": True, "precision": False, "recall": True}


def test_exact_split_counts_per_class(spark):
    from retention import fixtures
    from retention.operators import model

    df = fixtures.clean_subscribers(spark, "/root/testdata/sf0.01").filter(F.col("churn").isNotNull())
    out = model.stratified_split(df, exact=True).groupBy("churn").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("test")
    )
    for r in out.collect():
        assert r.test == int(r.n * 0.2 + 0.5)
    hashed = model.stratified_split(df).agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.15 < hashed < 0.25


def test_approximate_median_option(spark):
    df = spark.range(1, 1002).select(F.col("id").cast("double").alias("probability_churn"))
    exact = analytics.probability_stats(df).first()
    approx = analytics.probability_stats(df, exact=False).first()
    assert exact.median == 501.0 and abs(approx.median - 501.0) <= 1.0
    assert exact.mean == approx.mean and exact.std == approx.std
