"""The composed training run: first run stores the reference, a second run on shifted
data reports drift and appends to the same metric log and registry."""

from pyspark.sql import functions as F

from retention import fixtures
from retention.operators.training_run import training_run
from retention.session import scratch_path

SF = "/root/testdata/sf0.01"


def test_two_runs(spark):
    subs = fixtures.subscribers(spark, SF)
    first_dir = scratch_path(spark, "run1")
    r1 = training_run(spark, subs, first_dir, run_id="r1")
    assert r1["drift"].first().severity == "NONE"
    assert r1["model_metrics"].count() == 1
    assert r1["report"].first().total_samples == 1500
    # monthly charges are ~uniform on 20..120 (std ~29): +150 is about 5 reference std
    shifted = subs.withColumn("monthly_charges", F.col("monthly_charges") + F.lit(150.0))
    r2 = training_run(
        spark, shifted, scratch_path(spark, "run2"), run_id="r2",
        reference_path=first_dir + "/reference", metrics_log_path=first_dir + "/model_metrics",
        registry_path=first_dir + "/registry",
    )
    d = r2["drift"].first()
    assert d.drift_detected and d.severity == "CRITICAL" and d.action == "warn"
    types = {r.type for r in r2["alerts"].collect()}
    assert "DATA_DRIFT" in types
    assert r2["model_metrics"].count() == 2
    assert r2["registry"].count() == 2


def test_a_repeated_run_in_a_shared_store(spark):
    """One run id, tried twice: one metric row, one registry entry, one copy of its alerts."""
    subs = fixtures.subscribers(spark, "/root/testdata/sf0.001")
    store = scratch_path(spark, "store")
    tries = [training_run(spark, subs, scratch_path(spark, "try"), run_id="nightly", store_path=store) for _ in range(2)]
    last = tries[-1]
    assert last["model_metrics"].count() == last["registry"].count() == 1
    history = last["alert_history"]
    assert history.count() == last["alerts"].count() and history.filter("run_id <> 'nightly' or times <> 1").isEmpty()
