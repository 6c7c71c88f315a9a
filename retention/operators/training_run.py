"""One scheduled training run, composed from the operators (the reference's nightly
workflow): quality gate -> preprocess -> train/evaluate -> validate -> promote ->
drift against the stored reference -> metric log -> degradation -> alerts -> report.

Every step is a DataFrame job whose result is written as a parquet table under
``out_dir`` (a shared folder) and read back, so later steps never depend on driver
memory.  Tables are written once (``errorifexists``): a retry uses a fresh ``out_dir``
and passes the stored reference, metric log and registry paths of earlier runs.
Scheduling, retries and e-mail delivery stay with the caller.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import rules
from ..schema import METRICS_SCHEMA
from ..sources import run_log, writers
from . import analytics, cleaning, model, monitoring


def _path(out_dir: str, name: str) -> str:
    return out_dir.rstrip("/") + "/" + name


def training_run(
    spark: SparkSession,
    subscribers: DataFrame,
    out_dir: str,
    model_id: str = "churn",
    reference_path: str | None = None,
    metrics_log_path: str | None = None,
    registry_path: str | None = None,
    t: Thresholds = DEFAULT,
    run_id: str | None = None,
    store_path: str | None = None,
) -> dict[str, DataFrame]:
    """Run every step; return the written tables by name.

    ``subscribers`` is a typed (or text) subscriber table with labels.  Paths that are
    None are created under ``out_dir`` (first run: the current data becomes the drift
    reference and the metric log starts empty).

    With ``store_path`` the metric log, the registry and the alert history are kept there by run
    instead: each run appends its own partition, a repeated ``run_id`` replaces its own, and the alerts
    come back with their history."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    run_id = run_id or now.strftime("run-%Y%m%d%H%M%S")
    data = cleaning.coerce_types(cleaning.normalize_columns(subscribers))
    out: dict[str, DataFrame] = {}

    # quality gate (A5): stops the run on missing columns or too few rows
    profile = analytics.data_quality_profile(data)
    analytics.require_quality(profile)

    # preprocessing (P2, D4, D5) stored as its own table
    pre = cleaning.impute(data).withColumn("avg_monthly_charge", rules.avg_monthly_charge()).withColumn(
        "services_count", rules.services_count_raw()
    )
    pre.write.mode("errorifexists").parquet(_path(out_dir, "preprocessed"))
    pre = spark.read.parquet(_path(out_dir, "preprocessed"))

    # training and evaluation (T1-T5), model artefact
    fitted, metrics = model.train_and_evaluate(pre, t)
    model_path = model.save_model(fitted, _path(out_dir, "model"))
    metrics.write.mode("errorifexists").parquet(_path(out_dir, "metrics"))
    metrics = spark.read.parquet(_path(out_dir, "metrics"))
    out["metrics"] = metrics

    # validation (T9) and promotion
    validation = model.validate_metrics(metrics, t).withColumn("model_id", F.lit(model_id))
    summary = model.validation_summary(validation, groups=["model_id"])
    passed = bool(summary.first()["passed"])
    entry = metrics.select(
        F.lit(model_path).alias("model_path"), F.lit(t.model_version).alias("model_version"),
        F.lit(now).cast("timestamp").alias("ts"), F.lit(passed).alias("passed"),
        "accuracy", "precision", "recall", "f1_score",
    )
    if store_path:
        model.register_run(entry.withColumn("model_id", F.lit(model_id)), _path(store_path, "registry"), run_id)
        out["registry"] = model.read_registry(spark, _path(store_path, "registry"))
    else:
        out["registry"] = model.promote(spark, registry_path, entry, _path(out_dir, "registry"))

    # drift against the stored reference
    ref, created = writers.create_or_load_reference(spark, data, reference_path or _path(out_dir, "reference"))
    if created:
        drift = spark.createDataFrame([(False, "NONE", "none")], "drift_detected boolean, severity string, action string")
    else:
        drift = monitoring.drift_summary(
            monitoring.numeric_drift(data, ref, t=t), monitoring.label_drift(data, ref, t=t),
            monitoring.categorical_drift(data, ref, t=t), t,
        )
    drift.write.mode("errorifexists").parquet(_path(out_dir, "drift"))
    drift = monitoring.enforce_drift_action(spark.read.parquet(_path(out_dir, "drift")), t)
    out["drift"] = drift

    # metric log (S6) and degradation / trend (M6, M7)
    new_row = metrics.select(
        F.lit(model_id).alias("model_id"), F.lit(now).cast("timestamp").alias("ts"),
        "accuracy", "precision", "recall", "f1_score",
        F.lit(t.model_version).alias("model_version"), F.lit(run_id).alias("run_id"),
    )
    if store_path:
        run_log.append_run(new_row, _path(store_path, "model_metrics"), run_id)
        run_log.retain_runs(spark, _path(store_path, "model_metrics"), METRICS_SCHEMA, t.keep_metrics)
        log = run_log.newest_metrics(spark, _path(store_path, "model_metrics"), METRICS_SCHEMA, t.keep_metrics)
    else:
        log = writers.append_metrics(spark, metrics_log_path, new_row, _path(out_dir, "model_metrics"), t.keep_metrics)
    out["model_metrics"] = log
    degradation = monitoring.performance_degradation(log, t)

    # alerts (M8) and the run report (A10)
    latest = metrics.select(F.lit(model_id).alias("model_id"), "accuracy", "precision", "recall", "f1_score")
    alerts = monitoring.alerts(drift, degradation, latest, summary, t).withColumn("run_id", F.lit(run_id))
    alerts.write.mode("errorifexists").parquet(_path(out_dir, "alerts"))
    out["alerts"] = spark.read.parquet(_path(out_dir, "alerts"))
    if store_path:
        run_log.append_alerts(out["alerts"], _path(store_path, "alerts"), run_id, now)
        out["alert_history"] = run_log.alert_history(spark, _path(store_path, "alerts"))
    report = analytics.run_report(data, cleaning.find_all(cleaning.impute(data)), metrics, validation, t.model_version)
    report.write.mode("errorifexists").parquet(_path(out_dir, "report"))
    out["report"] = spark.read.parquet(_path(out_dir, "report"))
    return out

