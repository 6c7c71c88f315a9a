"""Registered queries: sources/sinks, model training and scoring, streaming
(S1-S8, T1-T10, C1-C3, A10).  ML results are not SQL-expressible (rows-only check)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import fixtures
from ..config import DEFAULT
from ..operators import analytics, cleaning, model, scoring
from ..schema import REQUIRED_COLUMNS
from ..session import scratch_path
from ..sources import readers, writers
from ..streaming.score_stream import score_directory_once
from .catalog import register
from ..fixtures import clean_subscribers
from .sql_fragments import SCORED_CTES, errors_sql, with_subs

COLS = ", ".join(REQUIRED_COLUMNS)
_MODELS: dict[tuple[str, str], tuple[object, object]] = {}
_SAVED: dict[tuple[str, str], object] = {}


def _key(spark, sf_dir):
    return (spark.sparkContext.applicationId, os.path.abspath(sf_dir))


def trained(spark, sf_dir):
    """Train once per application and data directory: (PipelineModel, metrics DataFrame)."""
    key = _key(spark, sf_dir)
    if key not in _MODELS:
        m, metrics = model.train_and_evaluate(clean_subscribers(spark, sf_dir))
        _MODELS[key] = (m, metrics.persist())
    return _MODELS[key]


def deployed(spark, sf_dir):
    """The trained model saved once to the shared folder and loaded back."""
    key = _key(spark, sf_dir)
    if key not in _SAVED:
        m, _ = trained(spark, sf_dir)
        _SAVED[key] = model.load_model(model.save_model(m, scratch_path(spark, "model")))
    return _SAVED[key]


def _title(name: str) -> str:
    return " ".join(w.capitalize() for w in name.split("_"))


@register("subscribers_csv_roundtrip", oracle=with_subs(f"SELECT {COLS} FROM subs"))
def q_csv_roundtrip(spark, sf_dir):
    """S1 + S2 + S4: write the table as CSV with display-style headers, read it back as
    text, normalise the names and type the cells."""
    subs = fixtures.subscribers(spark, sf_dir)
    path = scratch_path(spark, "subscribers_csv")
    writers.write_subscribers(subs.toDF(*[_title(c) for c in subs.columns]), path, fmt="csv")
    return readers.read_subscribers(spark, path, "csv", missing_ok=False).select(*REQUIRED_COLUMNS)


@register("subscribers_parquet_snapshot", oracle=with_subs(f"SELECT {COLS} FROM subs"))
def q_snapshot(spark, sf_dir):
    """S4 + S1: write a parquet snapshot and read it back."""
    path = scratch_path(spark, "subscribers_snapshot")
    writers.write_subscribers(fixtures.subscribers(spark, sf_dir), path)
    return readers.read_subscribers(spark, path, "parquet", missing_ok=False).select(*REQUIRED_COLUMNS)


_DEFAULTED = ["gender", "contract_type", "payment_method", "paperless_billing"]


@register(
    "upload_defaults",
    oracle=with_subs(
        "SELECT 'Female' AS gender, 'Month-to-month' AS contract_type, 'Electronic check' AS payment_method, "
        "false AS paperless_billing, monthly_charges, tenure_months, starts_with(auto_id, 'AUTO_') AS auto_id "
        "FROM (SELECT *, 'AUTO_' AS auto_id FROM subs) x"
    ),
)
def q_upload_defaults(spark, sf_dir):
    """S3: an upload lacking some columns gets the per-column defaults and AUTO_ ids."""
    subs = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir)).drop(*_DEFAULTED, "customer_id")
    out = readers.read_with_defaults(subs)
    return out.select(*_DEFAULTED, "monthly_charges", "tenure_months",
                      F.col("customer_id").startswith("AUTO_").alias("auto_id"))


@register(
    "missing_source_is_empty",
    oracle=with_subs("SELECT CAST(0 AS BIGINT) AS missing_rows, CAST(COUNT(*) AS BIGINT) AS present_rows FROM subs"),
)
def q_missing_source(spark, sf_dir):
    """A missing subscriber file reads as an empty table (repository behaviour),
    next to the same read of a present file written from the subscriber table."""
    present = scratch_path(spark, "subscribers_present")
    writers.write_subscribers(fixtures.subscribers(spark, sf_dir), present, fmt="csv")
    missing = readers.read_subscribers(spark, os.path.join(present, "no_such_subscribers.csv"), "csv")
    found = readers.read_subscribers(spark, present, "csv", missing_ok=False)
    return missing.agg(F.count(F.lit(1)).alias("missing_rows")).select(
        "missing_rows", found.select(F.count(F.lit(1))).scalar().alias("present_rows")
    )


@register(
    "reference_snapshot",
    oracle=with_subs(f"SELECT {COLS} FROM subs"),
)
def q_reference(spark, sf_dir):
    """The first run stores the current table as the drift reference."""
    cur = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir))
    ref, created = writers.create_or_load_reference(spark, cur, scratch_path(spark, "reference"))
    assert created
    return ref.select(*REQUIRED_COLUMNS)


@register("reference_reload", oracle=with_subs(f"SELECT {COLS} FROM subs"))
def q_reference_reload(spark, sf_dir):
    """A later run with other data gets the reference that the first run stored."""
    cur = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir))
    path = scratch_path(spark, "reference_kept")
    writers.create_or_load_reference(spark, cur, path)
    ref, created = writers.create_or_load_reference(spark, cleaning.find_churned(cur), path)
    assert not created
    return ref.select(*REQUIRED_COLUMNS)


@register(
    "results_csv_export",
    oracle=with_subs(
        "SELECT customer_id, prediction, probability_churn, risk_score FROM rs",
        SCORED_CTES,
    ),
)
def q_results_export(spark, sf_dir):
    """Export scored rows as CSV (with a recommendations text column) and read back."""
    from ..functions import rules

    s = fixtures.rule_scored(spark, sf_dir).withColumn("risk_level", rules.risk_level("probability_churn"))
    s = s.withColumn("customer_segment", rules.prediction_segment()).withColumn("recommendations", rules.recommendations())
    path = scratch_path(spark, "results_csv")
    writers.write_results_csv(s.select("customer_id", "prediction", "probability_churn", "risk_score", "recommendations"), path)
    back = spark.read.option("header", True).schema(
        "customer_id string, prediction boolean, probability_churn double, risk_score double, recommendations string"
    ).csv(path)
    return back.select("customer_id", "prediction", "probability_churn", "risk_score")


@register("train_evaluate")
def q_train_evaluate(spark, sf_dir):
    """Hash split, balanced random forest (100 trees, depth 10, seed 42), test metrics."""
    return trained(spark, sf_dir)[1]


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Importance per feature slot of the trained forest."""
    return model.feature_importance(spark, trained(spark, sf_dir)[0])


@register("model_info")
def q_model_info(spark, sf_dir):
    """Registry row for the trained model."""
    m, metrics = trained(spark, sf_dir)
    return model.model_info(spark, m, metrics).drop("trained_at")


@register("score_batch")
def q_score_batch(spark, sf_dir):
    """C1 + C2 with T8: score every subscriber with the saved-and-reloaded model."""
    scored, _ = scoring.score_batch(clean_subscribers(spark, sf_dir), deployed(spark, sf_dir))
    return scored.drop("prediction_timestamp")


@register(
    "score_errors",
    oracle=with_subs(
        f"SELECT customer_id, error FROM (SELECT customer_id, {errors_sql()} AS error FROM subs) e WHERE error <> ''"
    ),
)
def q_score_errors(spark, sf_dir):
    """Rows quarantined by validation in a scoring batch."""
    m, _ = trained(spark, sf_dir)
    _, errors = scoring.score_batch(cleaning.coerce_types(fixtures.subscribers(spark, sf_dir)), m)
    return errors


@register("score_csv")
def q_score_csv(spark, sf_dir):
    """Score an uploaded CSV lacking some columns (defaults fill them)."""
    m, _ = trained(spark, sf_dir)
    path = scratch_path(spark, "upload_csv")
    clean_subscribers(spark, sf_dir).drop("paperless_billing").write.option("header", True).csv(path)
    scored, _ = scoring.score_csv(spark, path, m)
    return scored.drop("prediction_timestamp")


@register("score_stream")
def q_score_stream(spark, sf_dir):
    """Files dropped into a directory are scored by a stream (availableNow trigger)."""
    m, _ = trained(spark, sf_dir)
    inbox = scratch_path(spark, "inbox")
    clean_subscribers(spark, sf_dir).repartition(4).write.option("header", True).csv(inbox)
    scored, _ = score_directory_once(spark, inbox, m, scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt"))
    return scored.drop("prediction_timestamp")


@register("model_registry")
def q_model_registry(spark, sf_dir):
    """T9 + T10: validate the trained model, register it, report the current version."""
    m, metrics = trained(spark, sf_dir)
    passed = model.validation_summary(model.validate_metrics(metrics)).select("passed")
    entry = metrics.select(
        F.lit(scratch_path(spark, "model_artifact")).alias("model_path"),
        F.lit(DEFAULT.model_version).alias("model_version"),
        F.current_timestamp().alias("ts"),
        passed.select(F.col("passed")).scalar().alias("passed"),
        "accuracy", "precision", "recall", "f1_score",
    )
    reg = model.promote(spark, None, entry, scratch_path(spark, "registry"))
    return model.current_model(reg).select("model_version", F.col("model_path").isNotNull().alias("has_current"))


@register("run_report")
def q_run_report(spark, sf_dir):
    """A10: one report row - data profile, processed rows, test metrics, validation, version."""
    m, metrics = trained(spark, sf_dir)
    data = cleaning.coerce_types(fixtures.subscribers(spark, sf_dir))
    processed = cleaning.find_all(cleaning.impute(data))
    validation = model.validate_metrics(metrics)
    return analytics.run_report(data, processed, metrics, validation)


@register("score_single")
def q_score_single(spark, sf_dir):
    """C2 on a one-row frame: look up one subscriber by id (P4) and score it."""
    from .q_cleaning import LOOKUP_ID

    one = cleaning.find_by_id(clean_subscribers(spark, sf_dir), LOOKUP_ID)
    scored, _ = scoring.score_batch(one, deployed(spark, sf_dir))
    return scored.drop("prediction_timestamp")
