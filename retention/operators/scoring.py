"""Scoring (C1-C3): model output plus the served rule columns, in one narrow stage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import rules
from ..sources.readers import read_subscribers, read_with_defaults
from .cleaning import validate
from .model import churn_probability, feature_names, model_input

SCORED_COLUMNS = [
    "customer_id", "prediction", "probability_churn", "probability_stay", "confidence", "risk_level",
    "risk_score", "customer_segment", "lifetime_value", "model_version", "prediction_timestamp",
]


DEFAULT_CONFIDENCE, UNKNOWN_VERSION = 0.8, "unknown"  # fixed values, where a model gives none


def predict(df: DataFrame, model: PipelineModel, version: str | None = DEFAULT.model_version, scale: str = "confidence") -> DataFrame:
    """Class, churn probability, confidence, risk level, version, features used, time.

    Any pipeline serves that gives class ``probability`` vectors (the forest) or ``probability_churn`` and
    ``prediction`` columns.  Without vectors its ``confidence`` column counts, or the default where there is
    none or null; a version of None is ``unknown``; a pipeline that names no features used its whole input."""
    scored = model.transform(model_input(df, label=None))
    p = F.col("probability_churn")
    names = feature_names(model) if hasattr(model.stages[0], "labelsArray") else df.columns
    if "probability" in scored.columns:
        scored, sure = churn_probability(scored), rules.confidence(p)
    elif "confidence" in scored.columns:
        sure = F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))
    else:
        sure = F.lit(DEFAULT_CONFIDENCE)
    return (
        scored.withColumn("confidence", sure)
        .withColumn("risk_level", rules.risk_level_confidence(p, F.col("confidence")) if scale == "confidence" else rules.risk_level(p, scale))
        .withColumn("probability_stay", rules.probability_stay(p))
        .withColumn("is_high_risk", rules.is_high_risk(p))
        .withColumn("model_version", F.lit(version or UNKNOWN_VERSION))
        .withColumn("features_used", F.array(*[F.lit(n) for n in names]))
        .withColumn("prediction_timestamp", F.current_timestamp())
    )


def _served(pred: DataFrame, include_analysis: bool, t: Thresholds, first: tuple[str, ...] = ()) -> DataFrame:
    if include_analysis:
        # a subscriber being scored has no known outcome: lifetime value as if active
        pred = (
            pred.withColumn("risk_score", rules.risk_score())
            .withColumn("customer_segment", rules.prediction_segment("probability_churn", t))
            .withColumn("lifetime_value", rules.lifetime_value(assume_active=True))
        )
    else:
        pred = (
            pred.withColumn("risk_score", F.lit(None).cast("double"))
            .withColumn("customer_segment", F.lit(None).cast("string"))
            .withColumn("lifetime_value", F.lit(None).cast("double"))
        )
    return pred.select(*first, *SCORED_COLUMNS)


def _errors(bad: DataFrame, *own: str) -> DataFrame:
    return bad.select(*[c for c in ("customer_index", *own, "customer_id") if c in bad.columns], "error")


def score_batch(df: DataFrame, model: PipelineModel, include_analysis: bool = True,
                version: str | None = DEFAULT.model_version, t: Thresholds = DEFAULT):
    """Validate, predict, add rule score / segment / lifetime value.

    Returns (scored, errors).  ``errors`` has customer_id and the rule codes (plus
    ``customer_index`` when the input carries one)."""
    ok, bad = validate(df)
    return _served(predict(ok, model, version), include_analysis, t), _errors(bad)


def score_csv(spark: SparkSession, path: str, model: PipelineModel, include_analysis: bool = True):
    """Read an uploaded CSV, fill absent columns with defaults, score it."""
    df = read_with_defaults(read_subscribers(spark, path, "csv", missing_ok=False))
    return score_batch(df, model, include_analysis)
