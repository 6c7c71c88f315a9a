"""Classifier evaluation as aggregations (T5), optionally per group (a fleet of models).

Confusion counts come from one partial aggregate; ROC AUC uses the rank-sum
(Mann-Whitney) form over distinct scores with distributed running counts, so ties get
mid-ranks and no group is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_totals


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (the zero-division convention of common ML libraries)."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion_metrics(
    df: DataFrame, label: str = "churn", prediction: str = "prediction", groups: list[str] | None = None
) -> DataFrame:
    """accuracy, precision, recall, f1_score (positive class = true) and counts.

    Rows with a null label are left out."""
    groups = list(groups or [])
    y, p = F.col(label), F.coalesce(F.col(prediction).cast("boolean"), F.lit(False))
    agg = df.filter(y.isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(
        *groups,
        F.col("n").cast("bigint").alias("n"),
        F.col("tp").cast("bigint").alias("tp"),
        F.col("fp").cast("bigint").alias("fp"),
        F.col("fn").cast("bigint").alias("fn"),
        F.col("tn").cast("bigint").alias("tn"),
        _ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(F.lit(2.0) * precision * recall, precision + recall).alias("f1_score"),
    )


def roc_auc(df: DataFrame, label: str = "churn", score: str = "probability_churn", groups: list[str] | None = None) -> DataFrame:
    """ROC AUC per group: P(score_pos > score_neg) + 0.5 P(tie); null when a class is absent."""
    groups = list(groups or [])
    y = F.col(label)
    per_score = (
        df.filter(y.isNotNull() & F.col(score).isNotNull())
        .groupBy(*groups, F.col(score).alias("_s"))
        .agg(F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"))
    )
    cum = running_totals(per_score, "_s", ["_neg"], groups)
    below = F.col("cum__neg") - F.col("_neg")
    out = cum.groupBy(*groups).agg(
        F.sum(F.col("_pos") * (below + F.col("_neg") * F.lit(0.5))).alias("_u"),
        F.sum("_pos").alias("_p"),
        F.first("total__neg").alias("_n"),
    )
    return out.select(
        *groups,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
    )


def evaluate(df: DataFrame, label: str = "churn", prediction: str = "prediction",
             score: str = "probability_churn", groups: list[str] | None = None) -> DataFrame:
    """T5: accuracy, precision, recall, F1 and ROC AUC (per group when ``groups``)."""
    groups = list(groups or [])
    m = confusion_metrics(df, label, prediction, groups)
    a = roc_auc(df, label, score, groups)
    if not groups:
        return m.withColumn("roc_auc", a.select("roc_auc").scalar())
    return m.join(a, on=groups, how="left")
