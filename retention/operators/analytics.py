"""Filters over rules and aggregations (A1-A10).

Money aggregates are summed in integer cents and divided once, so a result does not
depend on summation order (the same bits come out on 1 or 1000 executors).  Every
aggregate here is a single ``agg`` with partial (map-side) aggregation; grouping keys
are low-cardinality labels, so skew on a hot key costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import rules
from ..schema import REQUIRED_COLUMNS, SEGMENTS
from .selection import exact_quantiles


def cents(c) -> "F.Column":
    """Money as exact integer cents."""
    return F.round(c * F.lit(100)).cast("bigint")


def at_risk(df: DataFrame, threshold: float | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """A1: not churned (false or null) and rule score at or above the threshold."""
    th = t.high_risk_score if threshold is None else threshold
    score = F.col("risk_score") if "risk_score" in df.columns else rules.risk_score()
    return df.filter(~rules.churned() & (score >= F.lit(float(th))))


def segment_metrics(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """A2: per rule segment - count, average monthly charge and tenure, revenue.

    All six segments are always present (zeros when empty): the aggregate is joined
    onto a six-row literal table, which is broadcast (its size is fixed).
    """
    seg = F.col("segment") if "segment" in df.columns else rules.rule_segment(t=t)
    agg = (
        df.select(seg.alias("segment"), cents(F.col("monthly_charges")).alias("_mc"), F.col("tenure_months"))
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_mc").alias("_mc_sum"),
            F.sum("tenure_months").alias("_t_sum"),
            F.sum(F.col("_mc") * F.col("tenure_months")).alias("_rev_cents"),
        )
    )
    spark = df.sparkSession
    names = F.broadcast(spark.createDataFrame([(s,) for s in SEGMENTS], "segment string"))
    j = names.join(agg, "segment", "left")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    return j.select(
        "segment",
        n.alias("customer_count"),
        F.coalesce(F.col("_mc_sum") / F.col("_n") / F.lit(100.0), F.lit(0.0)).alias("avg_monthly_charges"),
        F.coalesce(F.col("_t_sum") / F.col("_n"), F.lit(0.0)).alias("avg_tenure_months"),
        F.coalesce(F.col("_rev_cents") / F.lit(100.0), F.lit(0.0)).alias("total_revenue"),
    )


def summary_statistics(df: DataFrame) -> DataFrame:
    """A3/A4: totals, churned count and rate (over all rows, null labels too), averages.

    An empty table gives zeros."""
    n = F.count(F.lit(1))
    churned_n = F.count_if(F.col("churn") == F.lit(True))
    return df.agg(
        n.cast("bigint").alias("total_customers"),
        churned_n.cast("bigint").alias("churned_customers"),
        F.coalesce(churned_n / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("churn_rate"),
        F.coalesce(F.sum("tenure_months") / F.count("tenure_months"), F.lit(0.0)).alias("average_tenure"),
        F.coalesce(
            F.sum(cents(F.col("monthly_charges"))) / F.count("monthly_charges") / F.lit(100.0), F.lit(0.0)
        ).alias("average_monthly_charges"),
    )


def count_total(df: DataFrame) -> int:
    """A4."""
    return df.count()


def count_churned(df: DataFrame) -> int:
    """A4."""
    return df.filter(F.col("churn") == F.lit(True)).count()


def null_profile(df: DataFrame, high_null_share: float = 0.10) -> DataFrame:
    """A5 (per column): nulls per column in one pass, unpivoted to one row per column."""
    cols = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(cols)],
    )
    stacked = wide.select(
        "_rows",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"_null_{i}").cast("bigint").alias("null_count"))
                    for i, c in enumerate(cols)
                ]
            )
        ),
    )
    return stacked.select(
        "column_name",
        "null_count",
        F.coalesce(F.col("null_count") / F.nullif(F.col("_rows"), F.lit(0)), F.lit(0.0)).alias("null_share"),
        (F.col("null_count") > F.col("_rows") * F.lit(high_null_share)).alias("high_nulls"),
    )


def data_quality_profile(df: DataFrame, min_rows: int = 100, minority_warn: float = 0.1) -> DataFrame:
    """A5 (one row): size, missing required columns, total nulls, class shares, warnings.

    Class shares leave null labels out (as a value count does)."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    total_nulls = None
    for c in df.columns:
        term = F.count_if(F.col(c).isNull())
        total_nulls = term if total_nulls is None else total_nulls + term
    label = F.col("churn") if "churn" in df.columns else F.lit(None).cast("boolean")
    n_true = F.count_if(label == F.lit(True))
    n_false = F.count_if(label == F.lit(False))
    n_lab = n_true + n_false
    prof = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_samples"),
        (total_nulls if total_nulls is not None else F.lit(0)).cast("bigint").alias("missing_values"),
        (n_true / F.nullif(n_lab, F.lit(0))).alias("churn_rate"),
        (n_false / F.nullif(n_lab, F.lit(0))).alias("active_rate"),
    )
    minority = F.least("churn_rate", "active_rate")
    return prof.select(
        "total_samples",
        F.lit(",".join(missing)).alias("missing_columns"),
        "missing_values",
        F.coalesce(F.col("churn_rate"), F.lit(0.0)).alias("churn_rate"),
        F.coalesce(minority, F.lit(0.0)).alias("minority_share"),
        F.coalesce(minority < F.lit(minority_warn), F.lit(False)).alias("imbalance_warning"),
        (F.col("total_samples") < F.lit(min_rows)).alias("too_small_error"),
        F.lit(len(missing) > 0).alias("missing_columns_error"),
    )


class DataQualityError(ValueError):
    pass


def require_quality(profile: DataFrame) -> DataFrame:
    """A5 gate: raise on missing required columns or fewer than the minimum rows (the
    training run stops); warnings (high nulls, class imbalance) stay in the profile."""
    row = profile.first()
    if row["missing_columns_error"]:
        raise DataQualityError(f"Missing required columns: {row['missing_columns']}")
    if row["too_small_error"]:
        raise DataQualityError(f"Dataset too small for training ({row['total_samples']} samples)")
    return profile


def batch_summary(scored: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counts and rates of one scored batch (quarantined rows counted as errors)."""
    n = F.count(F.lit(1))
    churn_n = F.count_if(F.col("prediction"))
    out = scored.agg(
        n.cast("bigint").alias("processed_count"),
        churn_n.cast("bigint").alias("high_risk_count"),
        (n - churn_n).cast("bigint").alias("low_risk_count"),
        F.coalesce(churn_n * F.lit(100.0) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("predicted_churn_pct"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(F.col("risk_level").isin("High", "Critical")).cast("bigint").alias("high_risk_level_count"),
    )
    if errors is None:
        return out.withColumn("error_count", F.lit(0).cast("bigint"))
    err_n = errors.select(F.count(F.lit(1)).cast("bigint")).scalar()
    return out.withColumn("error_count", err_n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percent per value, most frequent first.

    The total is a scalar subquery over the counts (one number), not a join or a global window."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return counts.withColumn("percent", F.col("count") * F.lit(100.0) / total).orderBy(F.desc("count"), F.asc("value"))


def probability_histogram(df: DataFrame, column: str = "probability_churn", bins: int = 20) -> DataFrame:
    """Equal-width bins on [0, 1]; every bin present (empty ones with 0)."""
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("_c")
    )
    spark = df.sparkSession
    all_bins = F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (F.col("bin") / F.lit(float(bins))).alias("bin_start"),
        ((F.col("bin") + 1) / F.lit(float(bins))).alias("bin_end"),
        F.coalesce(F.col("_c"), F.lit(0)).cast("bigint").alias("count"),
    )


def probability_stats(df: DataFrame, column: str = "probability_churn", exact: bool = True) -> DataFrame:
    """Mean, median (interpolated), sample std, min, max.

    ``exact`` selects the median by histograms narrowed in a few passes (``selection``), run while the
    plan is built; otherwise ``percentile_approx``."""
    if exact:
        med = F.lit(exact_quantiles(df, column, [0.5])[0]).cast("double")
    else:
        med = F.percentile_approx(F.col(column), 0.5, 10000)
    base = df.agg(
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        *([] if exact else [med.alias("median")]),
    )
    if exact:
        base = base.withColumn("median", med)
    return base.select("mean", "median", "std", "min", "max")


def run_report(
    data: DataFrame,
    processed: DataFrame,
    metrics: DataFrame,
    validation: DataFrame,
    version: str = DEFAULT.model_version,
    features_created: tuple[str, ...] = ("avg_monthly_charge", "services_count"),
) -> DataFrame:
    """A10: one report row per run.

    One lazy plan: the data profile is a one-row aggregate, the other inputs enter as scalar subqueries.
    ``metrics`` has one row (accuracy, precision, recall, f1_score); ``validation`` has
    a boolean ``passed`` per checked metric."""
    return data_quality_profile(data).select(
        "total_samples", "churn_rate", "missing_values", F.col("total_samples").alias("original_samples"),
        processed.select(F.count(F.lit(1))).scalar().alias("processed_samples"),
        F.lit(",".join(features_created)).alias("features_created"),
        *[metrics.select(F.col(c).cast("double")).scalar().alias(c) for c in ("accuracy", "precision", "recall", "f1_score")],
        validation.select(F.coalesce(F.bool_and("passed"), F.lit(False))).scalar().alias("validation_passed"),
        F.lit(version).alias("model_version"),
    )
