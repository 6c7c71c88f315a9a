"""Data drift, model degradation and alerts (M1-M8).

Drift compares a current and a reference table column by column: one aggregate per side
for moments, a distributed two-sample Kolmogorov-Smirnov statistic, and per-category
shares.  Degradation and trend run over a metric log keyed by ``model_id`` - a fleet of
models, one grouped job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from .ordered import running_totals

NUMERIC_DRIFT_COLUMNS = ["monthly_charges", "total_charges", "tenure_months"]
CATEGORICAL_DRIFT_COLUMNS = ["gender", "partner", "dependents", "contract_type", "payment_method"]
PERF_METRICS = ["accuracy", "precision", "recall", "f1_score"]


def _long(df: DataFrame, columns: list[str], cast: str) -> DataFrame:
    """(column, value) pairs for the given columns: a wide-to-long unpivot."""
    return df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns]))
    )


def kolmogorov_pvalue(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value: Q(sqrt(nm/(n+m)) D), Q(x) = 2 sum (-1)^(k-1) exp(-2 k^2 x^2)."""
    lam = F.sqrt(n * m / (n + m)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(cur: DataFrame, ref: DataFrame, columns: list[str]) -> DataFrame:
    """M2: KS statistic D = max |F_cur - F_ref| and its p-value per column.

    Values are counted per distinct value (partial aggregation absorbs hot values), then
    empirical CDFs come from distributed running totals in value order.  A column empty
    on either side gives D = 0, p = 1.
    The p-value is the asymptotic Kolmogorov series at every sample size."""
    c = _long(cur, columns, "double").select("column", "value", F.lit(1).alias("_c"), F.lit(0).alias("_r"))
    r = _long(ref, columns, "double").select("column", "value", F.lit(0).alias("_c"), F.lit(1).alias("_r"))
    counts = (
        c.unionByName(r)
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.sum("_c").cast("bigint").alias("n_cur"), F.sum("_r").cast("bigint").alias("n_ref"))
    )
    return ks_of_counts(counts, columns)


def ks_of_counts(counts: DataFrame, columns: list[str]) -> DataFrame:
    """M2 from (column, value, n_cur, n_ref): how often each value occurs on either side."""
    cum = running_totals(counts, "value", ["n_cur", "n_ref"], groups=["column"])
    share = lambda side: F.try_divide(F.col(f"cum_{side}"), F.col(f"total_{side}"))  # noqa: E731 - null for an empty side
    gap = F.abs(share("n_cur") - share("n_ref"))
    per_col = cum.groupBy("column").agg(
        F.max(gap).alias("_d"), F.first("total_n_cur").alias("_n"), F.first("total_n_ref").alias("_m")
    )
    spark = counts.sparkSession
    names = F.broadcast(spark.createDataFrame([(x,) for x in columns], "column string"))
    j = names.join(per_col, "column", "left")
    valid = (F.col("_n") > 0) & (F.col("_m") > 0)
    out = j.select(
        "column",
        F.when(valid, F.col("_d")).otherwise(F.lit(0.0)).alias("ks_statistic"),
        F.when(valid, kolmogorov_pvalue(F.col("_d"), F.col("_n").cast("double"), F.col("_m").cast("double")))
        .otherwise(F.lit(1.0))
        .alias("ks_pvalue"),
    )
    return out


def _sides(cur: DataFrame, ref: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables stacked with a side flag (0 = current, 1 = reference): one scan of
    each serves every per-side aggregate below."""
    return cur.select(*columns, F.lit(0).alias("_side")).unionByName(ref.select(*columns, F.lit(1).alias("_side")))


def _moments(cur: DataFrame, ref: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample std per column and side, in one conditional aggregate."""
    both = _sides(cur, ref, columns)
    aggs = []
    for i, c in enumerate(columns):
        for side, prefix in ((0, "c"), (1, "r")):
            v = F.when(F.col("_side") == side, F.col(c).cast("double"))
            aggs += [F.avg(v).alias(f"{prefix}m{i}"), F.stddev_samp(v).alias(f"{prefix}s{i}")]
    wide = both.agg(*aggs)
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"cm{i}").alias("current_mean"),
                        F.col(f"rm{i}").alias("reference_mean"),
                        F.col(f"cs{i}").alias("current_std"),
                        F.col(f"rs{i}").alias("reference_std"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def numeric_drift(
    cur: DataFrame, ref: DataFrame, columns: list[str] | None = None, t: Thresholds = DEFAULT,
) -> DataFrame:
    """M1: mean shift in reference standard deviations, KS test, and severity per column."""
    cols = [c for c in (columns or NUMERIC_DRIFT_COLUMNS) if c in cur.columns and c in ref.columns]
    ks = ks_two_sample(cur, ref, cols)
    return numeric_report(_moments(cur, ref, cols).join(ks, "column"), t)


def numeric_report(j: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """M1 from each column's moments on both sides and its KS test."""
    diff = F.abs(F.col("current_mean") - F.col("reference_mean"))
    std_diff = F.when(F.col("reference_std") > 0, diff / F.col("reference_std")).otherwise(F.lit(0.0))
    j = j.withColumn("mean_difference", diff).withColumn("std_differences", std_diff)
    sd, p = F.col("std_differences"), F.col("ks_pvalue")
    severity = (
        F.when(sd >= t.drift_critical, "CRITICAL")
        .when(sd >= t.drift_high, "HIGH")
        .when(sd >= t.drift_medium, "MEDIUM")
        .when(p < t.ks_pvalue, "MEDIUM")
        .otherwise("NONE")
    )
    return j.select(
        "column", "current_mean", "reference_mean", "current_std", "reference_std", "mean_difference",
        "std_differences", "ks_statistic", "ks_pvalue",
        ((sd >= t.drift_medium) | (p < t.ks_pvalue)).alias("drift_detected"),
        severity.alias("severity"),
    )


def categorical_drift(
    cur: DataFrame, ref: DataFrame, columns: list[str] | None = None, t: Thresholds = DEFAULT, report_all: bool = False
) -> DataFrame:
    """M3: total variation distance of category shares (nulls left out) per column.

    Only columns above the report threshold are returned unless ``report_all``."""
    cols = [c for c in (columns or CATEGORICAL_DRIFT_COLUMNS) if c in cur.columns and c in ref.columns]
    c = _long(cur, cols, "string").select("column", "value", F.lit(1).alias("_c"), F.lit(0).alias("_r"))
    r = _long(ref, cols, "string").select("column", "value", F.lit(0).alias("_c"), F.lit(1).alias("_r"))
    counts = (
        c.unionByName(r)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.sum("_c").alias("n_cur"), F.sum("_r").alias("n_ref"))
    )
    return category_report(counts, t, report_all)


def category_report(counts: DataFrame, t: Thresholds = DEFAULT, report_all: bool = False) -> DataFrame:
    """M3 from (column, value, n_cur, n_ref)."""
    # category counts per column are few; the per-column totals are a small aggregate
    totals = counts.groupBy("column").agg(F.sum("n_cur").alias("t_cur"), F.sum("n_ref").alias("t_ref"))
    share_gap = F.abs(
        F.coalesce(F.col("n_cur") / F.nullif(F.col("t_cur"), F.lit(0)), F.lit(0.0))
        - F.coalesce(F.col("n_ref") / F.nullif(F.col("t_ref"), F.lit(0)), F.lit(0.0))
    )
    tvd = counts.join(totals, "column").groupBy("column").agg((F.sum(share_gap) / F.lit(2.0)).alias("total_variation_distance"))
    tv = F.col("total_variation_distance")
    out = tvd.select(
        "column",
        "total_variation_distance",
        (tv > t.categorical_report).alias("drift_detected"),
        F.when(tv > t.categorical_medium, "MEDIUM").when(tv > t.categorical_report, "LOW").otherwise("NONE").alias("severity"),
    )
    return out if report_all else out.filter(F.col("drift_detected"))


def label_drift(cur: DataFrame, ref: DataFrame, label: str = "churn", t: Thresholds = DEFAULT) -> DataFrame:
    """M4: churn share difference (shares among labelled rows).

    No row when either side has no positive label (the comparison is then skipped)."""
    both = _sides(cur, ref, [label])
    y = F.col(label)
    pos = {side: F.count_if((F.col("_side") == side) & y) for side in (0, 1)}
    labelled = {side: F.count(F.when(F.col("_side") == side, y)) for side in (0, 1)}
    j = both.agg(
        (pos[0] / F.nullif(labelled[0], F.lit(0))).alias("current_churn_rate"),
        (pos[1] / F.nullif(labelled[1], F.lit(0))).alias("reference_churn_rate"),
        pos[0].alias("_cp"),
        pos[1].alias("_rp"),
    )
    return label_report(j, t)


def label_report(shares: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """M4 from one row: the share and the number of positive labels (``_cp``, ``_rp``) on both sides."""
    j = shares.filter((F.col("_cp") > 0) & (F.col("_rp") > 0))
    diff = F.abs(F.col("current_churn_rate") - F.col("reference_churn_rate"))
    return j.select(
        "current_churn_rate",
        "reference_churn_rate",
        diff.alias("difference"),
        (diff > t.churn_dist_drift).alias("drift_detected"),
        F.when(diff > t.churn_dist_high, "HIGH").when(diff > t.churn_dist_drift, "MEDIUM").otherwise("NONE").alias("severity"),
    )


def _rank(sev: Column) -> Column:
    return F.when(sev == "CRITICAL", 3).when(sev == "HIGH", 2).when(sev == "MEDIUM", 1).otherwise(0)


def _unrank(r: Column) -> Column:
    return F.when(r == 3, "CRITICAL").when(r == 2, "HIGH").when(r == 1, "MEDIUM").otherwise("NONE")


def drift_summary(numeric: DataFrame, label: DataFrame, categorical: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """M5: overall severity (worst of numeric and label drift; categorical drift sets the
    flag only) and the action to take."""
    parts = [
        numeric.select(_rank(F.col("severity")).alias("r"), F.col("drift_detected").alias("d")),
        label.select(_rank(F.col("severity")).alias("r"), F.col("drift_detected").alias("d")),
        categorical.filter(F.col("drift_detected")).select(F.lit(0).alias("r"), F.lit(True).alias("d")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    s = u.agg(F.coalesce(F.max("r"), F.lit(0)).alias("r"), F.coalesce(F.bool_or("d"), F.lit(False)).alias("drift_detected"))
    sev = _unrank(F.col("r"))
    if t.drift_action == "stop":
        action = F.when(F.col("drift_detected") & (F.col("r") >= 2), "stop").when(F.col("drift_detected"), "warn")
    elif t.drift_action == "warn":
        action = F.when(F.col("drift_detected"), "warn")
    else:
        action = F.when(F.col("drift_detected"), "ignore")
    return s.select("drift_detected", sev.alias("severity"), F.coalesce(action, F.lit("none")).alias("action"))


class DriftStop(RuntimeError):
    pass


def enforce_drift_action(summary: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """M5 action: raise when the action is ``stop`` (HIGH/CRITICAL drift with
    ``drift_action='stop'``); otherwise pass the one-row summary through."""
    row = summary.first()
    if row is not None and row["action"] == "stop":
        raise DriftStop(f"Significant data drift detected (Severity: {row['severity']}) - stopping")
    return summary


def _truthy_avg(c: Column, cond: Column) -> Column:
    """Mean over rows where cond holds, skipping null and 0 (as a truthiness filter does)."""
    return F.avg(F.when(cond & c.isNotNull() & (c != 0), c))


def performance_degradation(log: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """M6 + M7 per model: recent window vs the baseline before it, worst relative drop,
    severity, and the accuracy trend of the recent window.

    Only the newest window and the baseline before it matter; ``row_number() <= keep`` lets
    Spark keep a per-partition top before the shuffle, so a model with a huge log is
    not gathered into one task."""
    keep = t.recent_window * (1 + t.baseline_windows)
    newest = Window.partitionBy("model_id").orderBy(F.desc("ts"), F.desc("run_id"))
    counts = log.groupBy("model_id").agg(F.count(F.lit(1)).alias("data_points"))
    top = log.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= keep)
    return degradation_of_newest(top.join(counts, "model_id"), t)


def degradation_of_newest(j: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """M6 + M7 from the newest runs of every model, numbered ``rn`` from the newest, with ``data_points``,
    how many runs the model has in all."""
    w = F.least(F.lit(t.recent_window), F.floor(F.col("data_points") / 2)).cast("int")
    bsize = F.least(F.col("data_points") - w, w * t.baseline_windows)
    j = j.withColumn("window_size", w).withColumn("_bsize", bsize)
    is_recent = F.col("rn") <= F.col("window_size")
    is_base = (F.col("rn") > F.col("window_size")) & (F.col("rn") <= F.col("window_size") + F.col("_bsize"))
    aggs = []
    for m in PERF_METRICS:
        aggs.append(_truthy_avg(F.col(m), is_base).alias(f"baseline_{m}"))
        aggs.append(_truthy_avg(F.col(m), is_recent).alias(f"recent_{m}"))
    # trend: slope of truthy recent accuracies against their chronological position
    acc_ok = is_recent & F.col("accuracy").isNotNull() & (F.col("accuracy") != 0)
    aggs.append(F.count_if(acc_ok).alias("_k"))
    g = (
        j.filter(F.col("data_points") >= t.min_data_points)
        .withColumn("_acc_ok", acc_ok)
        .withColumn(
            "_x",
            F.when(
                F.col("_acc_ok"),
                F.count_if(F.col("_acc_ok")).over(
                    Window.partitionBy("model_id").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, 0)
                ) - 1,
            ),
        )
    )
    aggs.append(F.regr_slope(F.when(F.col("_acc_ok"), F.col("accuracy")), F.col("_x").cast("double")).alias("_slope"))
    per = g.groupBy("model_id", "data_points", "window_size").agg(*aggs)
    degr = {}
    for m in PERF_METRICS:
        b, r = F.col(f"baseline_{m}"), F.col(f"recent_{m}")
        degr[m] = F.when(b > 0, (b - r) / b).otherwise(F.lit(0.0))
    out = per
    for m in PERF_METRICS:
        out = out.withColumn(f"{m}_degradation", degr[m])
    mx = F.greatest(*[F.col(f"{m}_degradation") for m in PERF_METRICS])
    out = out.withColumn("max_degradation", mx)
    sev = (
        F.when(mx >= t.degradation_high, "CRITICAL")
        .when(mx >= t.degradation_medium, "HIGH")
        .when(mx >= t.degradation_low, "MEDIUM")
        .otherwise("NONE")
    )
    slope = F.col("_slope")
    trend = (
        F.when(F.col("window_size") < 3, "insufficient_data")
        .when(F.col("_k") < 3, "unknown")
        .when(slope < -t.trend_slope, "decreasing")
        .when(slope > t.trend_slope, "increasing")
        .otherwise("stable")
    )
    return out.select(
        "model_id", "data_points", "window_size",
        *[c for m in PERF_METRICS for c in (f"baseline_{m}", f"recent_{m}", f"{m}_degradation")],
        "max_degradation",
        sev.alias("severity"),
        (sev != "NONE").alias("degradation_detected"),
        trend.alias("trend"),
    )


def _alert_severity(sev: Column) -> Column:
    return F.when(sev == "CRITICAL", "CRITICAL").when(sev == "HIGH", "HIGH").otherwise("WARNING")


def alerts(
    drift: DataFrame | None,
    degradation: DataFrame | None,
    metrics: DataFrame | None,
    validation: DataFrame | None,
    t: Thresholds = DEFAULT,
) -> DataFrame:
    """M8: one alert table from drift summary, degradation per model, latest training
    metrics per model and validation per model.

    Columns: model_id, type, severity, metric, value, threshold, message, details."""
    parts: list[DataFrame] = []
    empty_map = F.create_map().cast("map<string,string>")

    def row(model_id, typ, severity, metric, value, threshold, message, details):
        return [
            model_id.cast("string").alias("model_id"),
            F.lit(typ).alias("type"),
            severity.alias("severity"),
            (metric if isinstance(metric, Column) else F.lit(metric)).cast("string").alias("metric"),
            value.cast("double").alias("value"),
            threshold.cast("double").alias("threshold"),
            message.alias("message"),
            details.alias("details"),
        ]

    if drift is not None:
        d = drift.filter(F.col("drift_detected"))
        parts.append(
            d.select(
                *row(
                    F.lit(None), "DATA_DRIFT", _alert_severity(F.col("severity")), None, F.lit(None), F.lit(None),
                    F.concat(F.lit("Data drift detected in training data (Severity: "), F.col("severity"), F.lit(")")),
                    F.create_map(F.lit("drift_severity"), F.col("severity"), F.lit("action"), F.col("action")),
                )
            )
        )
    if degradation is not None:
        d = degradation.filter(F.col("degradation_detected"))
        parts.append(
            d.select(
                *row(
                    F.col("model_id"), "MODEL_DEGRADATION", _alert_severity(F.col("severity")), "max_degradation",
                    F.col("max_degradation"), F.lit(t.degradation_low),
                    F.concat(
                        F.lit("Model performance degradation detected (Severity: "), F.col("severity"),
                        F.lit(", Max degradation: "), F.format_string("%.1f%%", F.col("max_degradation") * 100),
                        F.lit(")"),
                    ),
                    F.create_map(
                        F.lit("degradation_severity"), F.col("severity"), F.lit("trend"), F.col("trend"),
                        F.lit("data_points"), F.col("data_points").cast("string"),
                    ),
                )
            )
        )
    if metrics is not None:
        specs = [
            ("LOW_ACCURACY", "accuracy", "accuracy", t.alert_accuracy),
            ("LOW_PRECISION", "precision", "precision", t.alert_precision),
            ("LOW_RECALL", "recall", "recall", t.alert_recall),
            ("LOW_F1_SCORE", "f1_score", "F1-score", t.alert_f1),
        ]
        for typ, m, label, th in specs:
            d = metrics.filter(F.col(m) < F.lit(th))
            parts.append(
                d.select(
                    *row(
                        F.col("model_id"), typ, F.lit("WARNING"), m, F.col(m), F.lit(th),
                        F.format_string(f"Model {label} (%.3f) below alert threshold ({th})", F.col(m)),
                        F.create_map(F.lit(m), F.col(m).cast("string"), F.lit("threshold"), F.lit(str(th))),
                    )
                )
            )
    if validation is not None:
        d = validation.filter(~F.col("passed"))
        parts.append(
            d.select(
                *row(
                    F.col("model_id"), "VALIDATION_FAILED", F.lit("CRITICAL"), None, F.lit(None), F.lit(None),
                    F.lit("Model validation failed - metrics below minimum thresholds"),
                    F.coalesce(F.col("details"), empty_map) if "details" in validation.columns else empty_map,
                )
            )
        )
    if not parts:
        raise ValueError("alerts needs at least one input")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
