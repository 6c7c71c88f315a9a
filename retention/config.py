"""Thresholds and defaults of the churn jobs, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # training / validation
    test_size: float = 0.2
    seed: int = 42
    model_version: str = "1.0.0"
    num_trees: int = 100
    max_depth: int = 10
    min_accuracy: float = 0.75
    min_precision: float = 0.70
    min_recall: float = 0.65
    min_f1_score: float | None = None
    # rules
    high_value_monthly: float = 70.0
    high_risk_score: float = 70.0
    new_customer_months: int = 6
    # numeric drift (in reference standard deviations) and KS
    drift_medium: float = 2.0
    drift_high: float = 3.0
    drift_critical: float = 5.0
    ks_pvalue: float = 0.01
    # label drift
    churn_dist_drift: float = 0.05
    churn_dist_high: float = 0.10
    # categorical drift (total variation distance)
    categorical_report: float = 0.10
    categorical_medium: float = 0.20
    drift_action: str = "warn"  # warn | stop | ignore
    # performance degradation
    degradation_low: float = 0.05
    degradation_medium: float = 0.10
    degradation_high: float = 0.20
    min_data_points: int = 5
    recent_window: int = 5  # newest runs compared, at most half of all
    baseline_windows: int = 2  # baseline length, in recent windows
    trend_slope: float = 0.001
    # training-metric alerts (strict <)
    alert_accuracy: float = 0.80
    alert_precision: float = 0.75
    alert_recall: float = 0.70
    alert_f1: float = 0.75
    # metric log retention
    keep_metrics: int = 50


DEFAULT = Thresholds()
# the stricter preset of a production deployment
PRODUCTION = Thresholds(
    min_accuracy=0.80, drift_action="stop",
    alert_accuracy=0.85, alert_precision=0.80, alert_recall=0.75, alert_f1=0.80,
)
