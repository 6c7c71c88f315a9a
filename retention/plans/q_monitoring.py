"""Registered queries: drift, metric log, degradation, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..config import DEFAULT, PRODUCTION, Thresholds
from ..operators import cleaning, model, monitoring
from ..session import scratch_path
from ..sources import writers
from .catalog import register
from .sql_fragments import IMPUTED_FEATURES_CTE, with_subs

SHIFT = 60.0
HIGH_SHIFT = 100.0  # over 3 standard deviations
NUM_COLS = monitoring.NUMERIC_DRIFT_COLUMNS
CAT_COLS = monitoring.CATEGORICAL_DRIFT_COLUMNS


def _pair(spark, sf_dir, shift=0.0):
    cur, ref = fixtures.drift_pair(spark, sf_dir, shift)
    return cleaning.coerce_types(cur), cleaning.coerce_types(ref)


def _pair_ctes(shift: float = 0.0) -> str:
    cur_sel = "*" if not shift else f"* REPLACE (monthly_charges + {shift}::DOUBLE AS monthly_charges)"
    return (
        f"cur AS (SELECT {cur_sel} FROM subs WHERE CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) % 2 = 0),\n"
        "ref AS (SELECT * FROM subs WHERE CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) % 2 = 1)"
    )


def _ks_ctes() -> str:
    vals = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v, 1 AS c, 0 AS r FROM cur UNION ALL "
        f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v, 0 AS c, 1 AS r FROM ref"
        for c in NUM_COLS
    )
    return f"""vals AS ({vals}),
cnt AS (SELECT col, v, SUM(c) AS n_cur, SUM(r) AS n_ref FROM vals WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY col, v),
cum AS (SELECT col, SUM(n_cur) OVER (PARTITION BY col ORDER BY v) AS cc, SUM(n_ref) OVER (PARTITION BY col ORDER BY v) AS cr,
               SUM(n_cur) OVER (PARTITION BY col) AS tc, SUM(n_ref) OVER (PARTITION BY col) AS tr FROM cnt),
ks0 AS (SELECT col, MAX(abs(cc / tc - cr / tr)) AS d, MAX(tc) AS n, MAX(tr) AS m FROM cum GROUP BY col),
ks AS (SELECT col, d AS ks_statistic,
  CASE WHEN sqrt(n * m / (n + m)) * d < 0.2 THEN 1.0::DOUBLE
       ELSE LEAST(GREATEST(list_sum(list_transform(range(1, 101), lambda k:
            (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END)
            * exp(-2.0::DOUBLE * k * k * (sqrt(n * m / (n + m)) * d) * (sqrt(n * m / (n + m)) * d)))), 0.0::DOUBLE), 1.0::DOUBLE)
  END AS ks_pvalue FROM ks0)"""


def _moments_cte() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS col, (SELECT AVG(CAST({c} AS DOUBLE)) FROM cur) AS cm, (SELECT AVG(CAST({c} AS DOUBLE)) FROM ref) AS rm, "
        f"(SELECT STDDEV_SAMP(CAST({c} AS DOUBLE)) FROM cur) AS cs, (SELECT STDDEV_SAMP(CAST({c} AS DOUBLE)) FROM ref) AS rsd"
        for c in NUM_COLS
    )
    return f"mom AS ({rows})"


NUMERIC_BODY = """
SELECT col AS "column", round(cm, 6) AS current_mean, round(rm, 6) AS reference_mean,
       round(cs, 6) AS current_std, round(rsd, 6) AS reference_std,
       round(abs(cm - rm), 6) AS mean_difference, round(sd, 6) AS std_differences,
       ks_statistic, round(ks_pvalue, 6) AS ks_pvalue,
       sd >= 2.0 OR ks_pvalue < 0.01 AS drift_detected,
       CASE WHEN sd >= 5.0 THEN 'CRITICAL' WHEN sd >= 3.0 THEN 'HIGH' WHEN sd >= 2.0 THEN 'MEDIUM'
            WHEN ks_pvalue < 0.01 THEN 'MEDIUM' ELSE 'NONE' END AS severity
FROM (SELECT mom.*, ks.ks_statistic, ks.ks_pvalue,
             CASE WHEN rsd > 0 THEN abs(cm - rm) / rsd ELSE 0.0 END AS sd
      FROM mom JOIN ks USING (col)) x
"""


def _numeric_ctes(shift: float) -> str:
    return _pair_ctes(shift) + ",\n" + _ks_ctes() + ",\n" + _moments_cte()


def _numeric_drift_sql(shift: float) -> str:
    return with_subs(NUMERIC_BODY, _numeric_ctes(shift))


ROUND6 = ["current_mean", "reference_mean", "current_std", "reference_std", "mean_difference", "std_differences", "ks_pvalue"]


def _numeric(spark, sf_dir, shift):
    cur, ref = _pair(spark, sf_dir, shift)
    d = monitoring.numeric_drift(cur, ref)
    return d.select(*[F.round(c, 6).alias(c) if c in ROUND6 else F.col(c) for c in d.columns])


@register("numeric_drift", oracle=_numeric_drift_sql(0.0))
def q_numeric_drift(spark, sf_dir):
    """M1 + M2: even vs odd subscribers (no drift expected); stats rounded to 6 places."""
    return _numeric(spark, sf_dir, 0.0)


@register("numeric_drift_shifted", oracle=_numeric_drift_sql(SHIFT))
def q_numeric_drift_shifted(spark, sf_dir):
    """M1 + M2 with current monthly charges shifted by +60 (positive case)."""
    return _numeric(spark, sf_dir, SHIFT)


@register(
    "ks_two_sample",
    oracle=with_subs('SELECT col AS "column", ks_statistic FROM ks', _pair_ctes(SHIFT) + ",\n" + _ks_ctes()),
)
def q_ks(spark, sf_dir):
    """M2: exact KS statistic per numeric column (distributed running totals)."""
    cur, ref = _pair(spark, sf_dir, SHIFT)
    return monitoring.ks_two_sample(cur, ref, NUM_COLS).select("column", "ks_statistic")


CATEGORICAL_BODY = """
SELECT col AS "column", tvd AS total_variation_distance, tvd > 0.10 AS drift_detected,
       CASE WHEN tvd > 0.20 THEN 'MEDIUM' WHEN tvd > 0.10 THEN 'LOW' ELSE 'NONE' END AS severity
FROM (SELECT ccnt.col, SUM(abs(COALESCE(n_cur / NULLIF(t_cur, 0), 0.0) - COALESCE(n_ref / NULLIF(t_ref, 0), 0.0))) / 2.0::DOUBLE AS tvd
      FROM ccnt JOIN ctot USING (col) GROUP BY ccnt.col) x
"""


def _categorical_ctes() -> str:
    vals = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, 1 AS c, 0 AS r FROM cur UNION ALL "
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, 0 AS c, 1 AS r FROM ref"
        for c in CAT_COLS
    )
    return f"""cvals AS ({vals}),
ccnt AS (SELECT col, v, SUM(c) AS n_cur, SUM(r) AS n_ref FROM cvals WHERE v IS NOT NULL GROUP BY col, v),
ctot AS (SELECT col, SUM(n_cur) AS t_cur, SUM(n_ref) AS t_ref FROM ccnt GROUP BY col)"""


def _categorical_sql() -> str:
    return with_subs(CATEGORICAL_BODY, _pair_ctes(0.0) + ",\n" + _categorical_ctes())


@register("categorical_drift", oracle=_categorical_sql())
def q_categorical_drift(spark, sf_dir):
    """M3: total variation distance per categorical column (all columns reported)."""
    cur, ref = _pair(spark, sf_dir)
    return monitoring.categorical_drift(cur, ref, report_all=True)


LABEL_BODY = """
SELECT cr AS current_churn_rate, rr AS reference_churn_rate, abs(cr - rr) AS difference,
       abs(cr - rr) > 0.05 AS drift_detected,
       CASE WHEN abs(cr - rr) > 0.10 THEN 'HIGH' WHEN abs(cr - rr) > 0.05 THEN 'MEDIUM' ELSE 'NONE' END AS severity
FROM (SELECT (SELECT COUNT(*) FILTER (WHERE churn) / NULLIF(COUNT(churn), 0) FROM cur) AS cr,
             (SELECT COUNT(*) FILTER (WHERE churn) / NULLIF(COUNT(churn), 0) FROM ref) AS rr,
             (SELECT COUNT(*) FILTER (WHERE churn) FROM cur) AS cp,
             (SELECT COUNT(*) FILTER (WHERE churn) FROM ref) AS rp) x
WHERE cp > 0 AND rp > 0
"""
LABEL_SQL = with_subs(LABEL_BODY, _pair_ctes(0.0))


def _rank_sql(c: str) -> str:
    return f"(CASE {c} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END)"


def _drift_summary_ctes(shift: float = SHIFT) -> str:
    return (
        _numeric_ctes(shift) + ",\n" + _categorical_ctes()
        + f",\nnumd AS ({NUMERIC_BODY}),\nlabd AS ({LABEL_BODY}),\ncatd AS ({CATEGORICAL_BODY}),\n"
        + f"""dsum AS (
  SELECT drift_detected,
         CASE r WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'NONE' END AS severity,
         CASE WHEN drift_detected THEN 'warn' ELSE 'none' END AS action
  FROM (SELECT COALESCE(MAX(r), 0) AS r, COALESCE(BOOL_OR(d), false) AS drift_detected FROM (
          SELECT {_rank_sql('severity')} AS r, drift_detected AS d FROM numd
          UNION ALL SELECT {_rank_sql('severity')} AS r, drift_detected AS d FROM labd
          UNION ALL SELECT 0 AS r, true AS d FROM catd WHERE drift_detected) u) s)"""
    )


@register("label_drift", oracle=LABEL_SQL)
def q_label_drift(spark, sf_dir):
    """M4: churn share difference between current and reference."""
    cur, ref = _pair(spark, sf_dir)
    return monitoring.label_drift(cur, ref)


def _drift_summary_df(spark, sf_dir, shift=SHIFT):
    cur, ref = _pair(spark, sf_dir, shift)
    return monitoring.drift_summary(
        monitoring.numeric_drift(cur, ref), monitoring.label_drift(cur, ref), monitoring.categorical_drift(cur, ref)
    )


@register("drift_summary", oracle=with_subs("SELECT drift_detected, severity, action FROM dsum", _drift_summary_ctes()))
def q_drift_summary(spark, sf_dir):
    """M5: overall drift severity and action for the shifted pair."""
    return _drift_summary_df(spark, sf_dir)


@register(
    "metric_log_retention",
    oracle=with_subs(
        """
SELECT model_id, run_id, accuracy, precision, recall, f1_score, model_version FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, run_id DESC) AS rn FROM mlog) x
WHERE rn <= 50""",
        IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE,
    ),
)
def q_metric_log(spark, sf_dir):
    """Per-model metric log (stand-in) appended and trimmed to the newest 50 runs."""
    log = writers.append_metrics(spark, None, fixtures.metric_log(spark, sf_dir))
    return log.select("model_id", "run_id", "accuracy", "precision", "recall", "f1_score", "model_version")


def _degradation_body(log: str = "mlog") -> str:
    metrics = ["accuracy", "precision", "recall", "f1_score"]
    avgs = []
    for m in metrics:
        avgs.append(f"AVG(CASE WHEN rn > w AND rn <= w + bs AND {m} IS NOT NULL AND {m} <> 0 THEN {m} END) AS baseline_{m}")
        avgs.append(f"AVG(CASE WHEN rn <= w AND {m} IS NOT NULL AND {m} <> 0 THEN {m} END) AS recent_{m}")
    degr = [
        f"CASE WHEN baseline_{m} > 0 THEN (baseline_{m} - recent_{m}) / baseline_{m} ELSE 0.0 END AS {m}_degradation"
        for m in metrics
    ]
    cols = ", ".join(f"baseline_{m}, recent_{m}, {m}_degradation" for m in metrics)
    body = f"""
SELECT model_id, data_points, window_size, {cols}, max_degradation,
  CASE WHEN max_degradation >= 0.20 THEN 'CRITICAL' WHEN max_degradation >= 0.10 THEN 'HIGH'
       WHEN max_degradation >= 0.05 THEN 'MEDIUM' ELSE 'NONE' END AS severity,
  COALESCE(max_degradation >= 0.05, false) AS degradation_detected,
  CASE WHEN window_size < 3 THEN 'insufficient_data' WHEN k < 3 THEN 'unknown'
       WHEN slope < -0.001 THEN 'decreasing' WHEN slope > 0.001 THEN 'increasing' ELSE 'stable' END AS trend
FROM (
  SELECT *, GREATEST({", ".join(f"{m}_degradation" for m in metrics)}) AS max_degradation
  FROM (
    SELECT *, {", ".join(degr)} FROM (
      SELECT model_id, data_points, w AS window_size, {", ".join(avgs)},
             COUNT(*) FILTER (WHERE ok) AS k, REGR_SLOPE(CASE WHEN ok THEN accuracy END, CAST(x AS DOUBLE)) AS slope
      FROM (
        SELECT *, CASE WHEN ok THEN SUM(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY model_id ORDER BY ts, run_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS x
        FROM (
          SELECT *, rn <= w AND accuracy IS NOT NULL AND accuracy <> 0 AS ok FROM (
            SELECT *, CAST(LEAST(5, FLOOR(data_points / 2)) AS INTEGER) AS w,
                      LEAST(data_points - CAST(LEAST(5, FLOOR(data_points / 2)) AS INTEGER),
                            2 * CAST(LEAST(5, FLOOR(data_points / 2)) AS INTEGER)) AS bs
            FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, run_id DESC) AS rn,
                            COUNT(*) OVER (PARTITION BY model_id) AS data_points FROM {log}) a
          ) b WHERE rn <= 15 AND data_points >= 5) c) d
      GROUP BY model_id, data_points, w) e) f) g
"""
    return body


def _degradation_sql() -> str:
    return with_subs(_degradation_body(), IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE)


@register("performance_degradation", oracle=_degradation_sql())
def q_performance_degradation(spark, sf_dir):
    """M6 + M7 per model over the metric log stand-in."""
    return monitoring.performance_degradation(fixtures.metric_log(spark, sf_dir))


def _latest_metrics(log):
    """Latest run per model (max_by is a partial aggregate, safe for a hot model)."""
    return log.groupBy("model_id").agg(
        *[F.max_by(m, F.struct("ts", "run_id")).alias(m) for m in ["accuracy", "precision", "recall", "f1_score"]]
    )


LATEST_CTE = """latest AS (
  SELECT model_id, arg_max(accuracy, ts) AS accuracy, arg_max(precision, ts) AS precision,
         arg_max(recall, ts) AS recall, arg_max(f1_score, ts) AS f1_score FROM mlog GROUP BY model_id),
mval AS (
  SELECT model_id, metric, value, threshold, COALESCE(value >= threshold, false) AS passed FROM (
    SELECT model_id, 'accuracy' AS metric, accuracy AS value, 0.75::DOUBLE AS threshold FROM latest
    UNION ALL SELECT model_id, 'precision', precision, 0.70::DOUBLE FROM latest
    UNION ALL SELECT model_id, 'recall', recall, 0.65::DOUBLE FROM latest) x)"""


@register(
    "model_validation",
    oracle=with_subs(
        "SELECT model_id, metric, value, threshold, passed FROM mval",
        IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE + ",\n" + LATEST_CTE,
    ),
)
def q_model_validation(spark, sf_dir):
    """T9 per model: latest metrics vs the minimum thresholds."""
    return model.validate_metrics(_latest_metrics(fixtures.metric_log(spark, sf_dir)), groups=["model_id"])


def _alerts_sql() -> str:
    low = []
    for typ, m, th in [("LOW_ACCURACY", "accuracy", 0.80), ("LOW_PRECISION", "precision", 0.75),
                       ("LOW_RECALL", "recall", 0.70), ("LOW_F1_SCORE", "f1_score", 0.75)]:
        low.append(
            f"SELECT model_id, '{typ}' AS type, 'WARNING' AS severity, '{m}' AS metric, {m} AS value, "
            f"{th}::DOUBLE AS threshold FROM latest WHERE {m} < {th}::DOUBLE"
        )
    body = "\nUNION ALL\n".join(
        [
            "SELECT CAST(NULL AS VARCHAR) AS model_id, 'DATA_DRIFT' AS type, "
            "CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'HIGH' THEN 'HIGH' ELSE 'WARNING' END AS severity, "
            "CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold "
            "FROM dsum WHERE drift_detected",
            "SELECT model_id, 'MODEL_DEGRADATION', "
            "CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'HIGH' THEN 'HIGH' ELSE 'WARNING' END, "
            "'max_degradation', max_degradation, 0.05::DOUBLE FROM degr WHERE degradation_detected",
            *low,
            "SELECT model_id, 'VALIDATION_FAILED', 'CRITICAL', CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), "
            "CAST(NULL AS DOUBLE) FROM mval GROUP BY model_id HAVING NOT BOOL_AND(passed)",
        ]
    )
    ctes = (
        IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE + ",\n" + LATEST_CTE + ",\n"
        + _drift_summary_ctes() + f",\ndegr AS ({_degradation_body()})"
    )
    return with_subs(body, ctes)


@register("model_alerts", oracle=_alerts_sql())
def q_model_alerts(spark, sf_dir):
    """M8: alert table from drift, degradation, latest metrics and validation per model
    (the formatted ``message`` text is left out of the checked columns)."""
    log = fixtures.metric_log(spark, sf_dir)
    latest = _latest_metrics(log)
    validation = model.validation_summary(model.validate_metrics(latest, groups=["model_id"]), groups=["model_id"])
    out = monitoring.alerts(
        _drift_summary_df(spark, sf_dir), monitoring.performance_degradation(log), latest, validation, DEFAULT
    )
    return out.select("model_id", "type", "severity", "metric", "value", "threshold")


def _mixed(spark, sf_dir):
    cur, ref = fixtures.mixed_pair(spark, sf_dir)
    return cleaning.coerce_types(cur), cleaning.coerce_types(ref)


@register(
    "categorical_drift_mixed",
    oracle=with_subs(
        f'SELECT "column", round(total_variation_distance, 9) AS total_variation_distance, drift_detected, severity FROM ({CATEGORICAL_BODY}) c',
        fixtures.MIXED_PAIR_CTES + ",\n" + _categorical_ctes()),
)
def q_categorical_drift_mixed(spark, sf_dir):
    """M3 where categories did drift (one column strongly, one slightly); the distance, a sum of
    doubles in no fixed order, is rounded to 9 places."""
    found = monitoring.categorical_drift(*_mixed(spark, sf_dir), report_all=True)
    return found.withColumn("total_variation_distance", F.round("total_variation_distance", 9))


@register("label_drift_mixed", oracle=with_subs(LABEL_BODY, fixtures.MIXED_PAIR_CTES))
def q_label_drift_mixed(spark, sf_dir):
    """M4 where the churn share did drift."""
    return monitoring.label_drift(*_mixed(spark, sf_dir))


@register(
    "drift_stop",
    oracle=with_subs(
        "SELECT drift_detected, severity, CASE WHEN drift_detected AND severity IN ('HIGH', 'CRITICAL') THEN 'stop' "
        "WHEN drift_detected THEN 'warn' ELSE 'none' END AS action, "
        "drift_detected AND severity IN ('HIGH', 'CRITICAL') AS stopped FROM dsum",
        _drift_summary_ctes(HIGH_SHIFT),
    ),
)
def q_drift_stop(spark, sf_dir):
    """M5 with the production preset: high drift stops the run."""
    cur, ref = _pair(spark, sf_dir, HIGH_SHIFT)
    summary = monitoring.drift_summary(
        monitoring.numeric_drift(cur, ref), monitoring.label_drift(cur, ref), monitoring.categorical_drift(cur, ref), PRODUCTION
    )
    try:
        monitoring.enforce_drift_action(summary, PRODUCTION)
        stopped = False
    except monitoring.DriftStop:
        stopped = True
    return summary.withColumn("stopped", F.lit(stopped))


@register(
    "degradation_cases",
    oracle=with_subs(
        _degradation_body("mcases"),
        IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE + ",\n" + fixtures.METRIC_LOG_CASES_CTE),
)
def q_degradation_cases(spark, sf_dir):
    """M6 + M7 over short, flat, zero and halved metric logs."""
    return monitoring.performance_degradation(fixtures.metric_log_cases(spark, sf_dir))


@register(
    "metric_log_append",
    oracle=with_subs(
        """
SELECT model_id, run_id, accuracy, precision, recall, f1_score, model_version FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, run_id DESC) AS rn FROM mlog) x
WHERE rn <= 50""",
        IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE,
    ),
)
def q_metric_log_append(spark, sf_dir):
    """The runs up to 1995 stored first, the later ones appended to them; newest 50 kept."""
    log = fixtures.metric_log(spark, sf_dir)
    early = F.col("ts") < F.lit("1996-01-01").cast("timestamp")
    path = scratch_path(spark, "metrics_first")
    writers.append_metrics(spark, None, log.filter(early), path)
    out = writers.append_metrics(spark, path, log.filter(~early))
    return out.select("model_id", "run_id", "accuracy", "precision", "recall", "f1_score", "model_version")


GATE = Thresholds(min_accuracy=0.75, min_precision=0.30, min_recall=0.65)


@register(
    "registry_gate",
    oracle=with_subs(
        """
SELECT COUNT(*) AS registered, COUNT(*) FILTER (WHERE passed) AS passing,
       strftime(MAX(ts) FILTER (WHERE passed), '%Y%m') AS current_version FROM (
  SELECT ts, AVG(accuracy) >= 0.75 AND AVG(precision) >= 0.30 AND AVG(recall) >= 0.65 AS passed FROM mlog GROUP BY ts) m""",
        IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE,
    ),
)
def q_registry_gate(spark, sf_dir):
    """T9 + T10: a model version per month of the log is validated and registered, in two
    promotions; the newest passing version is current, whatever failed after it."""
    months = fixtures.metric_log(spark, sf_dir).groupBy("ts").agg(*[F.avg(m).alias(m) for m in ("accuracy", "precision", "recall", "f1_score")])
    verdict = model.validation_summary(model.validate_metrics(months, GATE, groups=["ts"]), groups=["ts"])
    version = F.date_format("ts", "yyyyMM")
    entries = months.join(verdict.select("ts", "passed"), "ts").select(
        F.concat(F.lit("models/"), version).alias("model_path"), version.alias("model_version"), "ts", "passed",
        "accuracy", "precision", "recall", "f1_score")
    early = F.col("ts") < F.lit("1996-01-01").cast("timestamp")
    path = scratch_path(spark, "registry_first")
    model.promote(spark, None, entries.filter(early), path)
    registry = model.promote(spark, path, entries.filter(~early), scratch_path(spark, "registry_second"))
    counts = registry.agg(F.count(F.lit(1)).alias("registered"), F.count_if("passed").alias("passing"))
    return counts.withColumn("current_version", model.current_model(registry).select("model_version").scalar())


@register(
    "alert_details",
    oracle=with_subs(
        """
SELECT CAST(NULL AS VARCHAR) AS model_id, 'DATA_DRIFT' AS type,
       'Data drift detected in training data (Severity: ' || severity || ')' AS text FROM dsum WHERE drift_detected
UNION ALL SELECT model_id, 'MODEL_DEGRADATION', severity || '|' || trend || '|' || CAST(data_points AS VARCHAR) FROM degr WHERE degradation_detected
UNION ALL SELECT model_id, 'VALIDATION_FAILED', 'Model validation failed - metrics below minimum thresholds: '
       || string_agg(metric, ',' ORDER BY metric) FROM mval WHERE NOT passed GROUP BY model_id""",
        IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE + ",\n" + LATEST_CTE + ",\n" + _drift_summary_ctes()
        + f",\ndegr AS ({_degradation_body()})",
    ),
)
def q_alert_details(spark, sf_dir):
    """M8: message and details of the drift, degradation and validation alerts."""
    log = fixtures.metric_log(spark, sf_dir)
    latest = _latest_metrics(log)
    validation = model.validation_summary(model.validate_metrics(latest, groups=["model_id"]), groups=["model_id"])
    out = monitoring.alerts(_drift_summary_df(spark, sf_dir), monitoring.performance_degradation(log), None, validation, DEFAULT)
    d = F.col("details")
    text = (
        F.when(F.col("type") == "MODEL_DEGRADATION", F.concat_ws("|", d["degradation_severity"], d["trend"], d["data_points"]))
        .when(F.col("type") == "VALIDATION_FAILED", F.concat_ws(": ", "message", F.array_join(F.array_sort(F.map_keys(d)), ",")))
        .otherwise(F.col("message"))
    )
    return out.select("model_id", "type", text.alias("text"))
