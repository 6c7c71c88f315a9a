"""Registered queries: scoring by registry, the metric log followed as a stream, stored quantile sketches."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import model, quantile_sketch, registry_scoring, scoring
from ..session import scratch_path
from ..streaming import metric_monitor
from .catalog import register
from .q_monitoring import _degradation_body
from .sql_fragments import IMPUTED_FEATURES_CTE, LIFETIME_SQL, SCORED_CTES, errors_sql, with_subs

MLOG = IMPUTED_FEATURES_CTE + ",\n" + fixtures.METRIC_LOG_CTE

# -- scoring by registry (T10, C1, C2) -----------------------------------------------------

# pipelines whose outcome SQL can state: charges, and tenure with a confidence of its own
CHARGES = "SELECT *, least(monthly_charges / 200D, 1D) AS probability_churn, monthly_charges >= 100 AS prediction FROM __THIS__"
TENURE = ("SELECT *, 12D / (12D + tenure_months) AS probability_churn, tenure_months <= 12 AS prediction, "
          "CASE WHEN senior_citizen THEN 0.9D END AS confidence FROM __THIS__")
MODEL_OF = {"Month-to-month": "monthly", "One year": "yearly"}


def _saved(spark, rows, statement: str) -> str:
    return model.save_model(Pipeline(stages=[SQLTransformer(statement=statement)]).fit(model.model_input(rows, None).limit(1)), scratch_path(spark, "rule_model"))


def _routed(spark, sf_dir):
    """Subscribers with the id of the model of their contract: "other" for those of two years."""
    of = F.create_map(*[F.lit(x) for pair in MODEL_OF.items() for x in pair])
    return fixtures.clean_subscribers(spark, sf_dir).withColumn("model_id", F.coalesce(F.try_element_at(of, F.col("contract_type")), F.lit("other")))


def _fleet_registry(spark, rows):
    """Charges for every model, then tenure: taken for "monthly", failed by "yearly"; "other" is retired."""
    charges, tenure = _saved(spark, rows, CHARGES), _saved(spark, rows, TENURE)
    path = scratch_path(spark, "fleet_registry")
    schema = "model_id string, model_path string, model_version string, ts timestamp, passed boolean"
    at = [dt.datetime(2024, m, 1) for m in (1, 2, 3)]
    first = [(m, charges, None if m == "yearly" else "1.0", at[0], True) for m in ("monthly", "yearly", "other")]
    model.register_run(spark.createDataFrame(first, schema), path, "first")
    model.register_run(spark.createDataFrame([("monthly", tenure, "2.0", at[1], True), ("yearly", tenure, "2.0", at[1], False)], schema), path, "second")
    registry_scoring.retire(spark, path, ["other"], "third", at[2])
    return model.read_registry(spark, path)


def _served_sql(model_id: str, version: str, p: str, prediction: str, confidence: str, where: str) -> str:
    level = ("CASE WHEN p > 0.8 AND c > 0.7 THEN 'Critical' WHEN p > 0.6 AND c > 0.5 THEN 'High' "
             "WHEN p > 0.4 AND c > 0.3 THEN 'Medium' ELSE 'Low' END")
    lifetime = LIFETIME_SQL.replace("COALESCE(churn, false)", "false")
    return f"""
SELECT {model_id} AS model_id, customer_id, {prediction} AS prediction, p AS probability_churn, 1.0::DOUBLE - p AS probability_stay,
       c AS confidence, {level} AS risk_level, risk_score,
       CASE WHEN monthly_charges > 70 THEN 'high' ELSE 'low' END || '_value_' || CASE WHEN p >= 0.5 THEN 'high' ELSE 'low' END || '_risk'
         AS customer_segment, {lifetime} AS lifetime_value, {version} AS model_version
FROM (SELECT *, {p} AS p, {confidence} AS c FROM rules WHERE {where} AND {errors_sql()} = '') x"""


_CHARGES_SQL = ("LEAST(monthly_charges / 200::DOUBLE, 1::DOUBLE)", "monthly_charges >= 100", "0.8::DOUBLE")
_TENURE_SQL = ("12::DOUBLE / (12::DOUBLE + tenure_months)", "tenure_months <= 12", "CASE WHEN senior_citizen THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END")


@register("score_by_registry", oracle=with_subs(
    _served_sql("'monthly'", "'2.0'", *_TENURE_SQL, "contract_type = 'Month-to-month'") + "\nUNION ALL"
    + _served_sql("'yearly'", "'unknown'", *_CHARGES_SQL, "contract_type = 'One year'"), IMPUTED_FEATURES_CTE))
def q_score_by_registry(spark, sf_dir):
    """T10 + C1 + C2: every subscriber scored by the version its contract's model serves now: a newer version,
    one whose successor failed, and none."""
    rows = _routed(spark, sf_dir)
    scored, _ = registry_scoring.score_by_registry(rows, _fleet_registry(spark, rows))
    return scored.drop("prediction_timestamp")


@register("registry_errors", oracle=with_subs(
    f"""
SELECT customer_id, CASE contract_type WHEN 'Month-to-month' THEN 'monthly' WHEN 'One year' THEN 'yearly' ELSE 'other' END AS model_id,
       CASE WHEN contract_type IN ('Month-to-month', 'One year') THEN {errors_sql()} ELSE 'no_current_model' END AS error
FROM rules WHERE COALESCE(contract_type NOT IN ('Month-to-month', 'One year'), true) OR {errors_sql()} <> ''""", IMPUTED_FEATURES_CTE))
def q_registry_errors(spark, sf_dir):
    """C2 by registry: the rows that no current model takes, and those that break rules."""
    rows = _routed(spark, sf_dir)
    return registry_scoring.score_by_registry(rows, _fleet_registry(spark, rows))[1]


@register("score_fleet", oracle=with_subs(
    """
SELECT model_id, model_version, COUNT(*) AS scored, SUM(CASE WHEN prediction THEN 1 ELSE 0 END)::BIGINT AS predicted FROM ("""
    + _served_sql("'monthly'", "'2.0'", *_TENURE_SQL, "contract_type = 'Month-to-month'") + "\nUNION ALL"
    + _served_sql("'yearly'", "'unknown'", *_CHARGES_SQL, "contract_type = 'One year'") + ") y GROUP BY model_id, model_version", IMPUTED_FEATURES_CTE))
def q_score_fleet(spark, sf_dir):
    """T10 + C2 over a table kept by model id, a pipeline a batch, as a fleet too large for one plan is scored."""
    rows = _routed(spark, sf_dir)
    path = scratch_path(spark, "fleet_rows")
    rows.write.partitionBy("model_id").parquet(path)
    done = registry_scoring.score_fleet(spark.read.parquet(path), _fleet_registry(spark, rows), scratch_path(spark, "fleet_scored"), batch=1)
    return done.groupBy("model_id", "model_version").agg(F.count(F.lit(1)).alias("scored"), F.count_if("prediction").alias("predicted"))


_ONE_MODEL = _served_sql("'x'", "'unknown'", *_CHARGES_SQL, "true")
_ALL_COLUMNS = "customer_id, prediction, probability_churn, probability_stay, confidence, risk_level, risk_score, customer_segment, lifetime_value, model_version"


@register("score_batch_bare", oracle=with_subs(f"SELECT {_ALL_COLUMNS} FROM ({_ONE_MODEL}) y", IMPUTED_FEATURES_CTE))
def q_score_batch_bare(spark, sf_dir):
    """C1 + C2: a saved model without confidence or version; the defaults 0.8 and unknown are served."""
    rows = fixtures.clean_subscribers(spark, sf_dir)
    return scoring.score_batch(rows, model.load_model(_saved(spark, rows, CHARGES)), version=None)[0].drop("prediction_timestamp")


@register("score_csv_bare", oracle=with_subs(
    f"SELECT {_ALL_COLUMNS.replace('model_version', chr(39) + '1.0.0' + chr(39) + ' AS model_version')} FROM ({_ONE_MODEL}) y",
    IMPUTED_FEATURES_CTE))
def q_score_csv_bare(spark, sf_dir):
    """The scored side of an uploaded CSV."""
    rows = fixtures.clean_subscribers(spark, sf_dir)
    path = scratch_path(spark, "upload_scored_csv")
    rows.write.option("header", True).csv(path)
    return scoring.score_csv(spark, path, model.load_model(_saved(spark, rows, CHARGES)))[0].drop("prediction_timestamp")


# -- the metric log as a stream (M6, M7, M8) -----------------------------------------------


def _followed(spark, sf_dir):
    """The metric log in three deliveries to one stream: late runs, repeated runs and runs first sent with
    wrong metrics.  Returns the output folder."""
    log = fixtures.metric_log(spark, sf_dir).drop("model_version").withColumn("model_version", F.lit("1.0"))
    deal = F.pmod(F.xxhash64("model_id", "run_id"), F.lit(3))
    wrong = log.filter(deal == 0).withColumns({m: F.col(m) / 3 for m in ("accuracy", "precision", "recall", "f1_score")})
    inbox, out, state = (scratch_path(spark, n) for n in ("metric_inbox", "metric_monitor", "metric_state"))
    for rows in (log.filter(deal == 2).unionByName(wrong), log.filter(deal == 1).unionByName(log.filter(deal == 2)), log.filter(deal == 0)):
        rows.repartition(3, "run_id").write.mode("append").parquet(inbox)
        metric_monitor.start_metric_monitor(spark, inbox, out, state, max_files_per_trigger=2).awaitTermination()
    return out


@register("streamed_degradation", oracle=with_subs(_degradation_body(), MLOG))
def q_streamed_degradation(spark, sf_dir):
    """M6 + M7 as a stateful stream: the outcome after late, repeated and corrected runs is that of the batch."""
    return metric_monitor.latest_degradation(spark, _followed(spark, sf_dir))


# -- stored quantile sketches (A9) -----------------------------------------------------------


@register("probability_sketches", oracle=with_subs(
    """
SELECT contract_type, COUNT(*) AS n, MIN(probability_churn) AS least, MAX(probability_churn) AS greatest, true AS near
FROM rs WHERE contract_type IS NOT NULL GROUP BY contract_type
UNION ALL SELECT 'all', COUNT(*), MIN(probability_churn), MAX(probability_churn), true FROM rs WHERE contract_type IS NOT NULL""", SCORED_CTES))
def q_probability_sketches(spark, sf_dir):
    """Scores kept as one sketch a sign-up quarter and contract, merged to contracts and to one;
    ``near``: the shares of values below and up to the merged median hold a half, within the rank error."""
    rows = fixtures.rule_scored(spark, sf_dir).filter("contract_type IS NOT NULL")
    path = scratch_path(spark, "score_sketches")
    quarter = F.coalesce(F.pmod(F.col("tenure_months").cast("long"), F.lit(4)), F.lit(0))
    for day in range(4):
        quantile_sketch.store_day(rows.filter(quarter == day), path, f"q{day}", groups=["contract_type"])
    stored = quantile_sketch.read_days(spark, path, "contract_type string")
    whole = quantile_sketch.merged(stored).withColumn("contract_type", F.lit("all"))
    every = quantile_sketch.merged(stored, ["contract_type"]).unionByName(whole, allowMissingColumns=True).withColumn("median", quantile_sketch.quantile(0.5))
    # every score counts for its contract and for all; one row a contract is joined
    scores = rows.select("probability_churn", F.explode(F.array("contract_type", F.lit("all"))).alias("contract_type"))
    ranks = scores.join(F.broadcast(every.select("contract_type", "median")), "contract_type").groupBy("contract_type").agg(
        F.avg((F.col("probability_churn") < F.col("median")).cast("double")).alias("under"),
        F.avg((F.col("probability_churn") <= F.col("median")).cast("double")).alias("upto"))
    slack = quantile_sketch.RANK_ERROR
    return every.join(ranks, "contract_type").select(
        "contract_type", "n", "least", "greatest", ((F.col("under") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)).alias("near"))
