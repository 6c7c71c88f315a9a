"""Stand-in inputs derived from the shared test tables.

The test data holds no subscriber table, so one is derived from ``customer`` and
``orders`` by the SQL below (it runs unchanged in Spark SQL and DuckDB).  The view only
produces rows in the subscriber schema; none of the churn jobs' work happens here, and
no job relies on how these rows were made.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBSCRIBER_SQL = """
WITH o AS (
  SELECT o_custkey, COUNT(DISTINCT date_trunc('month', o_orderdate)) AS m
  FROM {orders} GROUP BY o_custkey),
b AS (
  SELECT c.c_custkey AS k, CAST(COALESCE(o.m, 0) AS INT) AS t,
         (c.c_custkey * 7919 + 17) % 10007 AS h1, (c.c_custkey * 6151 + 29) % 10009 AS h2,
         (c.c_custkey * 3571 + 41) % 10037 AS h3, (c.c_custkey * 2207 + 53) % 10039 AS h4,
         c.c_nationkey AS nk, c.c_acctbal AS bal
  FROM {customer} c LEFT JOIN o ON o.o_custkey = c.c_custkey),
s AS (
  SELECT *, h1 % 10 <> 0 AS phone,
         CASE WHEN h2 % 10 < 2 THEN 'No' WHEN h2 % 10 < 6 THEN 'DSL' ELSE 'Fiber optic' END AS inet,
         CAST(2000 + h3 % 10001 AS BIGINT) AS mc_cents
  FROM b)
SELECT CONCAT('CUST-', LPAD(CAST(k AS VARCHAR(20)), 7, '0')) AS customer_id,
  CASE WHEN h1 % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  h2 % 5 = 0 AS senior_citizen, h3 % 2 = 0 AS partner, h4 % 10 < 3 AS dependents,
  phone AS phone_service,
  CASE WHEN NOT phone THEN 'No phone service' WHEN h1 % 7 < 3 THEN 'Yes' ELSE 'No' END AS multiple_lines,
  inet AS internet_service,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN h1 % 3 = 0 THEN 'Yes' ELSE 'No' END AS online_security,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN h2 % 3 = 0 THEN 'Yes' ELSE 'No' END AS online_backup,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN h3 % 3 = 0 THEN 'Yes' ELSE 'No' END AS device_protection,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN h4 % 3 = 0 THEN 'Yes' ELSE 'No' END AS tech_support,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN h1 % 11 < 5 THEN 'Yes' ELSE 'No' END AS streaming_tv,
  CASE WHEN inet = 'No' THEN 'No internet service' WHEN h2 % 11 < 5 THEN 'Yes' ELSE 'No' END AS streaming_movies,
  CASE WHEN h4 % 10 < 6 THEN 'Month-to-month' WHEN h4 % 10 < 8 THEN 'One year' ELSE 'Two year' END AS contract_type,
  h3 % 5 < 3 AS paperless_billing,
  CASE WHEN h1 % 5 < 2 THEN 'Electronic check' WHEN h1 % 5 = 2 THEN 'Mailed check'
       WHEN h1 % 5 = 3 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS payment_method,
  CAST(mc_cents AS DOUBLE) / 100 AS monthly_charges,
  CASE WHEN h2 % 29 = 0 THEN NULL WHEN h2 % 31 = 0 THEN CAST(mc_cents * t AS DOUBLE) / 50
       ELSE CAST(mc_cents * t AS DOUBLE) / 25 END AS total_charges,
  t * 4 AS tenure_months,
  CASE WHEN h3 % 41 = 0 THEN NULL
       WHEN (CASE WHEN h4 % 10 < 6 THEN 30 ELSE 0 END) + (CASE WHEN t < 6 THEN 25 ELSE 0 END)
          + (CASE WHEN mc_cents > 8000 THEN 15 ELSE 0 END) + h2 % 40 >= 70 THEN TRUE ELSE FALSE END AS churn
FROM s
"""


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def subscriber_sql_spark(sf_dir: str) -> str:
    return SUBSCRIBER_SQL.format(
        orders=f"parquet.`{table_path(sf_dir, 'orders')}`",
        customer=f"parquet.`{table_path(sf_dir, 'customer')}`",
    )


def subscriber_sql_oracle() -> str:
    """The same view over DuckDB's pre-registered tables, for use as a CTE."""
    return SUBSCRIBER_SQL.format(orders="orders", customer="customer")


_MATERIALIZED: dict[tuple[str, str], str] = {}


def subscribers(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Typed subscriber table (schema of ``schema.SUBSCRIBER_SCHEMA``).

    By default the view is written once per application as parquet under the shared
    checkpoint folder and read back, as a production subscriber table would be stored;
    downstream jobs then scan plain columns (pushdown, pruning, small generated code)."""
    if not materialize:
        return spark.sql(subscriber_sql_spark(sf_dir))
    from .session import scratch_path

    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    path = _MATERIALIZED.get(key)
    if path is None:
        path = scratch_path(spark, "subscribers")
        # one file per core, hash-partitioned by id (the key of every maintenance job);
        # an explicit count keeps AQE from collapsing a small table into one task
        parts = spark.sparkContext.defaultParallelism
        spark.sql(subscriber_sql_spark(sf_dir)).repartition(parts, "customer_id").write.parquet(path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def clean_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscriber table typed (P1) with missing total charges imputed."""
    from .operators import cleaning

    return cleaning.impute(cleaning.coerce_types(subscribers(spark, sf_dir)))


def customer_key(id_col) -> "F.Column":
    """Numeric customer key of a ``CUST-nnnnnnn`` id (the view's id format)."""
    return F.regexp_extract(id_col, r"^CUST-([0-9]+)$", 1).cast("bigint")


def drift_pair(spark: SparkSession, sf_dir: str, shift_monthly: float = 0.0):
    """(current, reference): even-numbered ids vs odd-numbered ids of the whole view.

    ``shift_monthly`` adds a constant to current ``monthly_charges`` for a positive case.
    """
    subs = subscribers(spark, sf_dir)
    k = customer_key(F.col("customer_id"))
    cur = subs.filter(k % 2 == 0)
    if shift_monthly:
        cur = cur.withColumn("monthly_charges", F.col("monthly_charges") + F.lit(float(shift_monthly)))
    ref = subs.filter(k % 2 == 1)
    return cur, ref


def rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored-table stand-in for SQL-checkable scoring rules: cleaned subscribers with
    ``probability_churn`` = rule score / 100 and ``prediction`` = probability >= 0.5.

    Model-based scores come from ``operators.model``; this stand-in only supplies
    deterministic rows in the scored schema so downstream rules can be checked by SQL."""
    from .operators import cleaning, features

    df = features.add_rule_features(cleaning.impute(cleaning.coerce_types(subscribers(spark, sf_dir))))
    p = F.col("risk_score") / F.lit(100.0)
    return df.withColumn("probability_churn", p).withColumn("prediction", p >= F.lit(0.5))


RULE_SCORED_CTE = """rs AS (
  SELECT *, risk_score / 100.0 AS probability_churn, risk_score / 100.0 >= 0.5 AS prediction FROM rules)"""


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric-log stand-in for the fleet monitors: one row per (model, month).

    A "model" is the rule predictor (rule score >= 70) serving one nation's orders;
    each month its orders' subscribers are scored against their labels with the
    library's grouped evaluation.  Rows follow ``schema.METRICS_SCHEMA``.  Like the
    subscriber table it is stored once per application and read back."""
    from .session import scratch_path

    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir) + "#metric_log")
    path = _MATERIALIZED.get(key)
    if path is None:
        path = scratch_path(spark, "model_metrics_log")
        _metric_log(spark, sf_dir).write.parquet(path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def _metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import cleaning, evaluation, features

    subs = features.add_rule_features(cleaning.impute(cleaning.coerce_types(subscribers(spark, sf_dir))))
    subs = subs.select(customer_key(F.col("customer_id")).alias("_k"), "churn", "risk_score")
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .join(nation, cust.c_nationkey == nation.n_nationkey)
        .join(subs, orders.o_custkey == subs._k)
        .select(
            F.col("n_name").alias("model_id"),
            F.date_trunc("month", F.col("o_orderdate")).alias("ts"),
            "churn",
            (F.col("risk_score") >= F.lit(70.0)).alias("prediction"),
        )
    )
    m = evaluation.confusion_metrics(rows, "churn", "prediction", ["model_id", "ts"])
    return m.select(
        "model_id", "ts", "accuracy", "precision", "recall", "f1_score",
        F.lit("1.0.0").alias("model_version"),
        F.concat(F.col("model_id"), F.lit("-"), F.date_format("ts", "yyyyMM")).alias("run_id"),
    )


METRIC_LOG_CTE = """ml_rows AS (
  SELECT n.n_name AS model_id, date_trunc('month', o.o_orderdate) AS ts, r.churn AS label, r.risk_score >= 70 AS pred
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN rules r ON CAST(regexp_extract(r.customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) = o.o_custkey
  WHERE r.churn IS NOT NULL),
ml_cnt AS (
  SELECT model_id, ts, COUNT(*) AS n, COUNT(*) FILTER (WHERE label AND pred) AS tp,
         COUNT(*) FILTER (WHERE NOT label AND pred) AS fp, COUNT(*) FILTER (WHERE label AND NOT pred) AS fn,
         COUNT(*) FILTER (WHERE NOT label AND NOT pred) AS tn
  FROM ml_rows GROUP BY model_id, ts),
ml_pr AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM ml_cnt),
mlog AS (
  SELECT model_id, ts, CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END AS accuracy, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score,
         '1.0.0' AS model_version, model_id || '-' || strftime(ts, '%Y%m') AS run_id
  FROM ml_pr)"""


def change_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(base, changes) stand-ins for keyed maintenance.

    base = odd-numbered subscribers.  changes (with ``change_seq``, arrival order):
    active subscribers one billing month later; churned subscribers twice (as stored,
    then a later correction of +1.00 monthly); unlabelled subscribers as new sign-ups
    without an id."""
    from .operators import cleaning

    subs = cleaning.coerce_types(subscribers(spark, sf_dir))
    k = customer_key(F.col("customer_id"))
    base = subs.filter(k % 2 == 1)
    seq = k.cast("bigint")
    later = F.lit(10**12)
    month = (
        subs.filter(F.col("churn") == F.lit(False))
        .withColumn("change_seq", seq)
        .withColumn("total_charges", F.col("total_charges") + F.col("monthly_charges"))
        .withColumn("tenure_months", F.col("tenure_months") + F.lit(1))
    )
    churned = subs.filter(F.col("churn") == F.lit(True))
    first = churned.withColumn("change_seq", seq)
    fix = churned.withColumn("change_seq", seq + later).withColumn(
        "monthly_charges", F.col("monthly_charges") + F.lit(1.0)
    )
    signups = subs.filter(F.col("churn").isNull()).withColumn("change_seq", seq).withColumn(
        "customer_id", F.lit(None).cast("string")
    )
    changes = month.unionByName(first).unionByName(fix).unionByName(signups)
    return base, changes


CHANGE_FEED_CTES = """base AS (SELECT * FROM subs WHERE CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) % 2 = 1),
changes AS (
  SELECT * REPLACE (total_charges + monthly_charges AS total_charges, tenure_months + 1 AS tenure_months),
         CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) AS change_seq
  FROM subs WHERE churn = false
  UNION ALL
  SELECT *, CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) AS change_seq FROM subs WHERE churn = true
  UNION ALL
  SELECT * REPLACE (monthly_charges + 1.0::DOUBLE AS monthly_charges),
         CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) + 1000000000000 AS change_seq
  FROM subs WHERE churn = true
  UNION ALL
  SELECT * REPLACE (CAST(NULL AS VARCHAR) AS customer_id),
         CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) AS change_seq
  FROM subs WHERE churn IS NULL)"""


def broken_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells of the subscriber view as a careless upload holds them: by key, cells are out of
    range, outside their domain, contradictory, missing or not readable as their type."""
    subs = subscribers(spark, sf_dir)
    case = customer_key(F.col("customer_id")) % 12
    text = {c: F.when(F.col(c), "Yes").otherwise("No") for c in ("senior_citizen", "partner", "dependents", "phone_service", "paperless_billing")}
    text["tenure_months"] = F.concat(F.col("tenure_months").cast("string"), F.lit(".0"))
    df = subs.withColumns({c: text.get(c, F.col(c).cast("string")) for c in subs.columns})
    cells = [
        (0, "monthly_charges", "-5"), (1, "total_charges", "-1"), (2, "tenure_months", "-3"), (3, "gender", "Other"),
        (4, "phone_service", "no"), (4, "multiple_lines", "Yes"), (5, "internet_service", "No"), (5, "online_security", "Yes"),
        (6, "contract_type", None), (7, "monthly_charges", "abc"), (8, "partner", "maybe"), (9, "tenure_months", "12.5"),
        (10, "payment_method", "Cash"), (10, "contract_type", "Weekly"),
    ]
    for key, name, cell in cells:
        df = df.withColumn(name, F.when(case == key, F.lit(cell).cast("string")).otherwise(F.col(name)))
    return df


BROKEN_CTE = """broken AS (
  SELECT * EXCLUDE (kk) REPLACE (
    CASE kk WHEN 0 THEN -5.0::DOUBLE WHEN 7 THEN NULL ELSE monthly_charges END AS monthly_charges,
    CASE kk WHEN 1 THEN -1.0::DOUBLE ELSE total_charges END AS total_charges,
    CASE kk WHEN 2 THEN -3 WHEN 9 THEN NULL ELSE tenure_months END AS tenure_months,
    CASE kk WHEN 3 THEN 'Other' ELSE gender END AS gender,
    CASE kk WHEN 4 THEN false ELSE phone_service END AS phone_service,
    CASE kk WHEN 4 THEN 'Yes' ELSE multiple_lines END AS multiple_lines,
    CASE kk WHEN 5 THEN 'No' ELSE internet_service END AS internet_service,
    CASE kk WHEN 5 THEN 'Yes' ELSE online_security END AS online_security,
    CASE kk WHEN 6 THEN NULL WHEN 10 THEN 'Weekly' ELSE contract_type END AS contract_type,
    CASE kk WHEN 8 THEN NULL ELSE partner END AS partner,
    CASE kk WHEN 10 THEN 'Cash' ELSE payment_method END AS payment_method)
  FROM (SELECT *, CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) % 12 AS kk FROM subs) b)"""


def mixed_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A drift pair whose current side has other shares: every contract month-to-month, a quarter
    of the payments by electronic check, a fifth of the subscribers churned."""
    cur, ref = drift_pair(spark, sf_dir)
    k = customer_key(F.col("customer_id"))
    return cur.withColumns({
        "contract_type": F.lit("Month-to-month"),
        "payment_method": F.when(k % 8 == 0, "Electronic check").otherwise(F.col("payment_method")),
        "churn": F.when(k % 10 == 0, True).otherwise(F.col("churn")),
    }), ref


MIXED_PAIR_CTES = """subs_k AS (SELECT *, CAST(regexp_extract(customer_id, '^CUST-([0-9]+)$', 1) AS BIGINT) AS kk FROM subs),
cur AS (SELECT * REPLACE ('Month-to-month' AS contract_type,
    CASE WHEN kk % 8 = 0 THEN 'Electronic check' ELSE payment_method END AS payment_method,
    CASE WHEN kk % 10 = 0 THEN true ELSE churn END AS churn) FROM subs_k WHERE kk % 2 = 0),
ref AS (SELECT * FROM subs_k WHERE kk % 2 = 1)"""


def metric_log_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric logs of four kinds per model of ``metric_log``: its 5 newest runs only; an accuracy
    that never moves; newest accuracies of zero; newest runs with all metrics halved."""
    from pyspark.sql import Window

    log = metric_log(spark, sf_dir)
    newest = Window.partitionBy("model_id").orderBy(F.desc("ts"), F.desc("run_id"))
    log = log.withColumn("rn", F.row_number().over(newest))
    named = lambda df, kind: df.withColumn("model_id", F.concat("model_id", F.lit(f"-{kind}"))).drop("rn")
    metrics = ("accuracy", "precision", "recall", "f1_score")
    return (
        named(log.filter("rn <= 5"), "short")
        .unionByName(named(log.withColumn("accuracy", F.lit(0.75)), "flat"))
        .unionByName(named(log.withColumn("accuracy", F.when(F.col("rn") <= 3, 0.0).otherwise(F.col("accuracy"))), "zero"))
        .unionByName(named(log.withColumns({m: F.when(F.col("rn") <= 5, F.col(m) / 2).otherwise(F.col(m)) for m in metrics}), "halved"))
    )


METRIC_LOG_CASES_CTE = """mrank AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, run_id DESC) AS nth FROM mlog),
mcases AS (
  SELECT * EXCLUDE (nth) REPLACE (model_id || '-short' AS model_id) FROM mrank WHERE nth <= 5
  UNION ALL SELECT * EXCLUDE (nth) REPLACE (model_id || '-flat' AS model_id, 0.75::DOUBLE AS accuracy) FROM mrank
  UNION ALL SELECT * EXCLUDE (nth) REPLACE (model_id || '-zero' AS model_id,
    CASE WHEN nth <= 3 THEN 0.0::DOUBLE ELSE accuracy END AS accuracy) FROM mrank
  UNION ALL SELECT * EXCLUDE (nth) REPLACE (model_id || '-halved' AS model_id,
    CASE WHEN nth <= 5 THEN accuracy / 2 ELSE accuracy END AS accuracy,
    CASE WHEN nth <= 5 THEN precision / 2 ELSE precision END AS precision,
    CASE WHEN nth <= 5 THEN recall / 2 ELSE recall END AS recall,
    CASE WHEN nth <= 5 THEN f1_score / 2 ELSE f1_score END AS f1_score) FROM mrank)"""
