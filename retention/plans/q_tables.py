"""Registered queries: keyed upsert, update, delete and new ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..operators import tables
from ..schema import REQUIRED_COLUMNS
from .catalog import register
from .sql_fragments import with_subs

COLS = ", ".join(REQUIRED_COLUMNS)
# D17 in SQL: largest parsable id over base + change ids, then numbering by arrival
NEW_IDS_CTE = """maxid AS (
  SELECT COALESCE(MAX(TRY_CAST(NULLIF(regexp_extract(customer_id, '^CUST-([0-9]+)(-.*)?$', 1), '') AS DECIMAL(38,0))), 0) AS m
  FROM (SELECT customer_id FROM base UNION ALL SELECT customer_id FROM changes) u),
keyed AS (
  SELECT * FROM changes WHERE customer_id IS NOT NULL
  UNION ALL
  SELECT * REPLACE (printf('CUST-%04d', CAST((SELECT m FROM maxid) + row_number() OVER (ORDER BY change_seq) AS BIGINT))
                    AS customer_id)
  FROM changes WHERE customer_id IS NULL),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY change_seq DESC) AS rn FROM keyed) x WHERE rn = 1)"""


@register(
    "upsert_subscribers",
    oracle=with_subs(
        f"SELECT {COLS} FROM base WHERE customer_id NOT IN (SELECT customer_id FROM latest) "
        f"UNION ALL SELECT {COLS} FROM latest",
        fixtures.CHANGE_FEED_CTES + ",\n" + NEW_IDS_CTE,
    ),
)
def q_upsert(spark, sf_dir):
    """U1 + D17: apply the change feed to the base table (replace by id, append, new ids)."""
    base, changes = fixtures.change_feed(spark, sf_dir)
    return tables.upsert(base, changes, "change_seq").select(*REQUIRED_COLUMNS)


@register(
    "new_customer_ids",
    oracle=with_subs(
        "SELECT customer_id, change_seq FROM keyed WHERE change_seq IN "
        "(SELECT change_seq FROM changes WHERE customer_id IS NULL)",
        fixtures.CHANGE_FEED_CTES + ",\n" + NEW_IDS_CTE,
    ),
)
def q_new_ids(spark, sf_dir):
    """Ids given to sign-ups that arrived without one."""
    base, changes = fixtures.change_feed(spark, sf_dir)
    existing = base.select("customer_id").unionByName(changes.select("customer_id"))
    out = tables.assign_new_ids(existing, changes, "change_seq")
    signups = changes.filter(F.col("customer_id").isNull()).select("change_seq")
    return out.join(signups, "change_seq", "left_semi").select("customer_id", "change_seq")


@register(
    "update_existing",
    oracle=with_subs(
        f"SELECT {COLS} FROM base WHERE customer_id NOT IN (SELECT customer_id FROM latest) "
        f"UNION ALL SELECT {COLS} FROM latest",
        fixtures.CHANGE_FEED_CTES.replace("changes AS (", "changes_all AS (", 1)
        + ",\nchanges AS (SELECT * FROM changes_all WHERE customer_id IN (SELECT customer_id FROM base))"
        + ",\nlatest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id "
        "ORDER BY change_seq DESC) AS rn FROM changes) x WHERE rn = 1)",
    ),
)
def q_update_existing(spark, sf_dir):
    """Apply changes only to ids already stored."""
    base, changes = fixtures.change_feed(spark, sf_dir)
    table, _ = tables.update_existing(base, changes, "change_seq")
    return table.select(*REQUIRED_COLUMNS)


@register(
    "update_not_found",
    oracle=with_subs(
        "SELECT DISTINCT customer_id FROM changes WHERE customer_id NOT IN (SELECT customer_id FROM base)",
        fixtures.CHANGE_FEED_CTES,
    ),
)
def q_update_not_found(spark, sf_dir):
    """U2 report: change ids with no stored row."""
    base, changes = fixtures.change_feed(spark, sf_dir)
    _, missing = tables.update_existing(base, changes, "change_seq")
    return missing.filter(F.col("customer_id").isNotNull())


@register(
    "delete_churned",
    oracle=with_subs(
        f"SELECT {COLS} FROM base WHERE customer_id NOT IN (SELECT customer_id FROM subs WHERE churn)",
        fixtures.CHANGE_FEED_CTES,
    ),
)
def q_delete(spark, sf_dir):
    """Delete every churned subscriber id from the base table."""
    base, _ = fixtures.change_feed(spark, sf_dir)
    subs = fixtures.subscribers(spark, sf_dir)
    remaining, _ = tables.delete(base, subs.filter(F.col("churn")).select("customer_id"))
    return remaining.select(*REQUIRED_COLUMNS)


@register(
    "delete_report",
    oracle=with_subs(
        "SELECT DISTINCT customer_id, customer_id IN (SELECT customer_id FROM base) AS deleted FROM subs WHERE churn",
        fixtures.CHANGE_FEED_CTES,
    ),
)
def q_delete_report(spark, sf_dir):
    """U3 report: for each requested id, whether it was present."""
    base, _ = fixtures.change_feed(spark, sf_dir)
    subs = fixtures.subscribers(spark, sf_dir)
    _, report = tables.delete(base, subs.filter(F.col("churn")).select("customer_id"))
    return report
