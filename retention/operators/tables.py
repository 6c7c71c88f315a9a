"""Keyed table maintenance (U1-U3, D17) as set operations on DataFrames.

A change set is deduplicated to its latest version per key with ``row_number() <= 1`` (a
group limit on the map side: a key with millions of versions costs one row per task before
the shuffle).
Base rows are replaced with a left-anti join plus union; the small side of each join
is left to the planner's size statistics (AQE can switch to a broadcast at run time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import sequence_numbers

ID_PREFIX = "CUST-"


def parse_id_number(id_col: Column) -> Column:
    """Number of a ``CUST-<digits>[-...]`` id; null for ids that do not parse."""
    digits = F.regexp_extract(id_col, r"^CUST-([0-9]+)(-.*)?$", 1)
    return F.when(digits != "", digits.try_cast("decimal(38,0)"))


def format_id(n: Column) -> Column:
    """``CUST-`` + at least four digits."""
    return F.concat(F.lit(ID_PREFIX), F.format_string("%04d", n.cast("bigint")))


def assign_new_ids(existing: DataFrame, rows: DataFrame, order_col: str, key: str = "customer_id") -> DataFrame:
    """Rows with a null id get CUST-(max+1), (max+2), ... in ``order_col`` order,
    where max is the largest parsable id number in ``existing`` (0 when none)."""
    max_num = existing.select(F.coalesce(F.max(parse_id_number(F.col(key))), F.lit(0))).scalar()
    with_ids = rows.filter(F.col(key).isNotNull())
    new = sequence_numbers(rows.filter(F.col(key).isNull()), order_col, "_seq")
    new = new.withColumn(key, format_id(max_num + F.col("_seq"))).drop("_seq")
    return with_ids.unionByName(new)


def latest_per_key(changes: DataFrame, order_col: str, key: str = "customer_id") -> DataFrame:
    """The newest version of each key (ties broken by the whole row, deterministically)."""
    cols = [c for c in changes.columns if c != key]
    newest = Window.partitionBy(key).orderBy(F.desc(order_col), *[F.desc(c) for c in cols if c != order_col])
    return changes.withColumn("_rn", F.row_number().over(newest)).filter("_rn <= 1").select(key, *cols)


def _align(base: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Changed rows in the base layout: base columns missing from the change keep the
    stored value (updates) or are null (inserts); extra change columns are dropped."""
    missing = [c for c in base.columns if c not in latest.columns]
    if not missing:
        return latest.select(*base.columns)
    stored = base.select(key, *missing)
    joined = latest.join(stored, key, "left")
    return joined.select(*base.columns)


def _replace(base: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    kept = base.join(latest.select(key), key, "left_anti")
    return kept.unionByName(_align(base, latest, key))


def upsert(base: DataFrame, changes: DataFrame, order_col: str, key: str = "customer_id") -> DataFrame:
    """Replace rows by key or append them; null keys get new ids first."""
    keyed = assign_new_ids(base.select(key).unionByName(changes.select(key)), changes, order_col, key)
    return _replace(base, latest_per_key(keyed, order_col, key), key)


def update_existing(base: DataFrame, changes: DataFrame, order_col: str, key: str = "customer_id"):
    """Apply changes only for keys already in ``base``.

    Returns (table, not_found) where ``not_found`` lists change keys with no base row."""
    known = changes.filter(F.col(key).isNotNull()).join(base.select(key), key, "left_semi")
    not_found = changes.join(base.select(key), key, "left_anti").select(key).distinct()
    return _replace(base, latest_per_key(known, order_col, key), key), not_found


def delete(base: DataFrame, ids: DataFrame, key: str = "customer_id"):
    """Drop the given keys.  Returns (table, report) where the report says for each
    requested key whether it was present."""
    wanted = ids.select(key).distinct()
    remaining = base.join(wanted, key, "left_anti")
    present = wanted.join(base.select(key), key, "left_semi").withColumn("deleted", F.lit(True))
    absent = wanted.join(base.select(key), key, "left_anti").withColumn("deleted", F.lit(False))
    return remaining, present.unionByName(absent)
