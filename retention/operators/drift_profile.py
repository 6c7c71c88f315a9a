"""Stored drift profiles (S7, M1-M5): what a drift run needs of a table, without its rows.

A profile holds how often every value of the watched columns occurs, and the mean, sample standard
deviation and number of the values of each column.  It is made in one pass over the rows; equal
values meet in the partial aggregate, so a hot value costs one row a task, and the counts stay a
distributed table, however many values there are.  Counts add up: profiles of days or regions merge
into the profile of all their rows.  A drift run then reads two profiles and no row of either table.

Stored under one path as ``values`` and ``columns``.  ``columns`` is written last and marks the
profile as whole; a repeated write replaces what an interrupted one left.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources.readers import _exists
from . import monitoring

NUMBER, CATEGORY, LABEL = "number", "category", "label"
_VALUES = "column string, num double, text string, n bigint, kind string"
_COLUMNS = "kind string, column string, n bigint, mean double, std double"


@dataclass(frozen=True)
class Profile:
    """``values``: kind, column, num or text, n.  ``columns``: kind, column, n, mean, std."""

    values: DataFrame
    columns: DataFrame


def _entry(kind: str, column: str) -> Column:
    number = F.col(column).cast("double") if kind == NUMBER else F.lit(None).cast("double")
    text = F.lit(None).cast("string") if kind == NUMBER else F.col(column).cast("string")
    return F.struct(F.lit(kind).alias("kind"), F.lit(column).alias("column"), number.alias("num"), text.alias("text"))


def _value_counts(df: DataFrame, watched: list[tuple[str, str]]) -> DataFrame:
    """One pass: each watched column's values and how often they occur (nulls left out, NaN kept)."""
    return (
        df.select(F.inline(F.array(*[_entry(kind, c) for kind, c in watched])))
        .filter(F.col("num").isNotNull() | F.col("text").isNotNull())
        .groupBy("kind", "column", "num", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _column_stats(values: DataFrame, watched: DataFrame) -> DataFrame:
    """Moments of each watched column from its value counts; a row also for a column without values.

    Deviations are taken from the mean, so large values with a small spread lose no digits."""
    means = values.groupBy("kind", "column").agg(
        F.sum("n").alias("n"), (F.sum(F.col("num") * F.col("n")) / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("mean"))
    off = F.col("num") - F.col("mean")
    spread = (
        values.withColumnRenamed("n", "times").join(means, ["kind", "column"])
        .groupBy("kind", "column").agg(F.sum(F.col("times") * off * off).alias("_squares"))
    )
    return watched.join(means, ["kind", "column"], "left").join(spread, ["kind", "column"], "left").select(
        "kind", "column", F.coalesce("n", F.lit(0)).alias("n"), "mean",
        F.sqrt(F.col("_squares") / F.nullif(F.col("n") - 1, F.lit(0))).alias("std"))


def _store(spark: SparkSession, values: DataFrame, watched: DataFrame, path: str) -> Profile:
    values.write.partitionBy("kind").mode("overwrite").parquet(f"{path}/values")
    stats = _column_stats(spark.read.schema(_VALUES).parquet(f"{path}/values"), watched)
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")  # a row for each watched column
    return load_profile(spark, path)


def write_profile(df: DataFrame, path: str, numeric: list[str] | None = None, categorical: list[str] | None = None,
                  label: str | None = "churn") -> Profile:
    """The profile of ``df``'s watched columns (those it has), stored under ``path``."""
    wanted = [(NUMBER, c) for c in numeric or monitoring.NUMERIC_DRIFT_COLUMNS]
    wanted += [(CATEGORY, c) for c in categorical or monitoring.CATEGORICAL_DRIFT_COLUMNS] + ([(LABEL, label)] if label else [])
    watched = [(kind, c) for kind, c in wanted if c in df.columns]
    if not watched:
        raise ValueError("the table has none of the watched columns")
    spark = df.sparkSession
    return _store(spark, _value_counts(df, watched), spark.createDataFrame(watched, "kind string, column string"), path)


def load_profile(spark: SparkSession, path: str) -> Profile:
    return Profile(spark.read.schema(_VALUES).parquet(f"{path}/values"),
                   spark.read.schema(_COLUMNS).parquet(f"{path}/columns"))


def create_or_load_profile(spark: SparkSession, current: DataFrame, path: str, **watched) -> tuple[Profile, bool]:
    """S7 by profile: the stored reference profile, or ``current``'s stored as the reference.

    Returns (profile, created)."""
    if _exists(spark, f"{path}/columns/_SUCCESS"):
        return load_profile(spark, path), False
    return write_profile(current, path, **watched), True


def merge_profiles(profiles: list[Profile], path: str) -> Profile:
    """The profile of all rows behind ``profiles``, without reading them again.

    A column counts as watched only where every profile watches it."""
    spark = profiles[0].values.sparkSession
    watched = reduce(lambda a, b: a.join(b, ["kind", "column"], "left_semi"), [p.columns.select("kind", "column") for p in profiles])
    values = (
        reduce(DataFrame.unionByName, [p.values for p in profiles])
        .join(watched, ["kind", "column"], "left_semi")
        .groupBy("kind", "column", "num", "text").agg(F.sum("n").alias("n"))
    )
    return _store(spark, values, watched, path)


def _both(cur: Profile, ref: Profile, kind: str, value: str) -> DataFrame:
    """(column, value, n_cur, n_ref) of the columns of a kind that both profiles watch."""
    shared = cur.columns.join(ref.columns, ["kind", "column"], "left_semi").select("kind", "column")
    sides = [p.values.filter(F.col("kind") == kind).select(
        "kind", "column", F.col(value).alias("value"),
        *[(F.col("n") if s == side else F.lit(0).cast("bigint")).alias(s) for s in ("n_cur", "n_ref")])
        for p, side in ((cur, "n_cur"), (ref, "n_ref"))]
    return (
        sides[0].unionByName(sides[1]).join(shared, ["kind", "column"], "left_semi")
        .groupBy("column", "value").agg(F.sum("n_cur").alias("n_cur"), F.sum("n_ref").alias("n_ref"))
    )


def numeric_drift(cur: Profile, ref: Profile, t: Thresholds = DEFAULT, columns: list[str] | None = None) -> DataFrame:
    """M1 and M2 from two profiles; equal to ``monitoring.numeric_drift`` over their rows."""
    cols = columns or monitoring.NUMERIC_DRIFT_COLUMNS
    ks = monitoring.ks_of_counts(_both(cur, ref, NUMBER, "num").filter(F.col("column").isin(cols) & ~F.isnan("value")), cols)
    side = lambda p, name: p.columns.filter(F.col("kind") == NUMBER).select(
        "column", F.col("mean").alias(f"{name}_mean"), F.col("std").alias(f"{name}_std"))
    return monitoring.numeric_report(side(cur, "current").join(side(ref, "reference"), "column").join(ks, "column"), t)


def categorical_drift(cur: Profile, ref: Profile, t: Thresholds = DEFAULT, report_all: bool = False) -> DataFrame:
    """M3 from two profiles."""
    return monitoring.category_report(_both(cur, ref, CATEGORY, "text"), t, report_all)


def label_drift(cur: Profile, ref: Profile, t: Thresholds = DEFAULT) -> DataFrame:
    """M4 from two profiles."""
    positive = F.col("value") == "true"
    share = lambda n: F.sum(F.when(positive, F.col(n))) / F.nullif(F.sum(n), F.lit(0))
    return monitoring.label_report(_both(cur, ref, LABEL, "text").agg(
        share("n_cur").alias("current_churn_rate"), share("n_ref").alias("reference_churn_rate"),
        F.sum(F.when(positive, F.col("n_cur"))).alias("_cp"), F.sum(F.when(positive, F.col("n_ref"))).alias("_rp")), t)


def drift_summary(cur: Profile, ref: Profile, t: Thresholds = DEFAULT) -> DataFrame:
    """M5 from two profiles."""
    return monitoring.drift_summary(numeric_drift(cur, ref, t), label_drift(cur, ref, t), categorical_drift(cur, ref, t), t)
