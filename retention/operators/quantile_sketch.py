"""Mergeable quantile sketches of a score (A9): one KLL sketch a day and group, kept by run.

A day's scores are read once and leave a sketch of a few kilobytes; quantiles of any span of days or
set of groups come from merging stored sketches, and no score is read again.  The rank error does not
grow by merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.run_log import append_run, read_runs

SIZE = 1024
RANK_ERROR = 0.006  # a KLL sketch of this size keeps to about 0.0044 of the rank in 99 of 100 cases


def sketches(df: DataFrame, column: str = "probability_churn", groups: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """One row a group: ``n`` values, ``least``, ``greatest`` and ``sketch``.  Nulls and NaN are left out;
    a group without a value has no row."""
    v = F.col(column).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*(groups or [])).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"),
        F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch")).filter("n > 0")


def merged(stored: DataFrame, groups: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """The sketches of ``stored`` rows put together by ``groups`` (none: one row)."""
    return stored.groupBy(*(groups or [])).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch")).filter("n > 0")


def quantile(share: float, sketch: str = "sketch") -> Column:
    """The value at ``share`` of the sketched values, within ``RANK_ERROR`` of its rank."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def store_day(df: DataFrame, path: str, day: str, column: str = "probability_churn", groups: list[str] | None = None) -> str:
    """Keep the sketches of a day's scores; a repeated day replaces its own."""
    return append_run(sketches(df, column, groups), path, day)


def read_days(spark: SparkSession, path: str, groups: str = "", first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored sketches, ``groups`` being the DDL of their group columns; only the days wanted are read."""
    own = f"{groups}, " if groups else ""
    days = read_runs(spark, path, f"{own}n long, least double, greatest double, sketch binary, run_id string")
    if first is not None:
        days = days.filter(F.col("run_id") >= first)
    return days.filter(F.col("run_id") <= last) if last is not None else days
