"""Distributed running totals in a global order.

A running sum over a whole table (``Window.orderBy`` without ``partitionBy``) moves every
row into one task.  Here the order is cut into ranges whose bounds are computed once, as
values: the quantiles of a hash sample of the order key.  A row's range is a plain Column
expression over those literals, so every branch of a plan assigns it alike, whatever
columns or exchanges the branch has.  Each range computes its local running sum, and a
table of totals per range and group gives each range its starting offset.

The caller guarantees that ``(groups..., order)`` is unique - normally by aggregating to
distinct values first, which also removes any skew from repeated values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_RANGE = 32  # order keys sampled for each range
MAX_RANGES = 512  # keeps the range expression small


def range_bounds(df: DataFrame, order: str, ranges: int) -> list:
    """At most ``ranges - 1`` ascending cut values of ``order``: the keys with the smallest hash are a
    uniform sample of the distinct keys, of fixed size and the same on every run."""
    keys = df.select(order).filter(F.col(order).isNotNull())
    sample = keys.orderBy(F.xxhash64(order), order).limit(SAMPLE_PER_RANGE * ranges)
    values = sorted({r[0] for r in sample.collect()}, key=lambda v: (v != v, v))
    step = max(1, -(-len(values) // ranges))
    return [v for v in values[step::step] if v == v]


def range_of(value: Column, bounds: list, first: int = 0) -> Column:
    """Index of the range that holds ``value``, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), range_of(value, bounds[:mid], first)).otherwise(
        range_of(value, bounds[mid + 1:], first + mid + 1))


def running_totals(
    df: DataFrame,
    order: str,
    values: list[str],
    groups: list[str] | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``cum_<v>`` (inclusive running sum in ``order`` within ``groups``) and
    ``total_<v>`` (group total) for every ``v`` in ``values``."""
    groups = list(groups or [])
    spark = df.sparkSession
    n = min(num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    bounds = range_bounds(df, order, n)
    place = F.when(F.col(order).isNull(), F.lit(0)).otherwise(range_of(F.col(order), bounds))  # nulls sort first
    ranged = df.withColumn("_pid", place)

    part_totals = ranged.groupBy(*groups, "_pid").agg(*[F.sum(v).alias(f"_pt_{v}") for v in values])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = part_totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_pid").alias("_range"),
        *[F.coalesce(F.sum(f"_pt_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in values],
        *[F.sum(f"_pt_{v}").over(whole).alias(f"total_{v}") for v in values],
    )

    local = Window.partitionBy("_pid", *groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    with_local = ranged.select("*", *[F.sum(v).over(local).alias(f"_loc_{v}") for v in values])
    same = F.col("_pid") == F.col("_range")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = with_local.join(offsets, same, "inner")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_loc_{v}") + F.col(f"_off_{v}")).alias(f"cum_{v}") for v in values],
        *[F.col(f"total_{v}") for v in values],
    )


def exact_median(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Exact (interpolated) median per group without gathering a group in one task."""
    groups = list(groups or [])
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_totals(counts, value, ["_n"], groups)
    lo = F.floor((F.col("total__n") - 1) / 2)
    hi = F.ceil((F.col("total__n") - 1) / 2)
    return cum.groupBy(*groups).agg(
        ((F.min(F.when(F.col("cum__n") > lo, F.col(value))) + F.min(F.when(F.col("cum__n") > hi, F.col(value))))
         / F.lit(2.0)).alias("median")
    )


def sequence_numbers(df: DataFrame, order: str, name: str = "seq") -> DataFrame:
    """Consecutive 1..n numbers in ``order`` (unique), computed without a global window."""
    ones = df.withColumn("_one", F.lit(1))
    out = running_totals(ones, order, ["_one"])
    return out.withColumnRenamed("cum__one", name).drop("_one", "total__one")
