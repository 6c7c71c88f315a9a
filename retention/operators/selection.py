"""Exact selection by rank without ordering rows.

A histogram of coarse, order-keeping buckets shows which bucket holds the wanted rank; the next pass
looks only into that bucket, with finer ones, until it comes down to single values.  Each pass is one
scan with a partial aggregate: no row is shuffled, and a table of at most ``BUCKETS`` rows for each
wanted bucket is all that is ordered.  The driver gets the chosen buckets, which stand as literals in
the next pass, so its filter reaches the scan.  The passes run while the plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65536
MAX_GROUPS = 1000  # groups of a split are classes of a label: their cuts stand in the plan
_STEPS = 40.0  # buckets for each factor of e in the first pass: |log| < 745, so about 59,000 in all
_ZERO, _ENDLESS, _NOT_A_NUMBER = 30000.0, 28500.0, 60000.0


def _either(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


# -- the first rows of each group in the order of a text key -----------------------------------


@dataclass(frozen=True)
class Cut:
    """The wanted rows of a group: those with a key up to ``last``, or, where there is none, those below ``prefix``."""

    group: object
    rank: int
    below: int
    prefix: str
    last: str | None = None

    def holds(self, group: str, key: Column) -> Column:
        wanted = key < F.lit(self.prefix) if self.last is None else key <= F.lit(self.last)
        return F.col(group).eqNullSafe(F.lit(self.group)) & wanted


def share_cuts(df: DataFrame, key: Column, group: str, share: float, widths: tuple[int, ...] = (4, 8)) -> list[Cut]:
    """For each group, where its first round(share * n) rows in the order of ``key`` end.

    ``key`` is text that begins with evenly spread digits (a hash); each of ``widths`` is how many of them a
    pass compares.  Rows of one key stay together: if they straddle the cut, they are beyond it.  Groups
    whose share rounds to no row have no cut."""
    keyed = df.select(F.col(group).alias("g"), key.alias("key"))
    by_group = Window.partitionBy("g")
    cuts: list[Cut] = []
    for at, width in enumerate(widths):
        keyed_now = keyed.withColumn("prefix", F.substring("key", 1, width))
        if at:
            inside = [F.col("g").eqNullSafe(F.lit(c.group)) & (F.substring("key", 1, widths[at - 1]) == F.lit(c.prefix)) for c in cuts]
            keyed_now = keyed_now.filter(_either(inside))
        counts = keyed_now.groupBy("g", "prefix").agg(F.count(F.lit(1)).alias("n"))
        summed = counts.select("*", F.sum("n").over(by_group.orderBy("prefix")).alias("upto"), F.sum("n").over(by_group).alias("all"))
        if at:
            known = F.coalesce(*[F.when(F.col("g").eqNullSafe(F.lit(c.group)), F.struct(
                F.lit(c.rank).cast("long").alias("rank"), F.lit(c.below).cast("long").alias("below"))) for c in cuts])
            rank, below = known["rank"], known["below"]
        else:
            rank, below = F.round(F.col("all") * F.lit(share)).cast("long"), F.lit(0).cast("long")
        found = summed.select("g", "prefix", rank.alias("rank"), (below + F.col("upto") - F.col("n")).alias("before"), (below + F.col("upto")).alias("after"))
        rows = found.filter("before < rank and rank <= after").limit(MAX_GROUPS + 1).collect()
        if len(rows) > MAX_GROUPS:
            raise ValueError(f"a split has at most {MAX_GROUPS} classes; {group} has more")
        cuts = [Cut(r["g"], r["rank"], r["before"], r["prefix"]) for r in rows]
        if not cuts:
            return []
    # the few keys that share all compared digits with the cut
    inside = [F.col("g").eqNullSafe(F.lit(c.group)) & (F.substring("key", 1, widths[-1]) == F.lit(c.prefix)) for c in cuts]
    room = F.coalesce(*[F.when(F.col("g").eqNullSafe(F.lit(c.group)), F.lit(c.rank - c.below).cast("long")) for c in cuts])
    keys = keyed.filter(_either(inside)).groupBy("g", "key").agg(F.count(F.lit(1)).alias("n"))
    upto = keys.select("g", "key", F.sum("n").over(by_group.orderBy("key")).alias("upto")).filter(F.col("upto") <= room)
    last = {r["g"]: r["last"] for r in upto.groupBy("g").agg(F.max("key").alias("last")).collect()}
    return [Cut(c.group, c.rank, c.below, c.prefix, last.get(c.group)) for c in cuts]


def in_share(df: DataFrame, key: Column, group: str, share: float) -> Column:
    """Whether a row is among the first round(share * n) of its group: an expression over literals."""
    cuts = share_cuts(df, key, group, share)
    return F.coalesce(_either([c.holds(group, key) for c in cuts]), F.lit(False)) if cuts else F.lit(False)


# -- quantiles of a number -----------------------------------------------------------------------


def _scale(v: Column) -> Column:
    """An order-keeping bucket of any double: by sign, then logarithm; zero, infinities and NaN apart."""
    size = F.least(F.floor(F.log(F.abs(v)) * _STEPS).cast("double"), F.lit(_ENDLESS)) + F.lit(_ZERO)
    return F.when(F.isnan(v), F.lit(_NOT_A_NUMBER)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0.0))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The interpolated quantiles of a number column: nulls left out, NaN last; None where no value is.

    Passes: sign and logarithm, two linear cuts of the bucket, then the values themselves, of which
    a range that narrow holds about 50,000 at most.  Passes end as soon as every bucket is one value."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    ranges: list[tuple[float, float, int]] = []  # low, high, values below
    ranks: list[int] = []
    total = 0
    for step in range(4):
        if step:
            wide = [r for r in ranges if r[0] < r[1]]
            if not wide:
                break
            part = F.coalesce(*[F.when(F.col("v").between(lo, hi), F.lit(i)) for i, (lo, hi, _) in enumerate(wide)])
            at = F.coalesce(*[F.when(F.col("v").between(lo, hi), F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * BUCKETS)) for lo, hi, _ in wide])
            bucket = F.col("v") if step == 3 else at.cast("double")
            rows = values.filter(_either([F.col("v").between(lo, hi) for lo, hi, _ in wide]))
        else:
            wide, part, bucket, rows = [(0.0, 0.0, 0)], F.lit(0), _scale(F.col("v")), values
        counts = rows.groupBy(part.alias("part"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        same = Window.partitionBy("part")
        below = F.coalesce(*[F.when(F.col("part") == i, F.lit(r[2]).cast("long")) for i, r in enumerate(wide)])
        summed = counts.select("lo", "hi", "n", (below + F.sum("n").over(same.orderBy("bucket"))).alias("upto"), F.sum("n").over(same).alias("all"))
        if step:
            wanted = [F.lit(r).cast("long") for r in ranks]
        else:
            place = [(F.col("all") - 1) * F.lit(s) for s in shares]
            wanted = [c for p in place for c in (F.floor(p), F.ceil(p))]
        hits = summed.filter(_either([(F.col("upto") - F.col("n") <= r) & (r < F.col("upto")) for r in wanted])).collect()
        if not step:
            if not hits:
                return [None] * len(shares)
            total = hits[0]["all"]
            ranks = sorted({f(s) for s in shares for f in (lambda s: int((total - 1) * s), lambda s: -int(-((total - 1) * s) // 1))})
        ranges = [r for r in ranges if not r[0] < r[1]] + [(h["lo"], h["hi"], h["upto"] - h["n"]) for h in hits]
    ordered = sorted(ranges, key=lambda r: r[2])

    def at_rank(rank: int) -> float:
        return [r[0] for r in ordered if r[2] <= rank][-1]

    out = []
    for s in shares:
        place = (total - 1) * s
        low, high, part = at_rank(int(place)), at_rank(-int(-place // 1)), place - int(place)
        out.append(low if part == 0 or low == high else low * (1 - part) + high * part)
    return out
