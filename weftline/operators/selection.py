"""Exact medians of any number of values by rounds of range counts, no value leaving its task.

A group's middle value lies between its least and its greatest one. Every round cuts that range into parts, counts the values
in each (combined before the shuffle, so a task sends at most one row a part), and goes on with the part that holds the
middle rank, between the least and the greatest value found there. A round divides the range by the number of parts, and at least one value goes, so it
ends; one or two rounds do for weights and prices. No buffer holds the values of a group, and a round reads one column of staged rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import BROADCAST_ROWS, counted, staged

#: Counts that a task sends at most in a round, and the least number of parts: with few groups ranges are cut finer and close in sooner.
COUNTS = 1_000_000
LEAST_CUTS = 64


def magnitude(x: Column) -> Column:
    """Grows with x over all doubles: the logarithm of its size, put above 0, with its sign."""
    return F.signum(x) * F.greatest(F.coalesce(F.ln(F.abs(x)), F.lit(-745.0)) + 745, F.lit(0.0))


def part(value: str, cuts: int) -> Column:
    """Which part of [lo, hi] holds the value; never falls while values grow, and lo and hi lie apart.

    Ends that are far apart in size are cut by magnitude, so a range of any width is down to values of one size after a round or two.
    """
    x, lo, hi = (F.col(c) for c in (value, "lo", "hi"))
    share = lambda x, lo, hi: F.nanvl((x - lo) / (hi - lo), F.lit(0.5))  # noqa: E731  not a number: infinite ends
    far = magnitude(hi) - magnitude(lo) > 1
    inner = F.when(far, share(*map(magnitude, (x, lo, hi)))).otherwise(share(x / 2, lo / 2, hi / 2))  # halves: a difference doesn't overflow
    return F.when(x >= hi, F.lit(cuts - 1)).when(x <= lo, F.lit(0)).otherwise(F.least(F.floor(inner * cuts), F.lit(cuts - 1))).cast("int")


def medians(rows: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """keys, n, median of the doubles in ``value`` (neither null nor NaN), each counted ``weight`` times. The median of an even count is the mean of the two middle ones.

    ``rows`` is read in every round: a staged frame, or one that is cheap to make from it. Keys aren't null. Staged.
    """
    weight = F.lit(1) if weight is None else weight
    rows = rows.select(*keys, F.col(value).alias("x"), weight.cast("bigint").alias("w"))
    state = staged(rows.groupBy(*keys).agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("below", F.lit(0).cast("bigint")), "middle-ranges")
    groups = state.limit(BROADCAST_ROWS + 1).count()
    side = F.broadcast if groups <= BROADCAST_ROWS else (lambda df: df)
    cuts = max(LEAST_CUTS, min(COUNTS // max(groups, 1), 1 << 16))
    found = []
    while True:
        found.append(state.where("lo = hi").select(*keys, "n", F.col("lo").alias("low")))
        wide = state.where("lo < hi")
        if wide.isEmpty():
            break
        within = rows.join(side(wide), keys).where(F.col("x").between(F.col("lo"), F.col("hi")))
        parts = within.groupBy(*keys, "n", "below", part("x", cuts).alias("part")).agg(F.sum("w").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        # At most as many rows a group as parts: their running counts tell which part holds the rank (n - 1) // 2.
        before = F.col("below") + F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rank = F.floor((F.col("n") - 1) / 2)
        state = staged(parts.withColumn("before", before).where((F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))).select(*keys, "n", "lo", "hi", F.col("before").alias("below")), "middle-ranges")
    lower = side(reduce(DataFrame.unionByName, found))
    # The upper middle is the lower one again, or the next value.
    up_to, after = F.sum(F.when(F.col("x") <= F.col("low"), F.col("w")).otherwise(0)), F.min(F.when(F.col("x") > F.col("low"), F.col("x")))
    upper = F.when((F.col("n") % 2 == 1) | (up_to > F.col("n") / 2), F.col("low")).otherwise(after)
    both = rows.join(lower, keys).groupBy(*keys, "n", "low").agg(upper.alias("high"))
    return staged(both.select(*keys, "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0.5 * F.col("low") + 0.5 * F.col("high")).alias("median")), "medians")


def spread(rows: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """keys, n, median and mad, the median distance from it."""
    weight = F.lit(1) if weight is None else weight
    middle = medians(rows, keys, value, weight)
    apart = rows.join(counted(middle), keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("apart"), weight.alias("times"))
    mads = medians(apart, keys, "apart", F.col("times")).select(*keys, F.col("median").alias("mad"))
    return middle.join(counted(mads), keys)
