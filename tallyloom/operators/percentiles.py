"""Exact percentiles of any number of distinct values, by histograms that are refined round by round.

A round counts the rows of each bin of the stretches that hold a wanted rank, with the bin's least and largest value, in one
pass and one small grouping; the bin that holds the rank is the next stretch. It ends when a stretch has one value. Stretches
with both signs are parted by sign and wide ones by logarithm, so a few rounds do for any doubles. No task and no row holds the values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a stretch in a round; the driver gets at most this number for each wanted rank.
BINS = 4096


def _bin(v: Column, low: float, high: float) -> Column:
    """The bin of a value of low .. high; larger values never lie in smaller bins."""
    if low < 0 < high or (low == 0) != (high == 0):
        return F.signum(v).cast("int")
    if min(abs(low), abs(high)) > 0 and max(high / low, low / high) > 1 << 20:
        a, b = math.log(abs(low)), math.log(abs(high))
        at = (F.log(F.abs(v)) - a) / (b - a)
    else:
        # halves where the difference is no double
        at = (v - low) / (high - low) if high - low < math.inf else (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.greatest(F.floor(at * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def order_statistics(df: DataFrame, value: Column, ranks: list[int]) -> dict[int, float]:
    """The values at the given places (from 0) of the ascending order; nulls and NaN have none."""
    rows = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = rows.agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    if any(not 0 <= r < ends["n"] for r in ranks):
        raise ValueError(f"ranks go from 0 to {ends['n'] - 1}")
    found: dict[int, float] = {}
    # a stretch of values, the rows below it, the ranks in it
    todo = [(ends["a"], ends["b"], 0, sorted(set(ranks)))]
    while todo:
        for low, _, _, inside in (t for t in todo if t[0] == t[1]):
            found.update((r, low) for r in inside)
        todo = [t for t in todo if t[0] < t[1]]
        if not todo:
            break
        v, which, bins = F.col("v"), F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (low, high, _, _) in enumerate(todo):
            here = v.between(low, high)
            which, bins = F.when(here, k).otherwise(which), F.when(here, _bin(v, low, high)).otherwise(bins)
        counts = rows.select("v", which.alias("which"), bins.alias("bin")).filter("which is not null").groupBy("which", "bin").agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        then = []
        below = [t[2] for t in todo]
        for r in counts.orderBy("which", "bin").collect():
            at = below[r["which"]]
            below[r["which"]] = at + r["n"]
            if inside := [x for x in todo[r["which"]][3] if at <= x < at + r["n"]]:
                then.append((r["a"], r["b"], at, inside))
        todo = then
    return found


def exact_percentiles(df: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """share and value: between two neighbours of the order in proportion, as `percentile` does. Null values if there are no rows."""
    n = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)").count()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([(s, None) for s in shares], "share double, value double")
    at = {s: s * (n - 1) for s in shares}
    found = order_statistics(df, value, sorted({r for x in at.values() for r in (math.floor(x), math.ceil(x))}))
    of = lambda x: found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x))
    return spark.createDataFrame([(float(s), float(of(at[s]))) for s in shares], "share double, value double")
