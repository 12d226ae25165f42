"""Window events: differences of snapshots, pairing of openings and closings, durations and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import entry_type, normalize_title
from tallyloom.operators.ordered import ROWS_PER_RANGE, with_ranges


def snapshot_changes(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that were added and rows that are gone, as multisets: a changed title is both."""
    return now.exceptAll(before), before.exceptAll(now)


def pair_intervals(opens: DataFrame, closes: DataFrame, key: list[str], pos: str = "pos", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each open takes the first close of its key, not yet taken, whose place is not before its own; others are left out.

    Opens take closes in order, so the k-th open of a key takes the close of rank k + max over m <= k of (L_m - m),
    where L_m is 1 plus the closes before the m-th open: a running maximum, and no loop. Sums and maxima compose, so a key's
    rows are handled in ranges of places: each range by itself, then one row a key and range. A key with most of all rows
    is in as many tasks as it has ranges. Columns of opens get the prefix open_, those of closes close_."""
    both = opens.select(*key, F.col(pos).alias("_pos"), F.lit(1).alias("_kind"), F.struct(*opens.columns).alias("_row")).withColumn("_other", F.lit(None).cast(closes.select(F.struct(*closes.columns).alias("s")).schema["s"].dataType))
    other = closes.select(*key, F.col(pos).alias("_pos"), F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.struct(*closes.columns).alias("_other"))
    # At the same place an open may take the close, so closes at its own place don't count as before it.
    every = both.unionByName(other).withColumn("_kind", F.when(F.col("_kind") == 1, 0).otherwise(1))
    rows = opens.count() + closes.count()
    ranged = with_ranges(every, F.col("_pos"), "_range", rows, rows_per_range)
    run = Window.partitionBy(*key, "_range").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_k", F.sum(1 - F.col("_kind")).over(run)).withColumn("_c", F.sum("_kind").over(run)).withColumn("_m", F.when(F.col("_kind") == 0, F.col("_c") + 1 - F.col("_k")))
    local = local.withColumn("_top", F.max("_m").over(run))
    if rows > rows_per_range:
        sums = local.groupBy(*key, "_range").agg(F.sum(1 - F.col("_kind")).alias("_k1"), F.sum("_kind").alias("_c1"), F.max("_m").alias("_m1"))
        before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_k0", F.coalesce(F.sum("_k1").over(before), F.lit(0))).withColumn("_c0", F.coalesce(F.sum("_c1").over(before), F.lit(0)))
        sums = sums.withColumn("_m0", F.max(F.col("_m1") + F.col("_c0") - F.col("_k0")).over(before))
        names = {c: f"_on{i}" for i, c in enumerate([*key, "_range"])}
        sums = sums.select(*[F.col(c).alias(n) for c, n in names.items()], "_k0", "_c0", "_m0")
        same = F.lit(True)
        for c, n in names.items():
            same = same & F.col(c).eqNullSafe(F.col(n))
        local = local.join(sums, same).withColumn("_top", F.greatest(F.col("_top") + F.col("_c0") - F.col("_k0"), F.col("_m0")))
        local = local.withColumn("_k", F.col("_k") + F.col("_k0")).withColumn("_c", F.col("_c") + F.col("_c0"))
    ranked = local.withColumn("_rank", F.when(F.col("_kind") == 1, F.col("_c")).otherwise(F.col("_k") + F.col("_top")))
    met = ranked.groupBy(*key, "_rank").agg(F.max("_row").alias("o"), F.max("_other").alias("c")).filter("o is not null and c is not null")
    return met.select(*key, *[F.col(f"o.{c}").alias(f"open_{c}") for c in opens.columns if c not in key], *[F.col(f"c.{c}").alias(f"close_{c}") for c in closes.columns if c not in key])


def minutes(open_time: Column, close_time: Column, midnight: str = "raw") -> Column:
    """Minutes between two times of day. A negative span stays (raw), is dropped (null), or crosses midnight (wrap)."""
    d = F.unix_timestamp(close_time, "HH:mm:ss") - F.unix_timestamp(open_time, "HH:mm:ss")
    if midnight == "wrap":
        d = F.when(d < 0, d + 86400).otherwise(d)
    elif midnight == "drop":
        d = F.when(d > 0, d)
    return d / 60


def totals(intervals: DataFrame, midnight: str = "raw", order: list[str] = ["pos"]) -> DataFrame:  # noqa: B006
    """Minutes by title, with date, open and close of its last interval; largest first, ties by first appearance."""
    rows = intervals.withColumn("title", normalize_title(F.col("title"))).withColumn("_m", minutes(F.col("open"), F.col("close"), midnight)).filter(F.col("_m").isNotNull())
    at = F.struct(*order)
    out = rows.groupBy("title").agg(F.sum("_m").alias("minutes"), F.max_by(F.struct("date", "open", "close"), at).alias("last"), F.min(at).alias("_first"))
    return out.orderBy(F.desc("minutes"), "_first").select("last.date", "last.open", "last.close", "minutes", entry_type(F.col("title")).alias("type"), "title")


def command_activity(history: DataFrame, day: str) -> DataFrame:
    """A day's commands with a nominal interval of two seconds, in order of time."""
    ts = F.timestamp_seconds("epoch")
    rows = history.filter(F.to_date(ts) == F.lit(day).cast("date")).orderBy("epoch", "pos")
    return rows.select("epoch", F.to_date(ts).alias("date"), F.date_format(ts, "HH:mm:ss").alias("open"), F.date_format(ts + F.expr("interval 2 seconds"), "HH:mm:ss").alias("close"), F.round(F.lit(2 / 60), 3).alias("minutes"), F.lit("Command").alias("type"), F.col("command").alias("name"))


def unify(windows: DataFrame, commands: DataFrame) -> DataFrame:
    """One table of activity: window totals and commands."""
    cols = ["date", "open", "close", "minutes", "type", "name"]
    return windows.withColumnRenamed("title", "name").select(*cols).unionByName(commands.select(*cols))
