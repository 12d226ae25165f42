"""Work along an order of a whole table without putting it, or one key's rows, into one task.

A table is cut into ranges by boundary values that are sampled once and written, so a row's range follows from the row
alone, however often and with whatever partitions it is computed. Everything along the order is then done in two levels:
each range by itself, and one row a range for what is carried from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.sinks import written

#: Rows of a range, about.
ROWS_PER_RANGE = 1_000_000
#: Bytes of a range, about: of rows with long texts fewer make one.
BYTES_PER_RANGE = 32 << 20
#: Keys that are sampled for each range; their sorted list is the only thing that one task holds.
SAMPLED_PER_RANGE = 60
#: Lines of a source that make a block.
LINES_PER_BLOCK = 65_536


def _hashed(df: DataFrame) -> Column:
    """A hash of a whole row; maps count by their sorted entries."""
    return F.xxhash64(F.lit(0), *[F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema])


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    fixed = (T.NumericType, T.BooleanType, T.DatetimeType)
    wide = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, fixed)]
    return sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))


def ranges_of(rows: int, rows_per_range: int, bytes_: int = 0) -> int:
    """The number of ranges of so many rows and bytes."""
    return max(1, -(-rows // rows_per_range), min(rows, -(-bytes_ // BYTES_PER_RANGE)))


def with_ranges(df: DataFrame, key: Column, name: str, rows: int | None = None, rows_per_range: int = ROWS_PER_RANGE, bytes_: int = 0) -> DataFrame:
    """df with `name`, the number of its range by key, ascending. Ranges hold about rows_per_range rows, and BYTES_PER_RANGE of the
    bytes_ that all rows have; rows of one key are in one range."""
    rows = df.count() if rows is None else rows
    parts = ranges_of(rows, rows_per_range, bytes_)
    if parts <= 1:
        return df.withColumn(name, F.lit(0))
    picked = df.select(key.alias("k")).sample(min(1.0, SAMPLED_PER_RANGE * parts / rows), seed=1).agg(F.sort_array(F.collect_list(F.struct("k"))).alias("s"))
    bounds = picked.select(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / parts).cast("int")))).alias("bounds"))
    # a value of the plan: a join would copy all boundaries into each row. The search is a few plain steps, which are compiled
    bounds = written(bounds, "ranges").scalar()
    out = df.withColumn("\x00key", F.struct(key.alias("k"))).withColumn(name, F.lit(0))
    for step in (1 << s for s in reversed(range(parts.bit_length()))):
        below = F.get(bounds, F.col(name) + (step - 1)) < F.col("\x00key")
        out = out.withColumn(name, F.col(name) + F.when(below, step).otherwise(0))
    return out.drop("\x00key")


def renumber(df: DataFrame, order: list[Column], start: int = 0, name: str = "n", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with gapless numbers in ascending order (nulls first). Rows that the order does not tell apart are ordered by a hash of
    the whole row, so numbers are the same for any partitioning; equal rows are interchangeable. A column `name` of df is replaced."""
    cols = [F.col(f"`{c}`") for c in df.columns if c != name]
    by = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], _hashed(df).alias("_h"))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_bytes(df).cast("bigint")), F.lit(0)).alias("b")).first()
    ranged = with_ranges(df, by, "\x00range", size["n"], rows_per_range, size["b"])
    counts = ranged.groupBy("\x00range").agg(F.count(F.lit(1)).alias("\x00rows"))
    # one row a range
    before = counts.select("\x00range", F.coalesce(F.sum("\x00rows").over(Window.orderBy("\x00range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("\x00before"))
    # a task for each range; what rows are ordered by is made again there, not sent along
    dealt = ranged.repartitionById(ranges_of(size["n"], rows_per_range, size["b"]), F.col("\x00range"))
    within = F.row_number().over(Window.partitionBy("\x00range").orderBy("\x00by")) - 1
    numbered = dealt.withColumn("\x00by", by).withColumn("\x00place", within).join(F.broadcast(before), "\x00range")
    return numbered.select(*cols, (F.col("\x00place") + F.col("\x00before") + start).cast("bigint").alias(name))


def block_of(pos: str) -> Column:
    return F.floor(F.col(pos) / LINES_PER_BLOCK)


def _blocked(rows: DataFrame, pos: str, block: str | None) -> tuple[DataFrame, str, list[str]]:
    """rows with a block of lines, the column's name, and what to drop of it at the end."""
    return (rows, block, []) if block else (rows.withColumn("\x00block", block_of(pos)), "\x00block", ["\x00block"])


def _before(by: list[str], at: str) -> Window:
    return Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)


def _joined(rows: DataFrame, summary: DataFrame, by: list[str], at: str, value: Column) -> DataFrame:
    """Rows with what comes in to their block: value over the blocks of its source before it, or after it. Null keys are keys. There is one
    row a block of LINES_PER_BLOCK lines, which is broadcast, so rows stay where and in the order they are."""
    s = summary.select(*[F.col(c).alias(f"\x00s{i}") for i, c in enumerate(by)], F.col(at).alias("\x00sb"), value.alias("\x00in"))
    same = F.col(at) == F.col("\x00sb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"\x00s{i}"))
    return rows.join(F.broadcast(s), same, "left").drop("\x00sb", *[f"\x00s{i}" for i in range(len(by))])


def counted(rows: DataFrame, by: list[str], pos: str, mark: Column, name: str, block: str | None = None) -> DataFrame:
    """rows with the number of marked rows of their source up to themselves. block: a column of rows that has block_of(pos); it stays, and
    rows that are handled by it several times are moved and sorted once."""
    b, at, extra = _blocked(rows, pos, block)
    b = b.withColumn("\x00m", F.coalesce(mark, F.lit(False)).cast("bigint"))
    sums = b.groupBy(*by, at).agg(F.sum("\x00m").alias("\x00n"))
    own = F.sum("\x00m").over(Window.partitionBy(*by, at).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    met = _joined(b.withColumn(name, own), sums, by, at, F.sum("\x00n").over(_before(by, at)))
    return met.withColumn(name, F.col(name) + F.coalesce("\x00in", F.lit(0))).drop("\x00m", "\x00in", *extra)


def carried(rows: DataFrame, by: list[str], pos: str, value: Column, name: str, block: str | None = None) -> DataFrame:
    """rows with the last value of their source, up to themselves, that is not null. block: as for counted()."""
    b, at, extra = _blocked(rows, pos, block)
    b = b.withColumn("\x00v", value)
    last = b.filter("`\x00v` is not null").groupBy(*by, at).agg(F.max_by("\x00v", pos).alias("\x00l"))
    every = b.select(*by, at).distinct().withColumn("\x00l", F.lit(None).cast(last.schema["\x00l"].dataType))
    ends = every.unionByName(last).groupBy(*by, at).agg(F.first("\x00l", ignorenulls=True).alias("\x00l"))
    own = F.last("\x00v", ignorenulls=True).over(Window.partitionBy(*by, at).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    met = _joined(b.withColumn(name, own), ends, by, at, F.last("\x00l", ignorenulls=True).over(_before(by, at)))
    return met.withColumn(name, F.coalesce(name, "\x00in")).drop("\x00v", "\x00in", *extra)


def followed(rows: DataFrame, by: list[str], pos: str, value: str, name: str, block: str | None = None) -> DataFrame:
    """rows with the value of the next row of their source; null for the last one. block: as for counted()."""
    b, at, extra = _blocked(rows, pos, block)
    heads = b.groupBy(*by, at).agg(F.min_by(F.struct(value), pos).alias("\x00h"))
    own = F.lead(F.struct(value)).over(Window.partitionBy(*by, at).orderBy(pos))
    met = _joined(b.withColumn(name, own), heads, by, at, F.lead("\x00h").over(Window.partitionBy(*by).orderBy(at)))
    return met.withColumn(name, F.coalesce(name, "\x00in")[value]).drop("\x00in", *extra)
