"""Keyed joins, deduplication, splits and token statistics over tables of files and texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import split_extension, split_triple
from tallyloom.operators.ordered import renumber
from tallyloom.sources.sinks import written


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[F.col(f"r.{c}") for c in rest])


def backfill(df: DataFrame, names: DataFrame, key: str, name: str, order: list[str], default: str = "unknown") -> DataFrame:
    """Left join of the last name of each key, with a default."""
    return df.join(last_wins(names.select(key, name, *[o for o in order if o not in (key, name)]), [key], order).select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def merge_three(base: DataFrame, second: DataFrame, third: DataFrame, key: str) -> DataFrame:
    return base.join(second, key, "left").join(third, key, "left")


def extension_lookup(files: DataFrame, mime: DataFrame, name: str = "file", no_extension: str | None = "file") -> DataFrame:
    """ext_def, the comment of a name's lower-cased extension; names without one get no_extension, unknown ones null."""
    ext = F.lower(split_extension(F.col(name))["extension"])
    m = mime.groupBy("ext").agg(F.max("comment").alias("_comment"))
    return files.withColumn("_ext", ext).join(m, F.col("_ext") == F.col("ext"), "left").withColumn("ext_def", F.when(F.col("_ext") == "", F.lit(no_extension)).otherwise(F.col("_comment"))).drop("_ext", "ext", "_comment")


def file_records(titles: DataFrame, title: str, number: Column, shift: int = 0) -> DataFrame:
    """id (as string), filename, extension, directory, application of titles with three parts; ids less shift."""
    t = titles.withColumn("_t", split_triple(F.col(title))).filter("_t is not null").withColumn("_e", split_extension(F.col("_t.file")))
    return t.select((number - shift).cast("string").alias("id"), F.col("_e.stem").alias("filename"), F.col("_e.extension").alias("extension"), F.col("_t.directory").alias("directory"), F.col("_t.app").alias("application"))


def positional_split(df: DataFrame, number: str, total: int, cuts: dict[str, float]) -> DataFrame:
    """split by place: the first share of rows is the first part, and so on; what is left the last."""
    out, at, names = F, 0.0, list(cuts)
    for name in names[:-1]:
        at += cuts[name]
        out = out.when(F.col(number) < int(total * at), name)
    return df.withColumn("split", out.otherwise(names[-1]))


def anti_new(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return new.dropDuplicates([key]).join(known, key, "left_anti")


#: Patterns that one automaton takes.
PATTERNS_AT_ONCE = 50_000


def find_patterns(texts: list[str | None], patterns: dict[str, int], every: bool = False) -> list:
    """For each text the least number of a pattern that it contains, null if there is none; every: the set of all numbers. The
    patterns are one automaton, so a text is read once, however many there are."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    empty = patterns.get("")
    for p, n in patterns.items():
        if p:
            machine.add_word(p, n)
    if not len(machine):
        return [({empty} - {None} if every else empty) if t is not None else set() if every else None for t in texts]
    machine.make_automaton()
    out: list = []
    for t in texts:
        hits = (n for _, n in machine.iter(t)) if t else iter(())
        if every:
            out.append(set(hits) | ({empty} - {None} if t is not None else set()))
        else:
            best = empty if t is not None else None
            for n in hits:
                if best is None or n < best:
                    best = n
            out.append(best)
    return out


def _needed(patterns: list[tuple[str, int]]) -> dict[str, int]:
    """Patterns with their numbers, without those that contain a pattern of a smaller number: they are never the first."""
    least: dict[str, int] = {}
    for p, n in patterns:
        least[p] = min(n, least.get(p, n))
    first = find_patterns(list(least), least)
    return {p: n for (p, n), f in zip(least.items(), first, strict=True) if f == n}


def _look_for(block):
    def look(low: pd.Series, hit: pd.Series) -> pd.Series:
        patterns, names = block.value
        found = find_patterns([t if h is None else None for t, h in zip(low, hit, strict=True)], patterns)
        return pd.Series([h if h is not None else names.get(n) for h, n in zip(hit, found, strict=True)], dtype=object)

    return look


def first_containing(items: DataFrame, known: DataFrame, text: str, pattern: str, ord_: str, at_once: int | None = None) -> DataFrame:
    """items with the first known pattern, by ord_, then pattern, that their text contains, without regard to case; null if there
    is none, or no text. Repeated rows stay; null patterns are none.

    Patterns are numbered in order and cut into blocks of bounded size, from first to last. Each block is an automaton that is sent to the
    tasks; texts stay where they are and are read once a block, and a text that has its hit is not looked at again."""
    at_once = at_once or PATTERNS_AT_ONCE
    ranked = renumber(known.filter(F.col(pattern).isNotNull()).select(F.col(ord_).alias("o"), F.col(pattern).alias("p")), [F.col("o"), F.col("p")])
    total = ranked.count()
    name = pattern if pattern not in items.columns else f"{pattern}_found"
    out = items.withColumns({"\x00low": F.lower(text), "\x00hit": F.lit(None).cast("string")})
    for first in range(0, total, at_once):
        rows = ranked.filter((F.col("n") >= first) & (F.col("n") < first + at_once)).select("n", F.lower("p").alias("low"), "p").collect()
        names = {r["n"]: r["p"] for r in rows}
        block = items.sparkSession.sparkContext.broadcast((_needed([(r["low"], r["n"]) for r in rows]), names))
        out = out.withColumn("\x00hit", F.pandas_udf(_look_for(block), "string")("\x00low", "\x00hit"))
        if first + at_once < total:
            out = written(out, "hits")
    return out.select(*[F.col(f"`{c}`") for c in items.columns], F.col("\x00hit").alias(name))


def token_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def most_common(freq: DataFrame, k: int) -> DataFrame:
    return freq.orderBy(F.desc("n"), "token").limit(k)


def histogram(df: DataFrame, value: Column, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows per bin of equal width, the last one with its upper edge; low and high are the least and largest value unless
    given. Values below and above given limits are bins 0 and bins + 1; only nulls are in none."""
    v = df.select(value.cast("double").alias("v")).filter("v is not null")
    if low is None or high is None:
        ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        low, high = ends["a"] if low is None else low, ends["b"] if high is None else high
    if low is None or low == high:
        b = F.lit(1)
    else:
        b = F.when(F.col("v") == high, bins).when(F.col("v") < low, 0).when(F.col("v") > high, bins + 1).otherwise(F.least(F.floor(bins * (F.col("v") - low) / (high - low)) + 1, F.lit(bins)))
    return v.groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def resume_point(df: DataFrame, number: str, pos: str) -> DataFrame:
    return df.agg(F.coalesce(F.max_by(number, pos), F.lit(0)).alias("last_number"))


def _seeded(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sampled(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in a seeded order that does not depend on partitions."""
    return df.orderBy(_seeded(seed, key), key).limit(n)


def seeded_shuffle(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """All rows with their place in a seeded order, the same for any partitioning if the key tells rows apart."""
    return renumber(df, [_seeded(seed, key), F.col(key)], 0, name)


def zip_by_place(streams: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Several streams side by side: name -> (frame, order column, value column). Row k of each meets row k of the others;
    where one has ended its value is null."""
    out = None
    for name, (df, order, value) in streams.items():
        one = renumber(df.select(F.col(order).alias("_o"), F.col(value).alias(name)), [F.col("_o")]).select("n", name)
        out = one if out is None else out.join(one, "n", "full")
    return out
