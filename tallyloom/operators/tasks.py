"""Groups of tasks: structure, pairs for contrastive training, and overlap of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def structure(items: DataFrame, group: str, pos: str, text: str) -> DataFrame:
    """group, small_tasks in order and their text in one block."""
    out = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(pos, text))).alias("l")).select(group, F.transform("l", lambda x: x[text]).alias("small_tasks"))
    return out.withColumn("global_block", F.array_join("small_tasks", " "))


#: Tasks of a group that meet in one join key of later_pairs; the key's pairs are at most its square.
PAIR_BLOCK = 1000


def later_pairs(items: DataFrame, group: str, pos: str, text: str, block: int = PAIR_BLOCK) -> DataFrame:
    """group, a, b: the texts of all i < j of a group in order of pos. The order is cut into blocks and pairs of blocks
    meet by an equi join, so a large group becomes many keys; a group of one block is joined as it is. Rows with a null
    group are a group."""
    w = Window.partitionBy(group)
    place = items.select(group, F.col(text).alias("_t"), F.row_number().over(w.orderBy(pos, text)).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    place = place.withColumn("_k", F.floor((F.col("_i") - 1) / block))
    a = place.select(group, F.col("_t").alias("a"), F.col("_i").alias("_ai"), F.col("_k").alias("_ak"), F.explode(F.sequence("_k", F.floor((F.col("_n") - 1) / block))).alias("_bk"))
    b = place.select(F.col(group).alias("_g"), F.col("_t").alias("b"), F.col("_i").alias("_bi"), F.explode(F.sequence(F.lit(0).cast("bigint"), "_k")).alias("_ka"), F.col("_k").alias("_kb"))
    met = a.join(b, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_ak") == F.col("_ka")) & (F.col("_bk") == F.col("_kb")) & (F.col("_ai") < F.col("_bi")))
    return met.select(group, "a", "b")


def contrastive_pairs(items: DataFrame, group: str, pos: str, text: str) -> DataFrame:
    """group, kind, a, b: every task with its block; tasks i < j; and the first 70 % joined, with the block, if there are two or more."""
    groups = structure(items, group, pos, text)
    t, n = F.col("small_tasks"), F.size("small_tasks")
    block = groups.select(group, F.lit("task_block").alias("kind"), F.explode(t).alias("a"), F.col("global_block").alias("b"))
    pairs = later_pairs(items, group, pos, text).select(group, F.lit("task_task").alias("kind"), "a", "b")
    part = groups.filter(n > 1).select(group, F.lit("part_block").alias("kind"), F.array_join(F.slice(t, 1, F.floor(n * 0.7).cast("int")), " ").alias("a"), F.col("global_block").alias("b"))
    return block.unionByName(pairs).unionByName(part)


def consecutive(items: DataFrame, group: str, pos: str, text: str) -> DataFrame:
    nxt = F.lead(text).over(Window.partitionBy(group).orderBy(pos))
    return items.withColumn("next", nxt).filter("next is not null").select(group, pos, F.col(text).alias("a"), F.col("next").alias("b"))


def ring(items: DataFrame, index: str, size: int, cols: list[str]) -> DataFrame:
    """Row i with row (i + 1) mod size."""
    b = items.select(F.col(index).alias("_j"), *[F.col(c).alias(f"next_{c}") for c in cols])
    return items.join(b, F.pmod(F.col(index) + 1, F.lit(size)) == F.col("_j")).drop("_j")
