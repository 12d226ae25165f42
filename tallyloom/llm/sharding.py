"""Two-pass external shuffle into shards.

Pass 1 scatters the rows over buckets by a seeded hash of doc_id and text, so many that a bucket fits a worker's memory.
Pass 2 reads a bucket into one task, puts it in a fixed order (doc_id, CRC-32 of the text, that hash), shuffles it with a seeded Fisher-Yates shuffle and writes it. A row's place in the whole order is the rows of
all earlier buckets plus its place in its own; cutting that order into `shards` runs whose lengths differ by at most one
gives the law `rows`. As a bucket's rows are consecutive, it is written to one or two shards, not to all.

The result depends on the rows, the seed and the bucket size only, not on the partitioning or on retried tasks. Rows of
one doc_id whose texts differ are told apart by CRC-32 and hash; the order of rows that repeat both doc_id and text can't be told.

The driver and each worker hold eight bytes for each bucket, so for each `bucket_bytes` of text.

Cases. Null text: size 8, CRC-32 of no bytes. Copies of a text spread over buckets by their doc_id, rows of one doc_id or
of none by their texts; only rows that repeat both share a bucket. A bucket is bounded by the hash unless these or single
rows exceed it. Empty table: no rows. An input column named shard or slot, in any case of letters, stays under that name
with `_in` after it, as often as it takes to be the only one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import shared_dir, text_of


@dataclass(frozen=True)
class ShardParams:
    shards: int = 24
    seed: int = 20240229
    bucket_bytes: int = 32 << 20
    #: Buckets, a power of two, that are counted beside the size. If the size needs more, these are counted in a pass of their own.
    max_buckets: int = 1 << 16


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def _hash(p: ShardParams) -> Column:
    return F.xxhash64(F.lit(p.seed), "doc_id", "text")


def _bucket(p: ShardParams, buckets: int) -> Column:
    return F.pmod(_hash(p), F.lit(buckets)).cast("int")


def free_names(names: list[str], taken: set[str]) -> list[str]:
    """The names, those in taken (lower case) with `_in` after them as often as it takes."""
    used, out = taken | {n.lower() for n in names}, []
    for n in names:
        if n.lower() in taken:
            while n.lower() in used:
                n += "_in"
            used.add(n.lower())
        out.append(n)
    return out


def bucket_rows(docs: DataFrame, p: ShardParams) -> np.ndarray:
    """The rows of each bucket; the number of buckets is a power of two that follows from the size of all texts."""
    counted = docs.groupBy(_bucket(p, p.max_buckets).alias("f")).agg(F.count("*").alias("n"), F.sum(size_of(F.col("text"))).alias("bytes")).toArrow()
    size, buckets = sum(counted["bytes"].to_pylist()), 1
    while buckets * p.bucket_bytes < size:
        buckets *= 2
    if buckets > p.max_buckets:
        counted = docs.groupBy(_bucket(p, buckets).alias("f")).agg(F.count("*").alias("n")).toArrow()
    rows = np.zeros(buckets, dtype=np.int64)
    np.add.at(rows, counted["f"].to_numpy() % buckets, counted["n"].to_numpy())
    return rows


def shuffle_permutation(n: int, seed: int, bucket: int) -> np.ndarray:
    """Fisher-Yates: the i-th place from the end swaps with a random one of those up to it."""
    order = np.arange(n)
    if n > 1:
        picks = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 1, -1))
        for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
    return order


def write_shards(docs: DataFrame, p: ShardParams = ShardParams(), path: str | None = None) -> DataFrame:
    """Write all rows with shard and slot to Parquet folders shard=0, shard=1, ... and return them as read back."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "shards")
    docs = docs.toDF(*free_names(docs.columns, {"shard", "slot"}))
    rows = bucket_rows(docs, p)
    buckets, total, first = len(rows), int(rows.sum()), np.cumsum(rows) - rows
    names = docs.columns
    out = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [b for b in batches if b.num_rows]
        if not have:
            return
        bucket = have[0].column(len(names))[0].as_py()
        t = pa.Table.from_batches(have).combine_chunks()
        crc = np.array([zlib.crc32(text_of(x.as_py())) for x in t.column("text")], dtype=np.int64)
        ids = t.column("doc_id")
        hashes = t.column(len(names) + 1).to_numpy()
        order = np.lexsort((hashes, crc, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        order = order[shuffle_permutation(t.num_rows, p.seed, bucket)]
        place = np.arange(t.num_rows, dtype=np.int64) + first[bucket]
        shard = (p.shards * (place + 1) + total - 1) // total - 1
        slot = place - shard * total // p.shards
        for k in range(0, t.num_rows, 500):
            part = t.take(pa.array(order[k : k + 500])).combine_chunks().to_batches()[0]
            cols = [*part.columns[: len(names)], pa.array(shard[k : k + 500], pa.int32()), pa.array(slot[k : k + 500], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "shard", "slot"])

    scattered = docs.withColumns({"\x00bucket": _bucket(p, buckets), "\x00hash": _hash(p)})
    scattered = scattered.repartitionById(buckets, F.col("`\x00bucket`"))
    scattered.mapInArrow(shuffled, out).write.partitionBy("shard").parquet(path)
    if not total:
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(path)
