import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm.queries import op6_sharding
from tallyloom.llm.sharding import ShardParams, bucket_rows, free_names, shuffle_permutation, write_shards
from tests.llm.helpers import awkward, documents, with_clashes


def check(rows, shards):
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min([per[s] for s in range(shards)]) <= 1
    for s in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))


def test_query_keeps_every_row_and_the_law(spark, sf_dir):
    rows = op6_sharding(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in docs.items()} and len(rows) == len(docs)
    check(rows, 24)


def test_many_buckets_and_partitionings_agree(spark):
    texts = [f"text {i % 50} " * (i % 9) for i in range(900)]
    p = ShardParams(shards=7, bucket_bytes=2000)
    a = write_shards(documents(spark, texts).repartition(1), p)
    b = write_shards(documents(spark, texts).repartition(9), p)
    place = lambda df: {r["doc_id"]: (r["shard"], r["slot"]) for r in df.collect()}
    assert place(a) == place(b)
    check(a.collect(), 7)
    order = [r["doc_id"] for r in a.orderBy("shard", "slot").collect()]
    moved = np.corrcoef(order, range(900))[0, 1]
    assert sorted(order) == list(range(900)) and abs(moved) < 0.2


def test_permutation_is_fisher_yates():
    assert sorted(shuffle_permutation(100, 1, 2)) == list(range(100)) and list(shuffle_permutation(1, 1, 2)) == [0] and len(shuffle_permutation(0, 1, 2)) == 0
    firsts = Counter(int(shuffle_permutation(4, 1, k)[0]) for k in range(4000))
    assert all(850 < firsts[i] < 1150 for i in range(4))


def test_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    rows = write_shards(docs).collect()
    assert len(rows) == docs.count()
    check(rows, 24)
    assert write_shards(docs.limit(0)).count() == 0
    assert set(write_shards(docs).columns) == set(docs.columns) | {"slot", "shard_in"}
    assert Counter(r["shard_in"] for r in write_shards(docs).collect()) == Counter(r["shard"] for r in docs.collect())


def test_names_that_clash(spark):
    assert free_names(["Shard", "slot", "slot_in", "text"], {"shard", "slot"}) == ["Shard_in", "slot_in_in", "slot_in", "text"]
    docs = spark.createDataFrame([(i, f"t {i}", f"s{i}", i * i, -i) for i in range(40)], "doc_id long, text string, SHARD string, slot int, slot_in int")
    rows = write_shards(docs, ShardParams(shards=3)).collect()
    assert sorted((r["doc_id"], r["SHARD_in"], r["slot_in_in"], r["slot_in"]) for r in rows) == [(i, f"s{i}", i * i, -i) for i in range(40)]
    check(rows, 3)


def test_more_buckets_than_are_counted_at_first(spark):
    """The number of buckets that are counted beside the size changes nothing."""
    docs = documents(spark, [f"text {i % 50} " * (i % 9) for i in range(900)])
    place = lambda p: {r["doc_id"]: (r["shard"], r["slot"]) for r in write_shards(docs, p).collect()}
    few = place(ShardParams(shards=7, bucket_bytes=2000, max_buckets=2))
    assert few == place(ShardParams(shards=7, bucket_bytes=2000)) and len(few) == 900
    assert len(bucket_rows(docs, ShardParams(bucket_bytes=2000, max_buckets=2))) > 2


def test_texts_of_one_id_and_checksum(spark):
    """Two texts of one doc_id and CRC-32 keep their places, whatever the partitioning."""
    pair = ["plumless", "buckeroo"]  # a known collision
    assert zlib.crc32(pair[0].encode()) == zlib.crc32(pair[1].encode())
    docs = documents(spark, [*pair, *(f"w{i}" for i in range(30))], [1, 1, *range(2, 32)])
    places = [sorted((r["text"], r["shard"], r["slot"]) for r in write_shards(docs.orderBy(o).repartition(n), ShardParams(shards=4)).collect()) for o, n in (("text", 1), (F.desc("text"), 1), ("doc_id", 6))]
    assert places[0] == places[1] == places[2]


def test_placement_matches_a_plain_version(spark):
    """Buckets by hash, each put in order, shuffled with its own seed, laid end to end and cut into shards."""
    texts = [f"text {i % 40} " * (i % 7) for i in range(400)] + [None, ""]
    docs = documents(spark, texts, [*range(300), *[7] * 100, None, None])
    p = ShardParams(shards=5, bucket_bytes=1500)
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(p.seed), "doc_id", "text").alias("h")).collect()
    size, buckets = sum(len((r["text"] or "").encode()) + 8 for r in rows), 1
    while buckets * p.bucket_bytes < size:
        buckets *= 2
    order = []
    for k in range(buckets):
        own = sorted((r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode())) for r in rows if r["h"] % p.max_buckets % buckets == k)
        order += [own[i] for i in shuffle_permutation(len(own), p.seed, k)]
    cuts = [s * len(order) // p.shards for s in range(p.shards + 1)]
    want = Counter((*x[:2], x[2], s, i - cuts[s]) for s in range(p.shards) for i, x in enumerate(order) if cuts[s] <= i < cuts[s + 1])
    got = Counter((r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in write_shards(docs, p).collect())
    assert got == want
    per = Counter(r["h"] % p.max_buckets % buckets for r in rows if r["doc_id"] == 7)
    assert max(per.values()) < 50
