"""Near duplicates by the similarity of their sets of shingles: exactly the documents of Jaccard similarity 0.8 or more are linked.

The set of a text: ASCII capitals lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `width` words (fewer words: the
whole sequence; none: the empty set), XXH64 with seed 42 of each, without repeats. Texts of one set are one node.

1. SimHash. The sets' SimHash fingerprints are linked by buckets, hubs and pivot tables as in simhash (`max_bits`); what
   the pivots leave is verified as in 4 and 5. This joins most copies, but texts of similarity 0.8 differ in ten bits of 64 on average,
   so it can't find all links.
2. Candidates for the others. In any one order of all shingles, two sets of at least the similarity s have one of their
   first n - ceil(s n) + 1 shingles in common. Those are a set's keys. The order puts shingles last that a sketch of
   counters holds for common, so texts seldom meet by what many have; any order gives the same links.
3. Hubs. Each set is held against the smallest and the largest node of its keys' buckets only, unless they are joined
   already; the components of these links are found. Then pairs are formed only in buckets whose members are in several
   components, and only across components. That gives the same components as all links do, without a row for each pair
   of a group.
4. Sketches rule out nearly all other pairs, and spare nearly all links a look at the sets. A sketch of b bits says of
   each bit whether an odd number of the set's hashes fall on it. Sets that differ in d elements have sketches that differ
   in d bits at most, so more bits than a link may have elements rule a pair out for certain. Fewer bits than d come only
   from elements that fall on each other; where so few bits would need more such meetings than chance gives with
   probability `chance`, the pair is a link. A sketch has four to eight times as many bits as its set has elements; a larger one is folded to
   the size of a smaller.
5. What is left, pairs close to the very similarity, is decided by the whole sets.

Rows a document: its keys, a fifth of its shingles, whatever the number of documents. Exact copies are passed on once a
task. The counters' table and the sketches' parameters have a fixed size.

Cases. Null or empty text: the empty set, a group of its own kind. Null doc_id: takes part; group_id is null only if all
of the group are null. Repeated rows: a row each in similar_groups, one stays in drop_near_duplicates. Empty table: no
rows. Rows of the same doc_id and different texts are told apart. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyloom.llm.common import forget, kept, record_batch, text_of
from tallyloom.llm.components import connected_components
from tallyloom.llm.simhash import SEED, buckets, hub_links, majority_bits


@dataclass(frozen=True)
class SimilarParams:
    width: int = 5
    similarity: float = 0.8
    #: Bits in which SimHash fingerprints may differ for the first links.
    max_bits: int = 4
    #: How likely it may be that a pair is taken for a link by its sketches alone and is none.
    chance: float = 1e-12
    #: Bits of the sketch that rules out pairs in a bucket, and the least of the sketches that follow the set's size.
    bits: int = 512
    #: Nodes whose sets are fetched by a broadcast list (24 bytes each); more are joined by a shuffle.
    listed: int = 200_000

    def most_apart(self, n_u: int, n_v: int) -> int:
        """Elements in one only of two sets of these sizes, at most, if they are a link."""
        least = math.ceil(self.similarity * (n_u + n_v) / (1 + self.similarity) - _EPS)
        return n_u + n_v - 2 * least


#: Counters of the sketch that says which shingles are common, the share of texts it counts (one in so many), and the count from which it matters.
COUNTERS, COUNTED, COMMON = 1 << 20, 16, 4
#: Nodes that a task remembers.
REMEMBERED = 1 << 20
_EPS = 1e-9


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes, unsigned and ascending; a text without words has none."""
    tokens = text_of(text).lower().split()
    if not tokens:
        return np.empty(0, dtype="<u8")
    joined = memoryview(b" ".join(tokens))
    stops = list(accumulate(len(w) + 1 for w in tokens))
    ends = stops[width - 1 :] or stops[-1:]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *stops], ends)), dtype="<u8", count=len(ends)))


def sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bytes; bit k is set if an odd number of the hashes falls on it. bits: a power of two."""
    on = np.bincount(((hashes >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little")


def sketch_bits(n: int, p: SimilarParams) -> int:
    return max(p.bits, 1 << (4 * n - 1).bit_length() if n else 0)


def differing_bits(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Of two sketches, the larger one folded: the differing bits, and the bits of the smaller."""
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum()), 8 * size


@lru_cache(maxsize=1 << 16)
def surely_linked(apart: int, bits: int, chance: float) -> int:
    """Differing bits up to which sets differ in `apart` elements or fewer, but for `chance`; -1 if none are that few.

    apart + 1 elements or more on `bits` places leave x differing bits only if at least (apart + 1 - x) / 2 pairs of
    elements meet, of apart^2 / 2 bits that are expected; meetings are rare and nearly independent, so Chernoff's bound
    for a Poisson number holds."""
    d = apart + 1
    mean = d * d / (2 * bits)
    lo, hi = math.floor(mean), d  # pairs that meet: the fewest so unlikely
    tail = lambda k: -mean + k - k * math.log(k / mean) if k > mean else 0.0
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if tail(mid) <= math.log(chance) else (mid + 1, hi)
    return max(-1, d - 2 * lo)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, "<u8"), *arrays]).astype("<u8").view(np.int64)))


def _ranks(docs: DataFrame, p: SimilarParams) -> np.ndarray:
    """How common the shingles of each counter are, on a rough scale. It only orders shingles, so any values give the same groups."""
    schema = pa.schema([("counter", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, p.width) for t in b.column("text").to_pylist()]
            at, n = np.unique(np.concatenate([np.empty(0, "<u8"), *found]).astype("<u8") % np.uint64(COUNTERS), return_counts=True)
            yield record_batch({"counter": at.astype(np.int64), "n": n}, schema)

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).mapInArrow(run, "counter bigint, n bigint")
    rank = F.least(F.lit(127), F.floor(3 * F.log2("n"))).cast("tinyint")
    # Five bytes a counter, so five MB at most, whatever the number of documents.
    common = some.groupBy("counter").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).select(F.col("counter").cast("int"), rank.alias("rank")).toArrow()
    ranks = np.zeros(COUNTERS, dtype=np.int8)
    ranks[common["counter"].to_numpy()] = common["rank"].to_numpy()
    return ranks


def shingled(docs: DataFrame, p: SimilarParams) -> DataFrame:
    """doc_id, text_hash and node (a hash of the shingle set) of every row; where a task meets a node first also fp, its
    SimHash fingerprint, n, the set's size, its sketches (small: of p.bits, as 64-bit integers) and its keys."""
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(docs, p))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("small", pa.list_(pa.int64())), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for text in b.column("text").to_pylist():
                s = shingle_set(text, p.width)
                node = xxh64_intdigest(s.tobytes(), SEED)
                out["node"].append(node)
                if node in seen:
                    for c in ("fp", "n", "small", "sketch", "keys"):
                        out[c].append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                out["fp"].append(majority_bits(s))
                out["n"].append(len(s))
                out["small"].append(sketch(s, p.bits).view("<i8"))
                out["sketch"].append(sketch(s, sketch_bits(len(s), p)).tobytes())
                first = len(s) - math.ceil(p.similarity * len(s) - _EPS) + 1 if len(s) else 0
                out["keys"].append(s[np.lexsort((s, ranks.value[s % np.uint64(COUNTERS)]))][:first].view("<i8"))
            out["node"] = np.array(out["node"], dtype="<u8").view("<i8")
            yield record_batch(out | {"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash")}, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, fp bigint, n int, small array<bigint>, sketch binary, keys array<bigint>")


def _enough(shared: Column, n_u: Column, n_v: Column, p: SimilarParams) -> Column:
    """Sets of these sizes with so many shingles in common have at least the similarity."""
    return shared * (1 + p.similarity) >= p.similarity * (n_u + n_v) - _EPS


def _may_be_alike(p: SimilarParams) -> Column:
    """Not ruled out by sizes and small sketches, for columns n and small of u and v. No link is ruled out."""
    n_u, n_v = F.col("n_u"), F.col("n_v")
    bits = F.aggregate(F.zip_with("small_u", "small_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _enough(F.least(n_u, n_v), n_u, n_v, p) & _enough((n_u + n_v - bits) / 2, n_u, n_v, p)


def _judged(pairs: DataFrame, sides: DataFrame, p: SimilarParams) -> DataFrame:
    """The pairs (columns u and v, others stay) that sketches don't rule out, and whether they are links for sure."""
    side = lambda c: sides.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    keep = pairs.columns
    schema = pa.schema([*[(c, pa.int64()) for c in keep], ("sure", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, sure = [], []
            for k, (n_u, n_v, a, c) in enumerate(zip(*(b.column(x).to_pylist() for x in ("n_u", "n_v", "sketch_u", "sketch_v")), strict=True)):
                apart = p.most_apart(n_u, n_v)
                if abs(n_u - n_v) > apart:
                    continue
                x, bits = differing_bits(np.frombuffer(a, np.uint8), np.frombuffer(c, np.uint8))
                if x <= apart:
                    taken.append(k)
                    sure.append(x <= surely_linked(apart, bits, p.chance))
            rows = b.take(pa.array(taken, pa.int64()))
            yield record_batch({c: rows.column(c) for c in keep} | {"sure": sure}, schema)

    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.mapInArrow(run, ", ".join(f"{c} bigint" for c in keep) + ", sure boolean")


def _sets(docs: DataFrame, wanted: DataFrame, p: SimilarParams) -> DataFrame:
    """node and hashes, its shingle set, of the wanted (node, doc_id, text_hash)."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record_batch({"node": b.column("node"), "hashes": _lists([shingle_set(t, p.width) for t in b.column("text").to_pylist()])}, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    asked = F.broadcast(wanted) if wanted.count() <= p.listed else wanted
    found = rows.join(asked, (F.col("_hash") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "text")
    return found.mapInArrow(run, "node bigint, hashes array<bigint>").dropDuplicates(["node"])


def _links(docs: DataFrame, firsts: DataFrame, sides: DataFrame, pairs: DataFrame, p: SimilarParams) -> DataFrame:
    """The pairs that are links."""
    judged = kept(_judged(pairs, sides, p), "judged")
    unsure = judged.filter("not sure").drop("sure")
    nodes = unsure.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = kept(firsts.join(nodes, "node"), "wanted")
    sets = kept(_sets(docs, wanted, p), "sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}"))
    looked = unsure.join(side("u"), "u").join(side("v"), "v").filter(_enough(F.size(F.array_intersect("of_u", "of_v")), F.size("of_u"), F.size("of_v"), p))
    out = kept(judged.filter("sure").drop("sure").unionByName(looked.select(pairs.columns)), "linked")
    forget(judged, wanted, sets)
    return out


def _simhash_pairs(sides: DataFrame, p: SimilarParams) -> DataFrame:
    """(u, v): pairs of nodes whose SimHash fingerprints are linked; of nodes with one fingerprint, each with the first."""
    firsts = kept(sides.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    shared = buckets(firsts, p.max_bits)
    first = lambda c: firsts.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c))
    links = hub_links(shared, p.max_bits).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v")).distinct()
    links = links.join(first("u"), "fp_u").join(first("v"), "fp_v").select("u", "v")
    out = kept(links.unionByName(sides.select("fp", F.col("node").alias("u")).join(firsts, "fp").filter("u != first").select("u", F.col("first").alias("v"))), "pairs")
    forget(firsts, shared)
    return out


def _components(docs: DataFrame, wide: DataFrame, p: SimilarParams) -> DataFrame:
    """(node, root) of every node with a link, as a written table."""
    # One row of each node, found before any join, so that copies are put together where they are read.
    firsts = kept(wide.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select("node", "at.*"), "firsts")
    sides = kept(wide.filter("keys is not null").select("node", "fp", "n", "small", "sketch").dropDuplicates(["node"]), "sides")
    pairs = _simhash_pairs(sides, p)
    linked = _links(docs, firsts, sides, pairs, p)
    copies = connected_components(linked)
    forget(pairs, linked)

    members = wide.filter("keys is not null").select("node", F.explode("keys").alias("key"))
    # Written, so that the next join reads plain exchanges, of which Spark can split large partitions.
    hubs = kept(members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi"), "hubs")
    shared = kept(members.join(hubs, "key"), "buckets")
    pairs = shared.select(F.col("node").alias("u"), F.explode(F.array("lo", "hi")).alias("v")).filter("u != v").distinct()
    root = lambda c: copies.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    pairs = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left").filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")
    small = lambda c: sides.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("small").alias(f"small_{c}"))
    pairs = kept(pairs.join(small("u"), "u").join(small("v"), "v").filter(_may_be_alike(p)).select("u", "v"), "pairs")
    linked = _links(docs, firsts, sides, pairs, p)
    near = connected_components(linked.unionByName(copies.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    forget(copies, hubs, pairs, linked)

    labelled = kept(shared.select("key", "node").join(near, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "labelled")
    several = kept(labelled.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("key"), "several")
    open_ = labelled.join(several, "key", "left_semi").distinct()
    open_ = kept(open_.join(sides.select("node", "n", "small"), "node"), "open")
    forget(shared, labelled, several)
    a, b = (open_.select("key", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("small").alias(f"small_{c}"), F.col("root").alias(f"root_{c}")) for c in "uv")
    meet = a.join(b, (a["key"] == b["key"]) & (F.col("root_u") < F.col("root_v")) & _may_be_alike(p))
    meet = kept(meet.select("u", "v", "root_u", "root_v").distinct(), "meet")
    across = _links(docs, firsts, sides, meet, p)
    joined = connected_components(across.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    forget(firsts, sides, open_, meet, across)

    mid = near.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = joined.join(near.select("node"), "node", "left_anti")
    out = kept(mid.unionByName(alone.select("node", "root")), "roots")
    forget(near, joined)
    return out


def _grouped(docs: DataFrame, p: SimilarParams) -> tuple[DataFrame, DataFrame]:
    """Two written tables. Each distinct doc_id and text_hash with node and copies, the rows that have both; and nodes
    with lead, the first of these of the node's group: (whether doc_id is null, doc_id, text_hash)."""
    wide = kept(shingled(docs, p), "wide")
    roots = _components(docs, wide, p)
    rows = kept(wide.groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("copies")), "rows")
    own = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "text_hash")).alias("own"))
    own = kept(own.join(roots, "node", "left").select("node", "own", F.coalesce("root", "node").alias("root")), "own")
    leads = kept(own.groupBy("root").agg(F.min("own").alias("lead")), "leads")
    nodes = kept(own.join(leads, "root").select("node", "lead"), "nodes")
    forget(wide, roots, own, leads)
    return rows, nodes


def similar_groups(docs: DataFrame, p: SimilarParams = SimilarParams()) -> DataFrame:
    """doc_id and group_id, the smallest doc_id that links between documents of at least that similarity reach."""
    rows, nodes = _grouped(docs, p)
    each = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.join(nodes, "node").select("doc_id", F.col("lead.doc_id").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, p: SimilarParams = SimilarParams()) -> DataFrame:
    """One document of each group, that with the smallest doc_id (null comes last), of several the smallest hash of its
    text; of rows that repeat both, any one. All columns stay."""
    rows, nodes = _grouped(docs, p)
    leads = rows.join(nodes, "node").select("doc_id", "text_hash", "copies", (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))).alias("is_lead"))
    gone = leads.filter("not is_lead or copies > 1")
    again = leads.filter("is_lead and copies > 1")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"))
    same = lambda t: named["id"].eqNullSafe(t["doc_id"]) & (named["hash"] == t["text_hash"])
    one = named.join(gone, same(gone), "left_anti").select("row")
    rest = named.join(again, same(again), "left_semi").dropDuplicates(["id", "hash"]).select("row")
    return one.unionAll(rest).select("row.*")
