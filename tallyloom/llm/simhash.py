"""SimHash near-duplicates, with pivot distance tables to discard pairs.

Fingerprints. ASCII capitals lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `width` words (fewer words: the
whole sequence), XXH64 with seed 42 of each; bit k is set if it is set in more than half the hashes. No words: zero.

Links between fingerprints of at most `max_bits` differing bits. Only distinct fingerprints are compared, so exact
copies cost one row. A link leaves at least `blocks - max_bits` of `blocks` bit blocks equal, so fingerprints that
agree on one choice of that many blocks meet in a bucket; the number of blocks follows the number of fingerprints, any
choice finds all links. A table holds for every fingerprint its Hamming distances to `PIVOTS` fixed reference
fingerprints. By the triangle inequality a pair whose distances to a pivot differ by more than max_bits is no link; such
pairs are discarded and the others verified.

Large buckets. In a bucket of many near copies all pairs would be links. So first each member is compared with two
hubs of its bucket (its smallest and its largest fingerprint) only, and the components of these links are found; then
pairs are formed only in buckets whose members are still in several components, and only across components. That gives
the same components as all links do, without a row for each pair of a group.

Cases. Null or empty text: fingerprint zero, linked as any other. Null doc_id: takes part, but is never a component_id
unless all of its component are null. Repeated rows: a row each. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyloom.llm.common import forget, kept, record_batch, text_of
from tallyloom.llm.components import connected_components

SEED = 42
#: Reference fingerprints. Of pairs that meet by chance, each leaves about 57 %.
PIVOTS = 24
BITS = 64
#: (distinct fingerprints up to here, blocks beyond max_bits that a bucket fixes): wider keys for larger tables, so that chance meetings stay few.
SCALES = ((1 << 22, 2), (1 << 28, 3), (1 << 34, 4), (1 << 62, 6))
_CHUNK = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes, signed."""
    ones = sum((_bit_counts(hashes[k : k + _CHUNK]) for k in range(0, len(hashes), _CHUNK)), np.zeros(BITS, dtype=np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64 bits. The work space is a chunk of shingles beside the text."""
    tokens = text_of(text).lower().split()
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    stops = list(accumulate(len(w) + 1 for w in tokens))
    starts = [0, *stops[:-1]]
    n = max(1, len(tokens) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        ends = stops[at + width - 1 : to + width - 1] if len(tokens) >= width else [stops[-1]]
        ones += _bit_counts(np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], ends, strict=True)], dtype="<u8"))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fps.view(np.int64))}, schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def pivots() -> list[int]:
    """The reference fingerprints, signed."""
    return [int(np.uint64(xxh64_intdigest(f"pivot {k}".encode(), SEED)).view(np.int64)) for k in range(PIVOTS)]


def pivot_table(fp: Column) -> Column:
    """The distances to all pivots, five bits each, twelve in a 64-bit integer.

    A distance is nearly always from 16 to 47; what is beyond is taken for the nearest of these. That makes two distances
    differ by no more than they do, so no link is discarded."""
    words = [F.lit(0).cast("bigint")] * -(-PIVOTS // 12)
    for k, p in enumerate(pivots()):
        away = F.least(F.greatest(F.bit_count(fp.bitwiseXOR(F.lit(p))) - 16, F.lit(0)), F.lit(31)).cast("bigint")
        words[k // 12] = words[k // 12].bitwiseOR(F.shiftleft(away, 5 * (k % 12)))
    return F.struct(*[w.alias(f"w{i}") for i, w in enumerate(words)])


def not_discarded(a: Column, b: Column, max_bits: int) -> Column:
    """No coordinate of the two rows of the pivot table differs by more than max_bits."""
    cond = F.lit(True)
    for k in range(PIVOTS):
        at = lambda piv: F.shiftrightunsigned(piv[f"w{k // 12}"], 5 * (k % 12)).bitwiseAND(F.lit(31))  # noqa: B023, E731
        cond = cond & (F.abs(at(a) - at(b)) <= max_bits)
    return cond


def _near(a: str, b: str, max_bits: int) -> Column:
    """Not discarded by any pivot, and verified. a, b: aliases of rows with fp and its distances in piv."""
    return not_discarded(F.col(f"{a}.piv"), F.col(f"{b}.piv"), max_bits) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= max_bits)


def _masks(n: int, max_bits: int) -> list[int]:
    """One signed mask for each choice of the blocks that a bucket fixes."""
    fixed = next(k for top, k in SCALES if n <= top)
    blocks = max_bits + fixed
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [int(np.uint64(sum(whole[i] for i in c)).view(np.int64)) for c in combinations(range(blocks), fixed)]


def buckets(fps: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints fp with piv, their row of the pivot table, in every bucket (mask, part) that holds another
    one, with the bucket's hubs lo and hi (fp and piv each). A written table."""
    masks = _masks(fps.count(), max_bits)
    members = fps.select("fp", pivot_table(F.col("fp")).alias("piv")).select(
        "fp", "piv", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "part")
    )
    key = ["mask", "part"]
    # Written, so that the join reads plain exchanges, of which Spark can split large partitions.
    hubs = kept(members.groupBy(*key).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo != hi"), "hubs")
    hub = lambda c: F.struct(F.col(c).alias("fp"), pivot_table(F.col(c)).alias("piv")).alias(c)
    out = kept(members.join(hubs, key).select("fp", "piv", *key, hub("lo"), hub("hi")), "buckets")
    forget(hubs)
    return out


def hub_links(shared: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): the links between members of buckets() and the hubs of their buckets."""
    star = lambda hub: shared.alias("a").filter((F.col("a.fp") != F.col(f"{hub}.fp")) & _near("a", hub, max_bits)).select(F.col("a.fp").alias("u"), F.col(f"{hub}.fp").alias("v"))
    return star("lo").unionByName(star("hi"))


def fingerprint_components(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, root) for the distinct fingerprints of fps (column fp), a written table: root is the same for all that links connect."""
    shared = buckets(fps, max_bits)
    near = connected_components(hub_links(shared, max_bits))
    key = ["mask", "part"]
    labelled = shared.select("fp", "piv", *key).join(near.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = kept(labelled, "labelled")
    several = kept(labelled.groupBy(*key).agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select(*key), "several")
    open_ = labelled.join(several, key, "left_semi")
    a, b = open_.alias("a"), open_.alias("b")
    across = a.join(b, (F.col("a.mask") == F.col("b.mask")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.root") < F.col("b.root")) & _near("a", "b", max_bits))
    joined = connected_components(across.select(F.col("a.root").alias("u"), F.col("b.root").alias("v")))
    out = kept(
        fps.select("fp").join(near.withColumnRenamed("node", "fp"), "fp", "left").withColumn("mid", F.coalesce("root", "fp")).drop("root")
        .join(joined.withColumnRenamed("node", "mid"), "mid", "left").select("fp", F.coalesce("root", "mid").alias("root")), "roots"
    )
    forget(shared, labelled, several, near, joined)
    return out


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    rows = kept(fingerprints(docs, width), "fingerprints")
    fps = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    components = fingerprint_components(fps, max_bits)
    roots = kept(fps.join(components, "fp"), "roots")
    lead = kept(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "lead")
    named = kept(roots.join(lead, "root").select("fp", "component_id"), "named")
    forget(fps, components, roots, lead)
    # rows is not grouped here, so Spark splits the partition of a fingerprint that very many rows have.
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
