"""A Merkle manifest of a dataset: one tree of 16-way runs for each source, one above their roots, and a proof for each row.

A leaf is the SHA-256 of a row's fields. Leaves of a source ascend by doc_id; while a level has several nodes, every 16
consecutive ones become the SHA-256 of their hexadecimal digests, joined. The roots of the sources, in order of source,
are the leaves of the upper tree. The same jobs make both:

1. Leaves are sorted by range over all sources and written with their range's number and their place in it, so ranges are
   fixed once and a large source lies in many of them. Rows of a source in a range are a stretch.
2. Counts of stretches, summed along each source, tell the place of a stretch's first leaf in its tree and the tree's size.
3. Each range builds the complete runs of its stretches, level by level. Only nodes whose run reaches into another range
   leave the task: at most 30 for each stretch and level.
4. These meet by (source, level, run), one small grouping for each level.
5. Each stretch fetches the few runs that it shares with others, at most two a level, builds its own ones again, and
   gives every leaf its proof: what stands left and right of its node in the run, from the leaf to the root.

Memory of a task is bounded by `part_leaves` leaves, wherever the rows of a source or of equal rows lie.

Cases. Null fields are hashed as `-`; null sources are a source, before all others; null doc_ids come first in theirs. Rows
that share source and doc_id are ordered by their leaf; equal rows have places of their own, one after another. A source of
one row has its leaf as its root. No rows give no rows. Other columns of the input are neither hashed nor returned
unless they are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import forget, kept

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 16
STEP = "struct<left:string,right:string>"


@dataclass(frozen=True)
class MerkleParams:
    #: Leaves of a range, about; a task holds their digests.
    part_leaves: int = 200_000


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row of documents, some fields by other columns."""
    shown = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        shown.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*shown), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def _parent(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels(first: int, total: int, nodes: list[str]) -> Iterator[tuple[int, int, list[str], int, int]]:
    """What a stretch of a tree's leaves, the first at place `first`, gives by itself: for each level its number, the place
    of its first node, its nodes, and the first and end of the runs that are complete here."""
    level = 0
    while nodes:
        low, high = -(-first // WIDTH), (first + len(nodes)) // WIDTH
        if first + len(nodes) == total:
            high = -(-total // WIDTH)
        if total == 1:
            low = high = first
        yield level, first, nodes, low, high
        nodes = [_parent(nodes[max(0, WIDTH * j - first) : WIDTH * (j + 1) - first]) for j in range(low, high)]
        level, first, total = level + 1, low, -(-total // WIDTH)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], pa.Table]]:
    """The stretches and the leaves of each range, of rows sorted by range, kind and place."""
    held: list[pa.RecordBatch] = []

    def cut() -> tuple[list[dict], pa.Table]:
        t = pa.Table.from_batches(held)
        n = pc.sum(pc.equal(t["kind"], 0)).as_py()
        return t.slice(0, n).to_pylist(), t.slice(n)

    for b in batches:
        parts = b.column("part").to_pylist()
        for part, rows in groupby(range(len(parts)), parts.__getitem__):
            rows = list(rows)
            if held and held[0].column("part")[0].as_py() != part:
                yield cut()
                held = []
            held.append(b.slice(rows[0], len(rows)))
    if held:
        yield cut()


def _sent(placed: DataFrame, spans: DataFrame, leaf_cols: list[str], span_cols: list[str], parts: int) -> DataFrame:
    """Stretches and leaves together by range, in order."""
    known = {f.name: f.dataType for f in [*placed.schema, *spans.schema]}
    cols = [*leaf_cols, *span_cols]
    row = lambda kind, have: [F.lit(kind).alias("kind"), *[F.col(c) if c in have else F.lit(None).cast(known[c]).alias(c) for c in ("part", "at", *cols)]]
    both = spans.select(*row(0, ["part", "at", *span_cols])).unionByName(placed.select(*row(1, ["part", "at", *leaf_cols])))
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "at")


class Forest:
    """Trees over rows (g, k, h, c): one for each g, leaves h in order of k; c is carried."""

    def __init__(self, leaves: DataFrame, p: MerkleParams):
        spark = leaves.sparkSession
        self.leaves = leaves
        # written leaves have a place in their file, which tells equal rows apart, the same for every attempt
        tie = F.xxhash64("_metadata.file_path", "_metadata.row_index")
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // p.part_leaves))
        by = ["g", "k", "h", "tie"]
        ranged = leaves.select("*", tie.alias("tie")).repartitionByRange(self.parts, *by).sortWithinPartitions(*by).drop("tie")
        self.placed = kept(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "merkle-leaves")
        self.spans = kept(self._spans(), "merkle-spans")
        largest = self.spans.agg(F.max("total").alias("m")).first()["m"]
        self.depth = 0
        while largest and WIDTH**self.depth < largest:
            self.depth += 1
        self._finish()

    def _spans(self) -> DataFrame:
        """part, at (place in the range of its first leaf), g, n, first (place in the tree) and total of each stretch."""
        counts = self.placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
        tree = Window.partitionBy("g")
        before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select("part", "at", "g", "n", before.alias("first"), F.sum("n").over(tree).alias("total"))

    def _finish(self) -> None:
        """runs (g, level, run, nodes) that several ranges share, and roots (g, root)."""
        g = self.placed.schema["g"].dataType
        out = T.StructType([T.StructField("g", g), *T.StructType.fromDDL("total bigint, level int, place bigint, h string")])

        def ragged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for spans, leaves in _parts(batches):
                hs = leaves["h"].to_pylist()
                rows = []
                for s in spans:
                    for level, first, nodes, low, high in levels(s["first"], s["total"], hs[s["at"] : s["at"] + s["n"]]):
                        rows += [(s["g"], s["total"], level, first + i, h) for i, h in enumerate(nodes) if not WIDTH * low <= first + i < WIDTH * high]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (leaves.schema.field("g").type if "g" in leaves.schema.names else None, pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=out.names)

        left = kept(_sent(self.placed, self.spans, ["h"], ["g", "n", "first", "total"], self.parts).mapInArrow(ragged, out), "merkle-ragged")
        self.runs, roots, below = [], [], None
        for level in range(self.depth + 1):
            here = left.filter(F.col("level") == level)
            here = here if below is None else here.unionByName(below)
            roots.append(here.filter(F.col("total") <= WIDTH**level).select("g", F.col("h").alias("root")))
            if level == self.depth:
                break
            run = here.filter(F.col("total") > WIDTH**level).groupBy("g", "total", F.shiftright("place", 4).alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("nodes"))
            run = kept(run.select("g", "total", F.lit(level).alias("level"), "run", F.transform("nodes", lambda x: x["h"]).alias("nodes")), "merkle-runs")
            self.runs.append(run)
            below = run.select("g", "total", F.lit(level + 1).alias("level"), F.col("run").alias("place"), F.sha2(F.array_join("nodes", ""), 256).alias("h"))
        all_roots = roots[0]
        for more in roots[1:]:
            all_roots = all_roots.unionByName(more)
        self.roots = kept(all_roots, "merkle-roots")
        forget(left)

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """k, h, c, g, root and proof of every leaf; above: g, top and upper, the root and the steps that follow a tree's own."""
        spans = self.spans
        same = F.col("s.g").eqNullSafe(F.col("r.g"))
        if self.runs:
            runs = self.runs[0]
            for more in self.runs[1:]:
                runs = runs.unionByName(more)
            asked = spans.select("part", "g", "first", "n", "total", F.explode(F.sequence(F.lit(0), F.lit(self.depth - 1))).alias("level"))
            ends = [F.expr(f"shiftright({c}, 4 * (level + 1))") for c in ("first", "first + n - 1")]
            asked = asked.select("part", "g", "level", F.explode(F.array_distinct(F.array(*ends))).alias("run"))
            met = asked.alias("s").join(runs.alias("r"), same & (F.col("s.level") == F.col("r.level")) & (F.col("s.run") == F.col("r.run")))
            shared = met.select("s.part", "s.g", F.struct("r.level", "r.run", "r.nodes").alias("x")).groupBy("part", "g").agg(F.collect_list("x").alias("shared"))
            spans = spans.alias("s").join(shared.alias("r"), same & (F.col("s.part") == F.col("r.part")), "left").select("s.*", "r.shared")
        else:
            spans = spans.withColumn("shared", F.lit(None).cast("array<struct<level:int,run:bigint,nodes:array<string>>>"))
        spans = spans.alias("s").join(self.roots.alias("r"), same).select("s.*", "r.root")
        if above is None:
            spans = spans.withColumns({"top": F.col("root"), "upper": F.array().cast(f"array<{STEP}>")})
        else:
            spans = spans.alias("s").join(above.alias("r"), same).select("s.*", "r.top", "r.upper")
        field = self.placed.schema
        out = T.StructType([T.StructField("k", field["k"].dataType), T.StructField("h", T.StringType()), T.StructField("c", field["c"].dataType), T.StructField("g", field["g"].dataType), *T.StructType.fromDDL(f"root string, top string, proof array<{STEP}>")])
        sent = _sent(self.placed, spans, ["k", "h", "c"], ["g", "n", "first", "total", "shared", "root", "top", "upper"], self.parts)
        return sent.mapInArrow(_proved, out)

    def forget(self) -> None:
        forget(self.placed, self.spans, self.roots, *self.runs)


def _sides(nodes: list[str], place: int) -> tuple[str, str]:
    return "".join(nodes[:place]), "".join(nodes[place + 1 :])


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for spans, leaves in _parts(batches):
        hs = leaves["h"].to_pylist()
        for s in spans:
            own = list(levels(s["first"], s["total"], hs[s["at"] : s["at"] + s["n"]]))
            shared = {(x["level"], x["run"]): x["nodes"] for x in s["shared"] or ()}
            upper = [(x["left"], x["right"]) for x in s["upper"]]
            known: dict[tuple[int, int], tuple[str, str]] = {}

            def step(level: int, place: int) -> tuple[str, str]:
                run = place // WIDTH
                nodes = shared.get((level, run))
                if nodes is None:
                    _, first, here, _, _ = own[level]
                    nodes = here[WIDTH * run - first : WIDTH * (run + 1) - first]
                return _sides(nodes, place - WIDTH * run)

            depth = 0
            while WIDTH**depth < s["total"]:
                depth += 1
            for start in range(0, s["n"], 500):
                end = min(s["n"], start + 500)
                lefts, rights = [], []
                for i in range(s["first"] + start, s["first"] + end):
                    steps = [step(0, i)] if depth else []
                    for level in range(1, depth):
                        key = (level, i >> 4 * level)
                        if key not in known:
                            known[key] = step(*key)
                        steps.append(known[key])
                    steps += upper
                    lefts += [x for x, _ in steps]
                    rights += [x for _, x in steps]
                n, each = end - start, depth + len(upper)
                proof = pa.ListArray.from_arrays(pa.array(range(0, n * each + 1, each) if each else [0] * (n + 1), pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], names=["left", "right"]))
                rows = leaves.slice(s["at"] + start, n).combine_chunks()
                col = lambda c: rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0)  # noqa: E731, B023
                same = lambda c, t: pa.array([s[c]] * n, t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([col("k"), col("h"), col("c"), same("g", leaves.schema.field("g").type), same("root", pa.string()), same("top", pa.string()), proof], names=["k", "h", "c", "g", "root", "top", "proof"])


def merkle_manifest(docs: DataFrame, carry: dict[str, Column] | None = None, p: MerkleParams = MerkleParams()) -> DataFrame:
    """doc_id, source, leaf, subroot, root and proof (steps of left and right, from the leaf to the root) of every row, and the carried columns."""
    carry = carry or {}
    leaves = kept(docs.select(F.col("source").alias("g"), F.col("doc_id").alias("k"), leaf_of().alias("h"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("c")), "merkle-rows")
    trees = Forest(leaves, p)
    roots = kept(trees.roots.select(F.lit(0).alias("g"), F.col("g").alias("k"), F.col("root").alias("h"), F.struct(F.lit(0).alias("_")).alias("c")), "merkle-tops")
    upper = Forest(roots, p)
    above = kept(upper.proofs().select(F.col("k").alias("g"), "top", F.col("proof").alias("upper")), "merkle-above")
    upper.forget()
    forget(leaves, roots)
    found = trees.proofs(above)
    return found.select(F.col("k").alias("doc_id"), F.col("g").alias("source"), F.col("h").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), "proof", *[F.col(f"c.{n}").alias(n) for n in carry])
