import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.merkle import FIELDS, MerkleParams, fold, levels, merkle_manifest
from tallyloom.llm.queries import op11_merkle

from .helpers import DOCUMENTS, awkward, with_clashes

H = lambda s: sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return H("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def plain_tree(nodes):
    """The root, and the steps of each leaf."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            steps[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes, at = [H("".join(nodes[j : j + 16])) for j in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], steps


def plain(rows):
    """doc_id, leaf, subroot, root and steps of each row."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    first = lambda x: (x is not None, x if x is not None else 0)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (first(r["doc_id"]), plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]])
    root, upper = plain_tree([trees[s][0] for s in sources])
    return [(r["doc_id"], plain_leaf(r), trees[s][0], root, trees[s][1][i] + upper[k]) for k, s in enumerate(sources) for i, r in enumerate(by[s])]


def shown(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("total", [1, 2, 15, 16, 17, 256, 257, 700])
def test_levels_of_stretches_hold_all_nodes(total):
    leaves = [str(i) for i in range(total)]
    whole = {(lv, first + i): h for lv, first, nodes, _, _ in levels(0, total, leaves) for i, h in enumerate(nodes)}
    assert whole[max(whole)[0], 0] == plain_tree(leaves)[0]
    for cut in (1, total // 3, total - 1):
        for a, b in ((0, cut), (cut, total)):
            for lv, first, nodes, low, high in levels(a, total, leaves[a:b]):
                assert all(whole[lv, first + i] == h for i, h in enumerate(nodes))
                assert low >= high or (first <= 16 * low and (16 * high <= first + len(nodes) or first + len(nodes) == -(-total // 16**lv)))


@pytest.mark.parametrize("leaves", [7, 200_000])
def test_manifest_equals_plain_one(spark, leaves):
    """Many sources, one of them with half of all rows, over ranges of few and of many rows."""
    rows = [(i * 7 % 1009, f"T{i} é", "en" if i % 3 else None, None if i % 11 == 0 else f"s{i % 40}" if i % 2 else "hot", i) for i in range(900)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = merkle_manifest(df.repartition(5), p=MerkleParams(part_leaves=leaves))
    assert shown(got) == sorted(plain([r.asDict() for r in df.collect()]), key=repr)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [r.asDict() for r in df.collect()]
    want = sorted(plain(rows), key=repr)
    assert shown(merkle_manifest(df)) == want
    clashes = df
    for c in ("g", "k", "h", "c", "part", "at", "proof", "leaf", "root", "shown_leaf"):
        clashes = clashes.withColumn(c, F.lit("clash"))
    assert shown(merkle_manifest(clashes)) == want
    # fields that are replaced by a clashing name are other data: documents' own columns are hashed
    assert merkle_manifest(with_clashes(df)).count() == len(rows)


def test_few_rows(spark):
    assert merkle_manifest(spark.createDataFrame([], DOCUMENTS)).collect() == []
    one = merkle_manifest(spark.createDataFrame([(5, "x", "en", "s", 1)], DOCUMENTS)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []
    same = merkle_manifest(spark.createDataFrame([(5, "x", "en", "s", 1)] * 40, DOCUMENTS))
    assert shown(same) == sorted(plain([r for r in [dict(zip(FIELDS, (5, "s", "en", 1, "x")))] * 40]), key=repr)


def test_fold_finds_changes(spark):
    df = spark.createDataFrame([(i, f"A{i}", "en", f"s{i % 3}", 2) for i in range(50)], DOCUMENTS)
    rows = merkle_manifest(df).withColumn("good", fold(F.col("leaf"), F.col("proof"))).withColumn("bad", fold(F.sha2("leaf", 256), F.col("proof"))).collect()
    assert all(r["good"] == r["root"] != r["bad"] for r in rows)


def test_query(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    by = {r["doc_id"]: r for r in rows}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = {}
    for i, leaf, sub, root, steps in plain(rows):
        r = by[i]
        node = plain_leaf(r | {"text": r["text"] and r["text"].translate(lower)} if zlib.crc32(str(i).encode()) % 5 == 0 else r)
        for a, b in steps:
            node = H(a + node + b)
        want[i] = (i, leaf, sub, root, H("".join(a + b for a, b in steps)), node, node == root)
    got = {r["doc_id"]: tuple(r) for r in op11_merkle(spark, sf_dir).collect()}
    assert got == want
    assert {v[-1] for v in want.values()} == {True, False}
