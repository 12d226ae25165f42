import random
import re

import xxhash
from pyspark.sql import functions as F

from tallyloom.llm.queries import op3_simhash
from tallyloom.llm.simhash import PIVOTS, fingerprint, fingerprint_components, near_duplicates, not_discarded, pivot_table, pivots
from tests.llm.helpers import AWKWARD, awkward, documents, with_clashes


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps, max_bits=4):
    """{value: smallest value reached}"""
    fps, root = sorted(set(fps)), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_match_brute_force():
    for t in AWKWARD:
        assert fingerprint(t) == brute_fp(t), t


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for centre in fps[:12]:
        fps += [centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for _ in range(25)]
    walk = fps[20]
    for _ in range(40):
        walk ^= sum(1 << k for k in rng.sample(range(64), 4))
        fps.append(walk)
    dense = rng.getrandbits(64)
    fps += [dense ^ sum(1 << k for k in rng.sample(range(64), 2)) for _ in range(300)]
    df = spark.createDataFrame([(signed(x),) for x in set(fps)], "fp long")
    got = {r["fp"]: r["root"] for r in fingerprint_components(df).collect()}
    want = brute_components(fps)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups({signed(k): v for k, v in want.items()})


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fp = {r["doc_id"]: brute_fp(r["text"]) for r in docs}
    root = brute_components(fp.values())
    least = {}
    for d, f in fp.items():
        least[root[f]] = min(d, least.get(root[f], d))
    got = op3_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{f:016x}", least[root[f]]) for d, f in fp.items()}


def test_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    zero = [r for r in rows if r["fp"] == 0]
    assert len(zero) == 4 and all(r["component_id"] == 0 for r in zero)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_pivots_discard_no_link(spark):
    """Of random pairs of 0 to 16 differing bits, all of 4 or fewer stay, and few of the others."""
    rng = random.Random(9)
    rows = []
    for _ in range(4000):
        a = rng.choice([rng.getrandbits(64), 0, (1 << 64) - 1])
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 16)))
        rows.append((signed(a), signed(b), (a ^ b).bit_count()))
    rows += [(p, ~p, 64) for p in pivots()]
    df = spark.createDataFrame(rows, "a long, b long, bits int").select("bits", pivot_table(F.col("a")).alias("pa"), pivot_table(F.col("b")).alias("pb"))
    got = df.select("bits", not_discarded(F.col("pa"), F.col("pb"), 4).alias("stays")).collect()
    assert len(pivots()) == PIVOTS and all(r["stays"] for r in got if r["bits"] <= 4)
    assert sum(r["stays"] for r in got if r["bits"] >= 12) <= 0.1 * sum(r["bits"] >= 12 for r in got)
