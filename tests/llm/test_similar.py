import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm.similar import SimilarParams, differing_bits, drop_near_duplicates, shingle_set, similar_groups, sketch, sketch_bits, surely_linked
from tests.llm.helpers import awkward, documents, with_clashes


def test_one_of_many_near_copies_stays(spark):
    rng = random.Random(1)
    base = [f"word{rng.randint(0, 10**6)}" for _ in range(400)]
    texts = []
    for i in range(30):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(400)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"other{rng.randint(0, 10**6)}" for _ in range(100)) for _ in range(10)]
    left = [r["doc_id"] for r in drop_near_duplicates(documents(spark, texts)).select("doc_id").collect()]
    assert sorted(left) == [0, *range(30, 40)]


def brute_jaccard(texts, width=5):
    """{doc_id: smallest doc_id of its group}, from the exact similarity of all pairs of sets of shingles, at least 4/5."""
    sets, root = {}, {d: d for d in texts}
    for d, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_groups_are_those_of_exact_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = similar_groups(docs).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == brute_jaccard({r["doc_id"]: r["text"] for r in docs.collect()})


def test_links_at_the_very_similarity(spark):
    rng = random.Random(3)
    texts = []
    for kind in range(60):  # 360 of 450 shingles in common, one less, one more; short texts; repeated lines
        w = [f"k{kind}w{i}" for i in range(409)]
        texts += [" ".join(w), " ".join(w[: 364 + kind % 3 - 1] + [f"k{kind}x{i}" for i in range(45 - kind % 3 + 1)])]
        n = rng.randint(1, 12)
        texts += [" ".join(w[:n]), " ".join(w[: n - 1] if n > 1 else w)]
    line = " ".join(f"line{i}" for i in range(14))
    rest = " ".join(f"rest{i}" for i in range(40))
    texts += [f"{line} {line} {rest}", " ".join([line] * 7 + [rest]), "", None, " \n"]
    common = " ".join(f"common{i}" for i in range(120))
    texts += [f"{common} " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.choice([10, 20, 25]))) for _ in range(40)]
    got = {r["doc_id"]: r["group_id"] for r in similar_groups(documents(spark, texts)).collect()}
    assert got == brute_jaccard(dict(enumerate(texts)))


def test_drop_on_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    one = drop_near_duplicates(docs)
    assert one.columns == docs.columns
    ids = [r["doc_id"] for r in one.select("doc_id").collect()]
    # 0, 1, 2 and the row without doc_id have no words; 8, 9 and the second 8 are copies.
    assert sorted(i for i in ids if i is not None) == [i for i in range(20) if i not in (1, 2, 9)] and None not in ids
    assert drop_near_duplicates(docs.limit(0)).count() == 0 and similar_groups(docs.limit(0)).count() == 0


def test_rows_are_told_apart_by_text(spark):
    docs = documents(spark, ["a first text", "another text", "a first text", "a first text", "alone", "alone", "all one"], [1, 1, 1, 5, None, None, None])
    left = Counter((r["doc_id"], r["text"]) for r in drop_near_duplicates(docs).collect())
    assert left == Counter([(1, "a first text"), (1, "another text"), (None, "alone"), (None, "all one")])
    assert Counter((r["doc_id"], r["group_id"]) for r in similar_groups(docs).collect()) == Counter({(1, 1): 3, (5, 1): 1, (None, None): 3})


@pytest.mark.parametrize("n", [3, 40, 700, 6000])
def test_sketches_rule_out_no_link_and_call_no_other_pair_one(n):
    rng, p = np.random.default_rng(n), SimilarParams()
    for share in np.linspace(0.6, 1.0, 60):
        m = int(n * rng.uniform(0.8, 1.25)) + 1
        both = rng.integers(0, 1 << 63, int(min(n, m) * share)).astype("<u8")
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, max(0, k - len(both))).astype("<u8")])) for k in (n, m))
        same = len(np.intersect1d(a, b))
        link = 5 * same >= 4 * (len(a) + len(b) - same)
        apart = p.most_apart(len(a), len(b))
        assert link == (len(a) + len(b) - 2 * same <= apart)
        x, bits = differing_bits(*(sketch(s, sketch_bits(len(s), p)) for s in (a, b)))
        assert x <= len(a) + len(b) - 2 * same
        assert not link or x <= apart
        assert link or x > surely_linked(apart, bits, p.chance)


def test_a_larger_sketch_folds_to_the_smaller():
    s = shingle_set(" ".join(f"w{i}" for i in range(900)))
    assert differing_bits(sketch(s, 4096), sketch(s, 512)) == (0, 512)


def test_recall_by_similarity(spark):
    """Of pairs of each similarity, the share that is joined: all from 0.8 on, none below."""
    rng = random.Random(4)
    texts, of = [], {}
    for kept_words in range(300, 401, 4):
        for _ in range(4):
            base = [f"w{rng.randint(0, 10**9)}" for _ in range(404)]
            of[len(texts)] = kept_words
            texts += [" ".join(base), " ".join(base[:kept_words] + [f"w{rng.randint(0, 10**9)}" for _ in range(404 - kept_words)])]
    group = {r["doc_id"]: r["group_id"] for r in similar_groups(documents(spark, texts)).collect()}
    bins: dict[float, list[bool]] = {}
    for k in of:
        a, b = (set(shingle_set(t).tolist()) for t in texts[k : k + 2])
        bins.setdefault(len(a & b) / len(a | b) >= 0.8, []).append(group[k + 1] == k)
    assert all(bins[True]) and not any(bins[False]) and min(map(len, bins.values())) >= 30
