import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from tallyloom.llm import kneser_ney
from tallyloom.llm.kneser_ney import END, LmParams, bigram_key, discounts, log_probabilities, pack_bigrams, score_documents, texts_hashes, token_hashes, train_model, unpack_bigrams
from tallyloom.llm.queries import op7_kneser_ney
from tests.llm.helpers import awkward, documents, with_clashes


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + [None]


class Brute:
    def __init__(self, texts):
        self.c, self.uni, self.ctx, self.after, self.before = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
        for t in texts:
            prev = "<s>"
            for w in tokens(t):
                self.c[prev, w] += 1
                self.uni[w] += 1
                self.ctx[prev] += 1
                self.after[prev].add(w)
                self.before[w].add(prev)
                prev = w
        coc = lambda xs: [sum(x == k for x in xs) for k in (1, 2, 3, 4)]
        self.d, self.e = discounts(coc(self.c.values())), discounts(coc([len(x) for x in self.before.values()]))
        self.n, self.v, self.t = sum(self.uni.values()), len(self.uni), len(self.c)
        self.h = sum(self.e[min(len(x), 3)] for x in self.before.values())
        self.g = {v: sum(self.d[min(self.c[v, x], 3)] for x in xs) for v, xs in self.after.items()}

    def low(self, w):
        k = len(self.before.get(w, ()))
        return (max(k - self.e[min(k, 3)], 0) + self.h / (self.v + 1)) / self.t

    def p(self, w, v):
        if not self.ctx[v]:
            return self.low(w)
        c = self.c[v, w]
        return (max(c - self.d[min(c, 3)], 0) + self.g[v] * self.low(w)) / self.ctx[v]

    def score(self, t):
        ws = tokens(t)
        return sum(math.log10(self.p(w, v)) for v, w in zip(["<s>", *ws], ws)), sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in ws), sum(self.uni[w] > 0 for w in ws)


def test_query_matches_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    m = Brute([t for d, t in docs.items() if not held[d]])
    rows = op7_kneser_ney(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        score, base, known = m.score(docs[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens(docs[r["doc_id"]])), known, m.n)
        assert r["score"] == pytest.approx(score, rel=1e-9) and r["base_score"] == pytest.approx(base, rel=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_buckets_and_chunks_do_not_matter_and_mass_is_one(spark):
    texts = ["the cat sat on the mat", "the dog sat on the cat", "a cat and a dog and the mat", "the " * 400] * 3
    a = train_model(documents(spark, texts))
    b = train_model(documents(spark, texts).repartition(3), LmParams(chunk_tokens=40, bucket_tokens=60, hot_share=0.05))
    assert len(b.files["bigram"]) > 5
    words = np.append(np.unique(np.concatenate([token_hashes(t) for t in texts])), [np.uint64(12345)])
    for v in ("the", "cat", "never"):
        ctx = np.full(len(words), token_hashes(v)[0])
        x, _ = log_probabilities(a, ctx, words)
        y, _ = log_probabilities(b, ctx, words)
        assert np.allclose(x, y) and (10**x).sum() == pytest.approx(1)


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    c, w, n = rng.integers(0, 2**63, 500).astype("<u8") % np.uint64(40), rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(1, 2**40, 500).astype("<u8")
    back = unpack_bigrams(pack_bigrams(c, w, n))
    assert sorted(zip(c.tolist(), w.tolist(), n.tolist())) == sorted(zip(*(x.tolist() for x in back)))
    assert len(np.unique(bigram_key(c, w))) == len(set(zip(c.tolist(), w.tolist())))


def test_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    m = train_model(docs)
    rows = score_documents(docs, m).collect()
    assert len(rows) == docs.count() and all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in rows)
    none = train_model(docs.limit(0))
    assert {(r["score"], r["base_score"], r["n_known"]) for r in score_documents(docs, none).collect()} == {(0.0, 0.0, 0)}
    assert score_documents(docs.limit(0), m).count() == 0
    assert token_hashes(None).tolist() == [int(END)]


def test_no_probability_is_zero(spark):
    """Small corpora of odd counts of counts: every score is finite, and the mass of each context is one."""
    rng = np.random.default_rng(8)
    corpora = [["a"], ["a a a a a"], ["a b", "a b", "a b"], ["x y z"] * 3 + ["x x"], [""]]
    corpora += [[" ".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(rng.integers(1, 7))] * int(rng.integers(1, 4)) for _ in range(7)]
    for texts in corpora:
        m = train_model(documents(spark, texts))
        words = np.append(np.unique(np.concatenate([token_hashes(t) for t in texts])), [np.uint64(12345)])
        for v in ("a", "b", "never"):
            x, _ = log_probabilities(m, np.full(len(words), token_hashes(v)[0]), words)
            assert np.isfinite(x).all() and (10**x).sum() == pytest.approx(1), texts
    for t in ([0, 5, 0, 0], [1, 0, 0, 0], [3, 9, 1, 40], [0, 0, 0, 0], [5, 1, 9, 9]):
        assert (discounts(t)[1:] > 0).all() and (discounts(t) <= [0, 1, 2, 3]).all()


def test_hashes_of_many_texts_are_those_of_the_library():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aZé\u2003\x1c\x85\xa0\x00 \t\n\x0b\x0c\r"), rng.integers(0, 60))) for _ in range(200)]
    texts += [None, "", " ", "x" * 31, "x" * 32, "Y" * 700, *("q" * k for k in range(1, 40))]
    got, sizes = texts_hashes(pa.array(texts).slice(3))
    want = [[xxh64_intdigest(w, 42) for w in (t or "").encode().lower().split()] + [int(END)] for t in texts[3:]]
    assert got.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert [len(x) for x in texts_hashes(pa.array([], pa.string()))] == [0, 0]


def test_arrays_are_visited_once_for_many_batches(spark, monkeypatch):
    """Before, each batch of 500 rows visited every array it needed: the visits grew as rows times buckets."""
    docs = documents(spark, [f"w{i % 7} w{i % 11} w{i % 5}" for i in range(60)]).coalesce(1)
    m, calls, real = train_model(docs), [], kneser_ney.log_probabilities
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        batches = docs.mapInArrow(lambda bs: bs, docs.schema).toArrow().to_batches(5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    monkeypatch.setattr(kneser_ney, "log_probabilities", lambda *a: calls.append(1) or real(*a))
    out = list(kneser_ney.scorer(m)(iter(batches)))
    assert len(batches) > 10 and len(calls) == 1 and sum(b.num_rows for b in out) == 60
