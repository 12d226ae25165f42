import re
import zlib
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm.periodic_runs import RunParams, Suffixes, _of_texts, blocks, periodic_runs, runs_of, squares
from tallyloom.llm.queries import op13_periodic_runs

from .helpers import DOCUMENTS, awkward, documents, with_clashes


def plain_runs(x, length=6, exponent=4):
    """(start, length, period) of all runs, each period and stretch tried."""
    out, n = [], len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j + q - i
            if size >= max(length, exponent * q) and not any(all(x[t] == x[t + d] for t in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


SEQUENCES = st.one_of(
    st.lists(st.integers(0, 1), max_size=60), st.lists(st.integers(0, 2), max_size=60),
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 12), st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9)).map(lambda t: t[2] + (t[0] * t[1])[: len(t[0]) * t[1] - len(t[3]) % 3] + t[3]),
)


@settings(max_examples=400, deadline=None)
@given(SEQUENCES)
def test_all_squares_and_runs(x):
    end = np.array([*x, -1])
    s = Suffixes(end)
    suffixes = [tuple(end[i:]) for i in s.order]
    assert suffixes == sorted(suffixes)
    want = {(i, k) for k in range(1, len(x) // 2 + 1) for i in range(len(x) - 2 * k + 1) if x[i : i + k] == x[i + k : i + 2 * k] and not any(k % d == 0 and x[i : i + k] == x[i : i + d] * (k // d) for d in range(1, k))}
    assert set(zip(*(c.tolist() for c in squares(s)))) == want
    assert sorted(zip(*(c.tolist() for c in runs_of(end)))) == sorted(plain_runs(x, 2, 2))


@settings(max_examples=200, deadline=None)
@given(st.lists(SEQUENCES, max_size=6), st.sampled_from([RunParams(), RunParams(words_at_once=20), RunParams(length=2, exponent=2), RunParams(length=9, exponent=3)]))
def test_texts_together(xs, p):
    texts = [[str(w) for w in x] for x in xs]
    assert _of_texts(texts, p) == [plain_runs(t, p.length, p.exponent) for t in texts]


def test_blocks():
    assert blocks(Suffixes(np.array([1, 2, 1, 2, 1, 3, 1, -1])).earlier()).tolist() == [0, 1, 2, 5, 6, 7]


def test_long_texts_take_little():
    """Periods of half a million words, one word alone, and prose: no work in the square of the size."""
    rng = np.random.default_rng(1)
    unit = [str(i) for i in rng.integers(0, 5000, 20_000)]
    prose = [str(i) for i in rng.zipf(1.3, 100_000) % 3000]
    got = _of_texts([["a"] * 200_000, unit * 5, prose], RunParams())
    assert got[0] == [(0, 200_000, 1)] and got[1] == [(0, 100_000, 20_000)]
    assert all(n >= max(6, 4 * q) for _, n, q in got[2])


def test_awkward_rows(spark):
    texts = ["a a a a a a", "x a b a b a b a b y", "a a a a a", "r s r s r s r s r s r s r s r s t t t t t t", "p q " * 5 + "q " * 7, "u" * 100 + " v" * 40]
    df = documents(spark, texts, ids=range(100, 106)).unionByName(awkward(spark))
    want = []
    for r in df.collect():
        w = words_of(r["text"])
        runs = plain_runs(w) if len(w) < 500 else [(0, len(w), 1)] if len(set(w)) == 1 else []
        want.append((r["doc_id"], len(w), runs, plain_collapsed(w, runs)))
    shown = lambda d: sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in d.collect()), key=repr)
    assert shown(periodic_runs(df)) == sorted(want, key=repr)
    assert shown(periodic_runs(with_clashes(df).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2)))) == sorted(want, key=repr)
    assert periodic_runs(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_query(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = words_of(r["text"])
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        x = {t: i for i, t in enumerate(dict.fromkeys(w))}
        runs = plain_runs_fast(np.array([x[t] for t in w]))
        best = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r["doc_id"]] = (len(runs), *top, sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), sha256(plain_collapsed(w, runs).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert got == want
    assert any(v[0] for v in want.values())


def plain_runs_fast(x, length=6, exponent=4):
    """plain_runs for longer texts: every period, compared in arrays; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(x) // exponent + 1):
        edge = np.diff((x[q:] == x[:-q]).astype(np.int8), prepend=0, append=0)
        for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()):
            if b - a + q >= max(length, exponent * q):
                found.setdefault((a, b + q), q)
    return sorted(((a, e - a, q) for (a, e), q in found.items()), key=lambda r: (r[0], r[2]))
