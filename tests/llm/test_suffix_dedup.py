import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import suffix_dedup
from tallyloom.llm.common import gathered
from tallyloom.llm.queries import op12_suffix_dedup
from tallyloom.llm.suffix_dedup import SIZE, SuffixParams, common_prefixes, cut_repeats, least_ids, pieces, string_hashes, suffix_order

from .helpers import DOCUMENTS, awkward, with_clashes


def plain(rows):
    """(id, bytes, removed spans, rest) of each row: a table of every string and its least id."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - SIZE + 1):
            s = b[k : k + SIZE]
            if i is not None and least.get(s, i) >= i:
                least[s] = i
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - SIZE + 1):
            if i is not None and least[b[k : k + SIZE]] < i:
                gone[k : k + SIZE] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        spans = [(int(a), int(z)) for a, z in zip(edges[::2], edges[1::2])]
        out.append((i, len(b), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in df.collect()), key=repr)


def words_of(text):
    words = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | text[k : len(text) - 7 + k]
    return words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=90).map(str.encode), min_size=1, max_size=5))
def test_order_and_prefixes(parts):
    """Every suffix, or every second one, in the order of plain sorting as far as SIZE bytes."""
    text = np.frombuffer(b"\xff".join(parts) + b"\xff" * (SIZE + 16), np.uint8)
    whole, n = text.tobytes(), len(text) - SIZE - 16
    for each in (1, 2):
        wanted = np.zeros(len(text), bool)
        wanted[:n:each] = True
        wanted &= text != 255
        order = suffix_order(text, wanted, words_of(text))
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        cut = [whole[i : i + SIZE] for i in order]
        assert cut == sorted(cut)
        lcp = common_prefixes(order, words_of(text))
        for a, b, k in zip(cut, cut[1:], lcp[1:]):
            assert k == next((j for j in range(SIZE) if a[j] != b[j]), SIZE)


def test_hashes_depend_on_the_string_alone():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 16, 31, 50, 64):
        s = rng.integers(0, 4, size, dtype=np.uint8)
        a, b = (np.concatenate([rng.integers(0, 4, k, dtype=np.uint8), s, rng.integers(0, 4, 9, dtype=np.uint8)]) for k in (5, 40))
        ha, hb = string_hashes(a, size), string_hashes(b, size)
        assert len(ha) == len(a) - size + 1 and ha[5] == hb[40]
        strings = {a[i : i + size].tobytes(): h for i, h in enumerate(ha)}
        assert len(set(strings.values())) == len(strings)
    assert len(string_hashes(np.zeros(3, np.uint8), 4)) == 0


def test_pieces_hold_every_window_once():
    rng = random.Random(1)
    texts = [b"x" * 49, b"", b"x" * 50, b"x" * 500, bytes(rng.choices(b"abcdef ", k=3000)), b"y", bytes(rng.choices(b"ab", k=51))]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    a, first, n, mark = pieces(np.frombuffer(b"".join(texts), np.uint8), starts, ends)
    assert [i for s, k in zip(first, n) for i in range(s, s + k)] == [i for s, e in zip(starts, ends) for i in range(s, e - SIZE + 1)]
    assert n.max() <= SIZE and (n > 0).all()
    alone = pieces(np.frombuffer(texts[4], np.uint8), np.array([0]), np.array([3000]))
    at = np.searchsorted(first, starts[4])
    for whole, one in zip((a, first - starts[4], n, mark), alone):
        assert whole[at : at + len(one)].tolist() == one.tolist()


def test_least_ids():
    rng = random.Random(5)
    passage = bytes(rng.choices(b"abc ", k=80))
    strings = [passage, b"zz" + passage[:60] + b"q" * 20, b"a" * 120, passage[10:75]]
    ids = np.array([7, 3, 5, 9])
    got, windows = least_ids(strings, ids)
    want = []
    for s in strings:
        for k in range(len(s) - SIZE + 1):
            want.append(min(i for i, t in zip(ids, strings) if s[k : k + SIZE] in t))
    assert got.tolist() == want and windows.tolist() == [len(s) - SIZE + 1 for s in strings]


def _corpus(n=160):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeéx漢", k=rng.randint(2, 7))) for _ in range(80)]
    prose = lambda k: " ".join(rng.choices(vocab, k=k))
    shared = [prose(14) for _ in range(4)]
    rows = []
    for i in range(n):
        t = prose(rng.randint(5, 90))
        if i % 3 == 0:
            t += shared[i % 4] + prose(9)
        if i % 10 == 1:
            t = shared[0][:49 + i % 3] + t
        if i % 17 == 2:
            t = rows[rng.randrange(len(rows))][1]
        rows.append((i * 37 % 1000, t))
    return [*rows, (4000, "ab" * 300), (4001, "x" + "ab" * 40), (3, "y" * 700), (5, "y" * 60 + "z"), (5, "y" * 60 + "z"), (None, rows[0][1]), (None, "y" * 80), (9000, None), (9001, "")]


@pytest.mark.parametrize("p", [SuffixParams(), SuffixParams(block_bytes=3000, sort_bytes=2000), SuffixParams(block_bytes=5000, hot_pieces=1)], ids=["one block each", "small blocks", "all hot"])
def test_equals_plain_search(spark, p):
    rows = _corpus()
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCUMENTS).repartition(3)
    assert shown(cut_repeats(df, p)) == plain(rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert shown(cut_repeats(df)) == plain(rows)
    clashes = with_clashes(df)
    for c in ("kept", "removed", "block", "anchor", "texts", "ids"):
        from pyspark.sql import functions as F

        clashes = clashes.withColumn(c, F.lit("clash"))
    assert shown(cut_repeats(clashes)) == plain(rows)
    assert cut_repeats(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, n - len(rest), len(spans), sha256(rest).hexdigest()) for i, n, spans, rest in plain(rows)}
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in op12_suffix_dedup(spark, sf_dir).collect()}
    assert got == want
    assert any(v[1] for v in want.values())


def test_a_block_sends_few_messages_however_many_sorts(spark, monkeypatch):
    """Before, each block sent a message to each sort, and each of them was a batch by itself."""
    sent, real, rows = [], suffix_dedup._cut, _corpus()
    monkeypatch.setattr(suffix_dedup, "_FEW", 1)
    monkeypatch.setattr(suffix_dedup, "_cut", lambda *a: sent.append(a) or real(*a))
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCUMENTS).repartition(3)
    assert shown(cut_repeats(df, SuffixParams(block_bytes=4000, sort_bytes=700))) == plain(rows)
    ((tasks, parts),) = sent
    assert parts == 8 and 1 < tasks < 30
    schema = pa.schema([("k", pa.int32()), ("blob", pa.binary())])
    assert [b.num_rows for b in gathered(((k, b"x" * 100) for k in range(1200)), schema)] == [500, 500, 200]
    assert [b.num_rows for b in gathered(((k, b"x" * 100) for k in range(5)), schema, bytes_most=150)] == [2, 2, 1]
    assert list(gathered([], schema)) == []
