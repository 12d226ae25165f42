import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import decontaminate
from tallyloom.llm.decontaminate import LeakParams, SuffixAutomaton, find_leaks, remove_leaks, write_blocks
from tallyloom.llm.queries import op4_decontaminate
from tests.llm.helpers import awkward, documents, with_clashes


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc, items, window=10):
    hit, names = set(), set()
    for name, it in items:
        if not it:
            continue
        m = min(window, len(it))
        grams = {tuple(it[i : i + m]) for i in range(len(it) - m + 1)}
        for i in range(len(doc) - m + 1):
            if tuple(doc[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                names.add(name)
    return hit, names


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=14), min_size=1, max_size=6), st.text("abcd", max_size=60), st.integers(1, 5))
def test_automaton_matches_brute_force(items, doc, window):
    items = [(str(i), [c.encode() for c in x]) for i, x in enumerate(items)]
    found, names = SuffixAutomaton(items, window).stream([c.encode() for c in doc])
    hit, want = brute([c.encode() for c in doc], items, window)
    assert {k for s, e in found for k in range(s, e)} == hit and names == want


def test_query_matches_brute_force(spark, sf_dir):
    items = [(str(r["item_id"]), words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_decontaminate(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r["contaminated"] for r in rows)
    for r in rows:
        hit, names = brute(docs[r["doc_id"]], items)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(docs[r["doc_id"]]), len(hit), len(names), sha, bool(hit))


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_blocks_give_what_one_automaton_gives(spark, sf_dir):
    docs, b = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = lambda df: sorted((r["doc_id"], r["n_words"], str(r["leak_spans"]), str(r["leak_items"])) for r in df.collect())
    many = LeakParams(block_words=100, held_blocks=3)
    assert key(find_leaks(docs, b)) == key(find_leaks(docs, b, many))
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert texts(remove_leaks(docs, b)) == texts(remove_leaks(docs, b, many)) != texts(docs)


def test_blocks_are_built_by_their_own_tasks_only(spark, sf_dir, monkeypatch):
    """A worker reads automata that are stored, however many there are, and holds a bounded number."""
    uris = write_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LeakParams(block_words=100))
    assert len(uris) > 6
    monkeypatch.setattr(SuffixAutomaton, "__init__", None)
    for uri in uris * 2:
        assert decontaminate._automaton(uri, 3).window == 10 and len(decontaminate._loaded) <= 3


def test_blocks_are_loaded_once_for_all_batches(spark, sf_dir, monkeypatch):
    p = LeakParams(block_words=100, held_blocks=3)
    uris = write_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), p)
    loads, load = [], decontaminate.open_fs
    monkeypatch.setattr(decontaminate, "open_fs", lambda uri: loads.append(uri) or load(uri))
    decontaminate._loaded.clear()
    for k in range(0, len(uris), p.held_blocks):
        for batch in range(20):
            decontaminate.matches([f"text {batch}", None], uris[k : k + p.held_blocks], p)
    assert sorted(loads) == sorted(uris)


def test_awkward_rows_and_removal(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    b = bench(spark, [(1, item), (1, item), (2, None), (3, ""), (4, "one two three"), (None, "same text here")])
    docs = with_clashes(awkward(spark))
    rows = find_leaks(docs, b).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["leak_items"] == ["4"] and [tuple(s) for s in by[4]["leak_spans"]] == [(0, 3)] and by[9]["leak_items"] == [] and [tuple(s) for s in by[9]["leak_spans"]] == [(0, 3)]
    assert find_leaks(docs, b.limit(0)).filter("size(leak_spans) > 0").count() == 0 and find_leaks(docs.limit(0), b).count() == 0
    clean = "some words before it and many after " * 3
    out = remove_leaks(documents(spark, [clean + item.upper() + ". Rest", item, clean, None, "one two three"]), b)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {0: clean.rstrip() + ". Rest", 2: clean, 3: None, 4: "one two three"}
    assert remove_leaks(docs, b).columns == docs.columns and remove_leaks(docs, b).count() == docs.count()
