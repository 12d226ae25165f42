"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark's items (ASCII capitals lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) go into blocks of
bounded size; each block becomes one automaton of all substrings of its items. A document's words stream through it; the
state and the longest matching length after each word tell which windows end there: `window` consecutive words of an
item, or a whole item of fewer words. Words inside a window are hit; runs of hit words are spans.

Blocks. A Spark job builds each block's automaton and writes it to a file in the shared folder. Documents stream past
`held_blocks` of them at a time, which a task loads once and keeps; with more blocks than that the documents, with what was
found so far, are written and stream past the next ones. So a block is loaded once for each task however many batches
it meets, and memory is bounded however large the benchmark is.

Cases. Null or empty text has no words and no spans. Items without words match nothing. Items with the same item_id
count once, null item_ids are not listed but their words are hit. An empty benchmark hits nothing. Repeated rows: a
row each. Very long texts are streamed whole. Other columns are ignored by find_leaks; remove_leaks keeps them,
and null texts as they are.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type

from tallyloom.llm.common import kept, open_fs, record_batch, shared_dir, text_of, write_bytes

#: Bytes outside [0-9A-Za-z\x80-\xff] to a space, capitals to small letters: then bytes.split gives the words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class LeakParams:
    window: int = 10
    #: Spans of at least so many words are removed, and documents go whole if more than this share of their words is in spans.
    min_span: int = 10
    max_coverage: float = 0.8
    block_words: int = 100_000
    held_blocks: int = 4


def words_of(text: str | None) -> list[bytes]:
    return text_of(text).translate(_TABLE).split()


class SuffixAutomaton:
    """All substrings of several word sequences; built left to right, states split as in the usual construction."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for i, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        holders: list[set] = [set() for _ in self.next]
        whole: list[list] = [[] for _ in self.next]
        for key, (item, codes) in enumerate(coded):
            state = 0
            for c in codes:
                state = self.next[state][c]
                at = state
                while at > 0 and self.length[at] >= window and key not in holders[at]:
                    holders[at].add(key)
                    at = self.link[at]
            if len(codes) < window:
                whole[state].append((len(codes), key))
        self.names = [i for i, _ in coded]
        # What ends at a state: the items that hold its suffix of `window` words, and short items among its suffixes.
        self.at_window = [-1] * len(self.next)
        self.short: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = self.at_window[up] if self.length[up] >= window else s
            self.short[s] = (*whole[s], *self.short[up])
        self.holders = [tuple(h) for h in holders]
        self.least = [min([window] * (self.length[s] >= window) + [m for m, _ in self.short[s]], default=1 << 60) for s in range(len(self.next))]

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, q)
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.length[last] + 1), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The (start, end) of all windows in the order of their ends, and the items found."""
        code, nxt, link, length, least = self.vocab.get, self.next, self.link, self.length, self.least
        state, n, found, items = 0, 0, [], set()
        for i, c in enumerate(map(code, words)):
            if c is None:
                state = n = 0
                continue
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least[state]:
                if n >= self.window:
                    items.update(self.holders[self.at_window[state]])
                    found.append((i + 1 - self.window, i + 1))
                for m, key in self.short[state]:
                    if m <= n:
                        items.add(key)
                        found.append((i + 1 - m, i + 1))
        return found, {self.names[k] for k in items}


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def write_blocks(benchmark: DataFrame, p: LeakParams) -> list[str]:
    """The URIs of the files with the blocks' automata, in order. The driver sees their names only."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.length("text") > 0)
    # A word takes two bytes at least, with the white space after it.
    n = int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"] // (6 * p.block_words)) + 1
    path = shared_dir(benchmark.sparkSession, "benchmark")
    schema = pa.schema([("block", pa.int32()), ("uri", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def flush():
            uri = f"{path}/{block}-{uuid.uuid4().hex}.automaton"
            write_bytes(uri, pickle.dumps(SuffixAutomaton(held, p.window), protocol=5))
            return record_batch({"block": [block], "uri": [uri]}, schema)

        for b in batches:
            for k, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != block and held:
                    yield flush()
                    held = []
                block = k
                held.append((i, words_of(t)))
        if held:
            yield flush()

    placed = items.select(F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int").alias("block"), "item", "text")
    rows = placed.repartition(n, "block").sortWithinPartitions("block").mapInArrow(write, "block int, uri string").collect()
    return [r["uri"] for r in sorted(rows, key=lambda r: r["block"])]


_loaded: OrderedDict[str, SuffixAutomaton] = OrderedDict()


def _automaton(uri: str, held_blocks: int) -> SuffixAutomaton:
    """As the block's task has stored it; a worker builds none."""
    if uri not in _loaded:
        while len(_loaded) >= held_blocks:
            _loaded.popitem(last=False)
        where, path = open_fs(uri)
        with where.open_input_stream(path) as f:
            _loaded[uri] = pickle.loads(f.read())
    _loaded.move_to_end(uri)
    return _loaded[uri]


def matches(texts: list[str | None], uris: list[str], p: LeakParams) -> tuple[list[list], list[set]]:
    """The windows found in each text, and the items. uris: held_blocks at most."""
    spans, items = [[] for _ in texts], [set() for _ in texts]
    for uri in uris:
        auto = _automaton(uri, p.held_blocks)
        for k, t in enumerate(texts):
            found, names = auto.stream(words_of(t))
            spans[k] += found
            items[k] |= names
    return spans, items


#: What the earlier blocks have found, beside the documents' own columns.
_FOUND = "spans of earlier blocks"
_SPANS = pa.list_(pa.list_(pa.int64()))
_SO_FAR = pa.struct([("spans", _SPANS), ("items", pa.list_(pa.string()))])


def _past_blocks(docs: DataFrame, uris: list[str], p: LeakParams, last: Callable, out: T.StructType) -> DataFrame:
    """docs past all blocks; last(batch, spans, items) makes the rows of a batch of what all have found."""

    def so_far(b: pa.RecordBatch, group: list[str]) -> tuple[list[list], list[set]]:
        spans, items = matches(b.column("text").to_pylist(), group, p)
        if _FOUND in b.schema.names:
            for k, x in enumerate(b.column(_FOUND).to_pylist()):
                spans[k] += map(tuple, x["spans"])
                items[k].update(x["items"])
        return spans, items

    def some(group: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans, items = so_far(b, group)
                found = pa.array([{"spans": [list(x) for x in s], "items": list(i)} for s, i in zip(spans, items, strict=True)], _SO_FAR)
                have = [n for n in b.schema.names if n != _FOUND]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in have], found], names=[*have, _FOUND])

        return run

    def finish(group: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans, items = so_far(b, group)
                yield from last(b.drop_columns([_FOUND]) if _FOUND in b.schema.names else b, spans, items)

        return run

    groups = [uris[k : k + p.held_blocks] for k in range(0, len(uris), p.held_blocks)] or [[]]
    with_found = T.StructType([*docs.schema.fields, T.StructField(_FOUND, from_arrow_type(_SO_FAR))])
    for group in groups[:-1]:
        docs = kept(docs.mapInArrow(some(group), with_found), "past-blocks")
    return docs.mapInArrow(finish(groups[-1]), out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, n_words, leak_spans (array of half-open word ranges, disjoint, in order) and leak_items (sorted item_ids as strings)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("leak_spans", pa.list_(span)), ("leak_items", pa.list_(pa.string()))])

    def rows(b: pa.RecordBatch, spans: list[list], items: list[set]) -> Iterator[pa.RecordBatch]:
        yield record_batch({
            "doc_id": b.column("doc_id").to_pylist(), "n_words": [len(words_of(t)) for t in b.column("text").to_pylist()], "leak_spans": [[{"start": s, "end": e} for s, e in _merge(x)] for x in spans],
            "leak_items": [sorted(i for i in x if i is not None) for x in items],
        }, schema)

    return _past_blocks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), write_blocks(benchmark, p), p, rows, from_arrow_schema(schema))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """The documents without their leaked spans of min_span words or more; those covered by more than max_coverage go whole.

    Short items (fewer words than min_span) don't count for removal: a few common words are no leak. All columns stay.
    """
    def cleaned(t: str, found: list) -> str | None:
        cut = [x for x in _merge([x for x in found if x[1] - x[0] >= p.window]) if x[1] - x[0] >= p.min_span]
        if not cut:
            return t
        places = [m.span() for m in _WORD.finditer(t)]
        if sum(e - s for s, e in cut) > p.max_coverage * len(places):
            return None
        out, end = [], 0
        for s, e in cut:
            out.append(t[end : places[s][0]].rstrip(" "))
            end = places[e - 1][1]
        return "".join([*out, t[end:]])

    def rows(b: pa.RecordBatch, spans: list[list], _: list[set]) -> Iterator[pa.RecordBatch]:
        at = b.schema.get_field_index("text")
        texts = b.column(at).to_pylist()
        clean = [t if t is None else cleaned(t, x) for t, x in zip(texts, spans, strict=True)]
        stay = pa.array([t is None or c is not None for t, c in zip(texts, clean, strict=True)], pa.bool_())
        yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type)).filter(stay)

    return _past_blocks(docs, write_blocks(benchmark, p), p, rows, docs.schema)
