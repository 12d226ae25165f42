"""Runs: maximal stretches of words that repeat with a period, by the tandem repeats of each text.

A run of smallest period q has q words that come back at least `exponent` times in all, and at least `length` words; no
neighbouring word goes on with the period. A text is handled alone, by a task that holds a batch of texts:

1. A word of such a run after its first period stands at most q words behind an equal one. Stretches too short for that, at
   every power of two of q, hold no run and are left out; most texts have none to look at.
2. What is left, joined with marks that equal nothing, is sorted by suffixes (ranks of 1, 2, 4, ... words, which also give
   the longest common extensions of any two places, forwards and backwards). This stands for the suffix tree:
   equal ranks are a node, intervals of the order the leaves below it.
3. Lempel-Ziv blocks: each is the longest stretch that also begins earlier. The leftmost occurrence of a square has its
   centre in a block and ends in it or the next one, so extensions around the blocks' edges find squares that cover all
   leftmost ones: one test for each block and period up to its size.
4. From each of them with a primitive root the walk to the next suffix goes on while the next word closes the square, until
   the root has turned once. These are all kinds of squares with a primitive root.
5. The interval of each kind has its occurrences. Neighbouring ones of one period are a run.

Steps 2 to 5 take time in proportion to the words left times the logarithm of their number, and a few arrays of that
size for each power of two. Words themselves are held as Python strings, so a task needs about twelve times the size of its
longest text, or of a batch.

Words are `[^\\x20\\x09-\\x0D]+`. Cases. Null, empty and blank texts: no words, no runs, collapsed to the empty text. Equal
rows each get their row. Null doc_ids are kept. Other columns are neither read nor returned. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tallyloom.llm.common import record_batch, tuned

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


@dataclass(frozen=True)
class RunParams:
    length: int = 6
    exponent: int = 4
    #: Words of a batch's texts that are looked at together, about.
    words_at_once: int = 1_000_000


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def candidates(x: np.ndarray, starts: np.ndarray, p: RunParams) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [low, high) of texts that lie one after another (the first word of each in starts) that hold all runs whole."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    back = np.full(n, n, np.int64)
    same = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    back[order[same + 1]] = order[same + 1] - order[same]
    sizes = np.diff(starts, append=n)
    first = np.repeat(starts, sizes)
    back[np.arange(n) - back < first] = n
    lows, highs, q = [], [], 1
    longest = sizes.max(initial=0)
    while p.exponent * q <= longest:
        low, high = _stretches(back < 2 * q)
        use = high - low >= max((p.exponent - 1) * q, p.length - 2 * q + 1)
        lows.append(np.maximum(low[use] - 2 * q + 1, first[low[use]]))
        highs.append(high[use])
        q *= 2
    if not lows or not sum(map(len, lows)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = np.concatenate(lows), np.concatenate(highs)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] >= high[:-1]) | (first[low[1:]] != first[low[:-1]])
    heads = np.flatnonzero(new)
    return low[heads], high[np.append(heads[1:], len(low)) - 1]


class Suffixes:
    """The order of the suffixes of a sequence whose last item is found nowhere else, and extensions of its places."""

    def __init__(self, x: np.ndarray):
        self.n = n = len(x)
        self.ranks = [np.unique(x, return_inverse=True)[1].astype(np.int32)]
        width = 1
        while True:
            rank = self.ranks[-1]
            then = np.full(n, -1, np.int64)
            then[: n - width] = rank[width:]
            key = rank.astype(np.int64) * (n + 1) + then + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int32))))
            if rank[order[-1]] == n - 1:
                break
            self.ranks.append(rank)
            width *= 2
        self.order, self.rank = order, rank
        shared = self.forward(order[1:], order[:-1])
        #: The least common prefix of 1, 2, 4, ... neighbours in order, from each one on.
        self.prefixes = [np.concatenate(([0], shared)).astype(np.int32)]
        while 2 << len(self.prefixes) <= 2 * n:
            half, last = 1 << (len(self.prefixes) - 1), self.prefixes[-1]
            if half >= len(last):
                break
            self.prefixes.append(np.minimum(last[:-half], last[half:]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The words that are equal from i and from j on."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = i + out, j + out
            inside = (a < self.n) & (b < self.n)
            rank = self.ranks[level]
            out += (inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])).astype(np.int64) << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The words that are equal up to i and up to j."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = i - out - (1 << level) + 1, j - out - (1 << level) + 1
            inside = (a >= 0) & (b >= 0)
            rank = self.ranks[level]
            out += (inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])).astype(np.int64) << level
        return out

    def interval(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the order whose suffixes begin with the `size` words at i."""
        low = self.rank[i].astype(np.int64)
        high = low.copy()
        for level in range(len(self.prefixes) - 1, -1, -1):
            t, width = self.prefixes[level], 1 << level
            at = low - width + 1
            low -= np.where((at >= 0) & (t[np.clip(at, 0, len(t) - 1)] >= size), width, 0)
            at = high + 1
            high += np.where((at < len(t)) & (t[np.clip(at, 0, len(t) - 1)] >= size), width, 0)
        return low, high + 1

    def earlier(self) -> np.ndarray:
        """For each place the most words from there on that also stand from an earlier place on."""
        best = np.zeros(self.n, np.int64)
        for along in (self.order, self.order[::-1]):
            near = np.full(self.n, -1, np.int64)
            stack: list[int] = []
            for i in along.tolist():
                while stack and stack[-1] > i:
                    stack.pop()
                if stack:
                    near[i] = stack[-1]
                stack.append(i)
            have = np.flatnonzero(near >= 0)
            best[have] = np.maximum(best[have], self.forward(have, near[have]))
        return best


def blocks(earlier: np.ndarray) -> np.ndarray:
    """The first places of the Lempel-Ziv blocks."""
    out, at = [], 0
    size = earlier.tolist()
    while at < len(size):
        out.append(at)
        at += max(1, size[at])
    return np.array(out, np.int64)


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 .. n of every n, and the place of that n."""
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + 1, owner


def covering_squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares; every kind of square has its leftmost occurrence at one of them or as many words
    behind it as its run goes on."""
    start = blocks(s.earlier())
    size = np.diff(start, append=s.n)
    found = []
    # centre and left end in the block, right end in the next
    k, b = _each(size[:-1])
    h1 = start[1:][b]
    q = h1 - k
    ahead, back = s.forward(h1, q), s.backward(h1 - 1, q - 1)
    ok = (ahead + back >= k) & (ahead > 0)
    found.append((np.maximum(q - back, q - k + 1)[ok], k[ok]))
    # left end before the block, centre in it
    k, b = _each(size + np.append(size[1:], 0))
    h = start[b]
    q = h + k
    use = q < s.n
    k, b, h, q = k[use], b[use], h[use], q[use]
    ahead, back = s.forward(h, q), s.backward(h - 1, q - 1)
    at = np.maximum(h - back, h - k + 1)
    ok = (ahead + back >= k) & (ahead > 0) & (back > 0) & (at + k <= h + size[b])
    found.append((at[ok], k[ok]))
    at, k = (np.concatenate(c) for c in zip(*found, strict=True))
    both = np.unique(k * s.n + at)
    return both % s.n, both // s.n


def _least_prime(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            out[p * p :: p] = np.minimum(out[p * p :: p], p)
    return out


def primitive(s: Suffixes, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k words at a place are no repetition of fewer."""
    ok, rest = np.ones(len(k), bool), k.copy()
    if not len(k):
        return ok
    least = _least_prime(int(k.max()))
    while True:
        live = np.flatnonzero(ok & (rest > 1))
        if not len(live):
            return ok
        prime = least[rest[live]]
        part = k[live] // prime
        ok[live] = s.forward(at[live], at[live] + part) < k[live] - part
        rest[live] //= prime


def squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """All squares with a primitive root: places and periods, by period, then place."""
    at, k = covering_squares(s)
    ok = primitive(s, at, k)
    at, k = at[ok], k[ok]
    turns = np.minimum(s.forward(at, at + k) - k + 1, k)
    step, owner = _each(turns)
    at, k = at[owner] + step - 1, k[owner]
    low, high = s.interval(at, 2 * k)
    _, one = np.unique(np.stack([k, low]), axis=1, return_index=True)
    k, low, high = k[one], low[one], high[one]
    step, owner = _each(high - low)
    at, k = s.order[low[owner] + step - 1], k[owner]
    order = np.lexsort((at, k))
    return at[order], k[order]


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs with two periods or more, by period and start. The last item is found nowhere else."""
    at, k = squares(Suffixes(x))
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(at)) - 1 if len(at) else heads
    return at[heads], at[last] + 2 * k[heads] - at[heads], k[heads]


def _of_texts(texts: list[list[str]], p: RunParams) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    number = _Numbers()
    x = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    starts = (np.cumsum(sizes) - sizes)[some]
    lows, highs = candidates(x, starts, p)
    k = 0
    while k < len(lows):
        end = k + max(1, int(np.searchsorted(np.cumsum(highs[k:] - lows[k:]), p.words_at_once)))
        low, high = lows[k:end], highs[k:end]
        size = high - low + 1
        step, part = _each(size)
        joined = np.where(step == size[part], -1 - part, x[np.minimum(low[part] + step - 1, len(x) - 1)])
        first = np.cumsum(size) - size
        at, length, period = runs_of(joined)
        use = length >= np.maximum(p.length, p.exponent * period)
        at, length, period = at[use], length[use], period[use]
        part = np.searchsorted(first, at, "right") - 1
        at += low[part] - first[part]
        doc = np.searchsorted(starts, at, "right") - 1
        for d, a, n, q in sorted(zip(some[doc].tolist(), (at - starts[doc]).tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[1], r[3])):
            out[d].append((a, n, q))
        k = end
    return out


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """What is left when each run keeps its first period."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return " ".join(words)


def _found(p: RunParams):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_WORD.findall(t or "") for t in b.column("text").to_pylist()]
            runs = _of_texts(texts, p)
            yield record_batch({
                "doc_id": b.column("doc_id"), "n_words": [len(t) for t in texts],
                "runs": [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], "collapsed": [_collapsed(t, r) for t, r in zip(texts, runs, strict=True)],
            }, _OUT)

    return found


def periodic_runs(docs: DataFrame, p: RunParams = RunParams()) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text with each run's first period only."""
    tuned(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_found(p), from_arrow_schema(_OUT))
