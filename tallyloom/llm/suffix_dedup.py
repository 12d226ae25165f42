"""Removal of byte strings of 50 bytes that also start in a document with a smaller id, by suffix arrays.

Equal strings are brought together first, then sorted:

1. Documents are packed into blocks of `block_bytes`, written once. Every window of 50 bytes has an anchor: the least hash
   among its strings of `ANCHOR` bytes. Equal windows have equal anchors. Neighbouring windows mostly share theirs, so a
   text falls into pieces, each a run of windows of one anchor.
2. An anchor that one piece of the corpus has alone has no repeated window. Blocks send their sorted anchors, cut to the
   bits that the input's size needs, to slots of the range of hashes; each slot sends back which ones are not alone.
3. The pieces of the other anchors, each distinct one once a block with the least id that has it, meet by anchor. Where
   an anchor has more than `hot_pieces` pieces they are cut into single windows first, which meet by their own hash, so no
   anchor is too large for a task. Equal windows meet either way, and one block sends each but once.
4. A task sorts the suffixes of its pieces in two stages: those smaller than their successor are sorted directly, the others
   are induced from them by one scan of the buckets of first bytes. Common prefixes of neighbours in that order tell the
   groups of equal windows, and a group's least id goes back to the blocks that have a larger one.
5. Blocks mark what repeats, and cut it.

Hashes decide what meets, and within a block which pieces are one (by two of 64 bits); across blocks bytes are compared. Order
and prefixes are computed up to `SIZE` bytes, as more is
never asked. Texts are read whole; matches never cross documents, nor does one within a document alone count.

Cases. Null text: as empty. Texts of fewer than 50 bytes stay whole. Rows with equal ids aren't smaller than each other, so
they don't remove each other's strings. Null ids are after all others: they remove nothing, and nothing is removed from
them. A cut may part a character, so kept texts are bytes. Other columns are not returned. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tallyloom.llm.common import gathered, kept, mix64, record_batch, text_of, tuned
from tallyloom.llm.kneser_ney import pack, unpack

SIZE = 50
ANCHOR = 16
_LAST = np.iinfo(np.int64).max
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_BYTES = mix64(np.arange(1, 257, dtype=_U))
_FACTORS = mix64(np.arange(301, 364, dtype=_U)) | _U(1)
#: A block sends a message to each slot and to each task, so there are no more of these than the input or this number asks for, and a task sorts up to so many parts.
_FEW, _PARTS = 200, 8
#: Bytes that are hashed at once, about: what numpy makes of them stays in a processor's cache.
_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class SuffixParams:
    #: Bytes of text in a block, about; a longer text is a block by itself. Raise it with the executors' memory and the input: blocks times slots is the number of messages.
    block_bytes: int = 4 << 20
    #: Anchors that a slot compares, about.
    slot_anchors: int = 4_000_000
    #: Bytes of pieces whose suffixes are sorted at once, about.
    sort_bytes: int = 2 << 20
    #: Pieces of one anchor that go to one task as they are.
    hot_pieces: int = 30_000


# ---- hashes and pieces


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    out = np.empty(max(0, len(text) - 7), _U)
    for k in range(min(8, len(out))):
        n = len(out[k::8])
        out[k::8] = text[k : k + 8 * n].view("<u8")
    return out


def string_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of every string of so many bytes: a sum of its words, the last of which may overlap, each with a factor of its own."""
    n = max(0, len(text) - size + 1)
    if size < 8:
        power = _BYTES[text]
        parts = [power[k : k + n] for k in range(size)]
    else:
        words = _words(np.ascontiguousarray(text))
        parts = [words[k : k + n] for k in [*range(0, size - 8, 8), size - 8]]
    h = parts[0] * _FACTORS[0]
    for part, factor in zip(parts[1:], _FACTORS[1:]):
        h += part * factor
    h ^= h >> _U(32)
    h *= _MUL
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """The least of the hashes of each window."""
    have, want = 1, SIZE - ANCHOR + 1
    while 2 * have <= want:
        h, have = np.minimum(h[:-have], h[have:]), 2 * have
    rest = want - have
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def pieces(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that lie one after another in a text: anchor, first window, windows and content hash of each piece, a run
    of windows of one anchor, SIZE windows at most."""
    if len(text) < SIZE:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    grams = string_hashes(text, ANCHOR)
    a = _least(grams)
    long = ends - starts >= SIZE
    first, last = starts[long], ends[long] - SIZE + 1
    edge = np.zeros(len(a) + 1, np.int8)
    edge[first] = 1
    edge[last] = -1
    inside = np.cumsum(edge, dtype=np.int8)[:-1] > 0
    new = edge[:-1] != 0
    new[0] = True
    new[1:] |= a[1:] != a[:-1]
    heads = np.flatnonzero(new)
    n = np.diff(heads, append=len(a))[inside[heads]]
    heads = heads[inside[heads]]
    parts = -(-n // SIZE)
    done = SIZE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    at, n = np.repeat(heads, parts) + done, np.minimum(np.repeat(n, parts) - done, SIZE)
    # What a piece's first and last window hold is asked of these alone, from the hashes of their parts.
    last = at + n - 1
    mark = n.astype(_U)
    for k, from_ in enumerate([*range(0, SIZE - ANCHOR, ANCHOR), SIZE - ANCHOR]):
        mark += grams[at + from_] * _FACTORS[2 * k] + grams[last + from_] * _FACTORS[2 * k + 1]
    return a[at], at, n, mix64(mark)


# ---- suffix sorting


def _next_true(mask: np.ndarray) -> np.ndarray:
    """The first place from i on where mask holds."""
    return np.minimum.accumulate(np.where(mask, np.arange(len(mask)), len(mask))[::-1])[::-1]


def _spread(places: np.ndarray, by: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Places in their order to the lists of their bytes."""
    if len(places):
        order = np.argsort(by, kind="stable")
        places, by = places[order], by[order]
        cuts = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
        for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
            into[by[a]].append(places[a:b])


def _sort_directly(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places ordered by the bytes from each on, as far as SIZE: eight at a time, ties only."""
    key = words[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    for at in range(8, SIZE, 8):
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
        if not len(tied):
            break
        key = words[places[tied] + at]
        order = np.lexsort((key, group[tied]))
        places[tied], key, g = places[tied][order], key[order], group[tied]
        new[tied] |= np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])))
    return places


def suffix_order(text: np.ndarray, wanted: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The wanted places of a text in the order of their suffixes, compared as far as SIZE bytes. A byte larger than all
    others ends every piece and the text.

    Two stages: a suffix that is smaller than its successor is sorted directly. Each other one has a smaller successor
    with a first byte no larger, and comes behind the equally beginning ones that were met earlier in the scan of all
    buckets in order, so the scan puts it in place. Unwanted suffixes take part only where a wanted one is induced from them."""
    step = np.sign(np.diff(text.astype(np.int16), append=0))
    turn = _next_true(step != 0)
    direct = np.concatenate((step, [-1]))[turn] > 0
    need = wanted.copy()
    last = np.flatnonzero(wanted & ~np.concatenate((wanted[1:], [False])))
    ends = _next_true(direct)[last]
    reach = np.zeros(len(text) + 2, np.int32)
    np.add.at(reach, last + 1, 1)
    np.add.at(reach, ends + 1, -1)
    need |= np.cumsum(reach)[: len(text)] > 0
    sorted_ = _sort_directly(np.flatnonzero(need & direct), words)
    induce = need & ~direct
    bucket = text[sorted_]
    bounds = np.searchsorted(bucket, np.arange(257))
    lists: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(found: np.ndarray, byte: int) -> np.ndarray:
        """What found places induce; those of the same byte come back."""
        before = found[found > 0] - 1
        before = before[induce[before]]
        firsts = text[before]
        same = firsts == byte
        _spread(before[~same], firsts[~same], lists)
        return before[same]

    for byte in range(256):
        found = np.concatenate(lists[byte]) if lists[byte] else np.empty(0, np.int64)
        while len(found):
            out.append(found)
            found = scan(found, byte)
        found = sorted_[bounds[byte] : bounds[byte + 1]]
        if len(found):
            out.append(found)
            scan(found, byte)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def common_prefixes(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The bytes that each suffix has in common with the one before it in order, SIZE at most; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, SIZE, 8):
        differ = words[order[live] + at] ^ words[order[live - 1] + at]
        equal = differ == 0
        part = live[~equal]
        bits = differ[~equal]
        lead = np.zeros(len(bits), np.int64)
        for k in range(1, 8):
            lead += bits < (_U(1) << _U(8 * k))
        lcp[part] = at + lead
        live = live[equal]
        lcp[live] = at + 8
    return np.minimum(lcp, SIZE)


def least_ids(strings: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of SIZE bytes of the strings, one string after another: the least id of a string that has it.
    Second, the windows of each string."""
    n = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"\xff".join(strings) + b"\xff" * (SIZE + 16), np.uint8)
    first = np.cumsum(n + 1) - n - 1
    windows = n - SIZE + 1
    at = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    words = np.zeros(len(text) - 7, _U)
    for k in range(8):
        words = (words << _U(8)) | text[k : len(text) - 7 + k]
    wanted = np.zeros(len(text), bool)
    wanted[at] = True
    order = suffix_order(text, wanted, words)
    owner = np.zeros(len(text), np.int64)
    owner[at] = np.repeat(ids, windows)
    heads = np.flatnonzero(common_prefixes(order, words) < SIZE)
    least = np.zeros(len(text), np.int64)
    if len(order):
        least[order] = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(heads, append=len(order)))
    return least[at], windows


# ---- jobs

_BLOCKS = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])
_SENT = pa.schema([("slot", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
_FLAGS = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("flags", pa.binary()), ("cold", pa.int64()), ("hot", pa.int64())])
_FOUND = pa.schema([("block", pa.int64()), ("blob", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _packed(size: int):
    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, block = [], [], 0, TaskContext.get().partitionId() << 32
        z = zstandard.ZstdCompressor(level=3)

        def out() -> pa.RecordBatch:
            return record_batch({"block": [block], "n_bytes": [held], "ids": [ids], "sizes": [[len(t) for t in texts]], "texts": [z.compress(b"".join(texts))]}, _BLOCKS)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                t = text_of(t.as_py())
                if texts and held + len(t) > size:
                    yield out()
                    ids, texts, held, block = [], [], 0, block + 1
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield out()

    return pack_texts


class _Block:
    """A block's documents, one after another, and their pieces."""

    def __init__(self, b: pa.RecordBatch, k: int):
        get = lambda name: b.column(name)[k]
        self.block, self.ids = get("block").as_py(), get("ids").as_py()
        self.sizes = np.array(get("sizes").as_py(), np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        size = int(self.sizes.sum())
        self.text = zstandard.ZstdDecompressor().decompress(get("texts").as_buffer(), max_output_size=size) if size else b""
        self.order_ids = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        self.flags, self.found = ((get(name).as_py() or []) if name in b.schema.names else [] for name in ("flags", "found"))

    def pieces(self) -> tuple[np.ndarray, ...]:
        data, out, k = np.frombuffer(self.text, np.uint8), [], 0
        while k < len(self.sizes):
            low = self.starts[k]
            end = max(k + 1, int(np.searchsorted(self.ends, low + _AT_ONCE, "right")))
            a, at, n, mark = pieces(data[low : self.ends[end - 1]], self.starts[k:end] - low, self.ends[k:end] - low)
            out.append((a, at + low, n, mark))
            k = end
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, and of each: 0 if one piece has it once, 1 if one piece has it again, else the number of distinct pieces."""
        a, _, _, mark = self.pieces()
        order = np.argsort(a)
        a, mark = a[order], mark[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        several = ~new
        several[:-1] |= ~new[1:]
        tied = np.flatnonzero(several)
        mark[tied] = mark[tied[np.lexsort((mark[tied], a[tied]))]]
        fresh = new.copy()
        fresh[1:] |= mark[1:] != mark[:-1]
        heads = np.flatnonzero(new)
        n = np.add.reduceat(fresh.astype(np.int64), heads) if len(a) else np.empty(0, np.int64)
        return a[heads], np.where(n > 1, n, np.diff(heads, append=len(a)) > 1).astype(np.int64)

    def shared(self) -> tuple[np.ndarray, ...]:
        """The pieces that may repeat: for each distinct one its key, place and windows; for each piece its place and the
        number of the distinct one. Pieces of hot anchors are single windows, keyed by their own hash. Pieces of a block
        are the same if anchor and content hash are."""
        a, at, n, mark = self.pieces()
        anchors, which = np.unique(a, return_inverse=True)
        z = zstandard.ZstdDecompressor()
        flags = np.concatenate([np.frombuffer(z.decompress(x["flags"]), np.uint8) for x in sorted(self.flags, key=lambda x: x["slot"])])
        assert len(flags) == len(anchors)
        flag = flags[which]
        cold, hot = flag == 1, np.flatnonzero(flag == 2)
        a, mark, first, m = a[cold], mark[cold], at[cold], n[cold]
        if len(hot):
            text = np.frombuffer(b"".join(self.text[x : x + y + SIZE - 1] for x, y in zip(at[hot].tolist(), n[hot].tolist(), strict=True)), np.uint8)
            size = n[hot] + SIZE - 1
            step = np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            h = string_hashes(text, SIZE)[np.repeat(np.cumsum(size) - size, n[hot]) + step]
            a, mark = np.concatenate((a, h)), np.concatenate((mark, np.zeros(len(h), _U)))
            first, m = np.concatenate((first, np.repeat(at[hot], n[hot]) + step)), np.concatenate((m, np.ones(len(h), np.int64)))
        order = np.lexsort((mark, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (mark[order][1:] != mark[order][:-1])
        number = np.empty(len(a), np.int64)
        number[order] = np.cumsum(new) - 1
        one = order[new]
        return a[one], first[one], m[one], first, number

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield _Block(b, k)


def _anchored(bits: int, slots: int):
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The distinct anchors of each block, cut to `bits`, by slot."""
        edges = np.array([(k << 64) // slots for k in range(1, slots)], _U)
        for b in _blocks(batches):
            anchors, n = b.counted()
            cuts = [0, *np.searchsorted(anchors, edges), len(anchors)]
            short = anchors >> _U(64 - bits)
            for slot, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if x < y:
                    yield slot, b.block, pack(a=np.diff(short[x:y], prepend=_U(0)), n=n[x:y])

    return lambda batches: gathered(anchored(batches), _SENT)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[dict[str, np.ndarray]]]]:
    """Of a task: the slot and block of each message, and the messages."""
    slots, blocks, blobs = [], [], []
    for b in batches:
        slots += b.column("slot").to_pylist()
        blocks += b.column("block").to_pylist()
        blobs += [unpack(x.as_py()) for x in b.column("blob")]
    if blobs:
        yield slots, blocks, blobs


def _flagged(hot: int):
    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For each message: 0 for an anchor that one piece of the corpus has alone, else 1, 2 for a hot one; and the pieces of both kinds."""
        for slots, blocks, blobs in _held(batches):
            key = np.concatenate([np.cumsum(x["a"], dtype=_U) for x in blobs])
            n = np.concatenate([x["n"] for x in blobs]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) > 0)))
            rows = np.diff(heads, append=len(key))
            pieces_ = np.add.reduceat(np.maximum(n, 1)[order], heads)
            alone = (rows == 1) & (n[order][heads] == 0)
            flag = np.empty(len(key), np.uint8)
            flag[order] = np.repeat(np.where(alone, 0, np.where(pieces_ > hot, 2, 1)), rows)
            ends = np.cumsum([len(x["a"]) for x in blobs])
            z = zstandard.ZstdCompressor(level=3)
            for slot, block, x, e in zip(slots, blocks, blobs, ends, strict=True):
                f, w = flag[e - len(x["a"]) : e], np.maximum(n[e - len(x["a"]) : e], 1)
                yield block, slot, z.compress(f.tobytes()), int(w[f == 1].sum()), int(w[f == 2].sum())

    return lambda batches: gathered(flagged(batches), _FLAGS)


def _cut(tasks: int, parts: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The strings that may repeat of each block, with the least and largest id that have them there, by task and in the order of its parts."""
        z = zstandard.ZstdCompressor(level=3)
        for b in _blocks(batches):
            keys, at, n, places, number = b.shared()
            if not len(keys):
                continue
            ids = b.order_ids[b.document(places)]
            least, most = np.full(len(keys), _LAST, np.int64), np.full(len(keys), np.iinfo(np.int64).min, np.int64)
            np.minimum.at(least, number, ids)
            np.maximum.at(most, number, ids)
            part = (mix64(keys) % _U(tasks * parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            cuts = np.searchsorted(part, np.arange(tasks + 1) * parts)
            for k in range(tasks):
                which = order[cuts[k] : cuts[k + 1]]
                if len(which):
                    own = [b.text[x:y] for x, y in zip(at[which].tolist(), (at + n + SIZE - 1)[which].tolist(), strict=True)]
                    head = pack(size=n[which] + SIZE - 1, number=np.diff(which, prepend=0), least=least[which], most=most[which], part=part[cuts[k] : cuts[k + 1]] - k * parts)
                    yield k, b.block, len(head).to_bytes(8, "little") + head + z.compress(b"".join(own))

    return lambda batches: gathered(cut(batches), _SENT)


def _least_runs(strings: list[bytes], own: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each string the range of its entries in two lists, of first windows and of the least id from there on. A string
    whose anchor no other one has shares no window and needs no sorting."""
    size = np.array([len(x) for x in strings], np.int64)
    text = np.frombuffer(b"\xff".join(strings), np.uint8)
    _, kind, n = np.unique(_least(string_hashes(text, ANCHOR))[np.cumsum(size + 1) - size - 1], return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[kind] > 1)
    ids, windows = least_ids([strings[i] for i in several], own[several])
    ends = np.cumsum(windows)
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    new[ends[:-1]] = True
    first = np.flatnonzero(new)
    runs = np.ones(len(strings), np.int64)
    runs[several] = np.searchsorted(first, ends) - np.searchsorted(first, ends - windows)
    high = np.cumsum(runs)
    low = high - runs
    starts, values = np.zeros(high[-1], np.int64), np.repeat(own, runs)
    to = np.repeat(low[several] - np.cumsum(runs[several]) + runs[several], runs[several]) + np.arange(len(first))
    starts[to], values[to] = first - np.repeat(ends - windows, runs[several]), ids[first]
    return low, high, starts, values


def _solved(parts: int):
    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For each block, its strings with windows that have a smaller id than the block's largest for that string: number,
        and the windows from each start on with the least id that has them. A task's parts are sorted one after another."""
        blocks, texts, heads = [], [], []
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(b.num_rows):
                blob = b.column("blob")[k].as_py()
                at = 8 + int.from_bytes(blob[:8], "little")
                x = {c: v.view(np.int64) for c, v in unpack(blob[8:at]).items()}
                texts.append(z.decompress(blob[at:], max_output_size=int(x["size"].sum())))
                heads.append((x["size"], np.cumsum(x["size"]), np.cumsum(x["number"]), x["least"], x["most"], np.searchsorted(x["part"], np.arange(parts + 1))))
                blocks.append(b.column("block")[k].as_py())
        if not blocks:
            return
        found: list[list[dict[str, np.ndarray]]] = [[] for _ in blocks]
        for part in range(parts):
            number, which = {}, []
            for text, (size, end, *_, cuts) in zip(texts, heads, strict=True):
                own = slice(cuts[part], cuts[part + 1])
                which.append(np.array([number.setdefault(text[e - n : e], len(number)) for n, e in zip(size[own].tolist(), end[own].tolist(), strict=True)], np.int64))
            if not number:
                continue
            own = np.full(len(number), _LAST, np.int64)
            for w, (_, _, _, least, _, cuts) in zip(which, heads, strict=True):
                np.minimum.at(own, w, least[cuts[part] : cuts[part + 1]])
            low, high, starts, values = _least_runs(list(number), own)
            smallest = np.minimum.reduceat(values, low)
            for w, (_, _, numbers, _, most, cuts), out in zip(which, heads, found, strict=True):
                use = np.flatnonzero(smallest[w] < most[cuts[part] : cuts[part + 1]])
                if len(use):
                    a, n = low[w[use]], (high - low)[w[use]]
                    at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                    out.append({"number": numbers[cuts[part] + use], "n": n, "start": starts[at], "id": values[at]})
        for block, out in zip(blocks, found, strict=True):
            if out:
                yield block, pack(**{c: np.concatenate([x[c] for x in out]) for c in out[0]})

    return lambda batches: gathered(solved(batches), _FOUND)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document of a block, cut."""
    for b in _blocks(batches):
        spans: list[list[dict]] = [[] for _ in b.ids]
        if b.found:
            _, _, windows, places, number = b.shared()
            x = {k: np.concatenate(c).view(np.int64) for k, c in _columns(b.found).items()}
            runs, at = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
            runs[x["number"]], at[x["number"]] = x["n"], np.cumsum(x["n"]) - x["n"]
            last = np.zeros(len(x["id"]), bool)
            last[np.cumsum(x["n"]) - 1] = True
            until = np.append(x["start"][1:], 0)
            until[last] = windows[x["number"]]
            hit = np.flatnonzero(runs[number])
            n = runs[number[hit]]
            run = np.repeat(at[number[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(places[hit], n)
            doc = b.document(place)
            known = np.array([i is not None for i in b.ids], bool)
            use = known[doc] & (x["id"][run] < b.order_ids[doc])
            place, run, doc = place[use], run[use], doc[use]
            low, high = place + x["start"][run], place + until[run] + SIZE - 1
            order = np.argsort(low, kind="stable")
            low, high, doc = low[order], np.maximum.accumulate(high[order]), doc[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])
            heads = np.flatnonzero(new)
            if len(heads):
                ends = high[np.append(heads[1:], len(low)) - 1]
                for d, x0, x1 in zip(doc[heads].tolist(), (low[heads] - b.starts[doc[heads]]).tolist(), (ends - b.starts[doc[heads]]).tolist(), strict=True):
                    spans[d].append({"start": x0, "end": x1})
        rest = []
        for x0, x1, gone in zip(b.starts.tolist(), b.ends.tolist(), spans, strict=True):
            t = b.text[x0:x1]
            edges = [0, *[x for s in gone for x in (s["start"], s["end"])], len(t)]
            rest.append(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if gone else t)
        for k in range(0, len(rest), 200):
            part = slice(k, k + 200)
            yield record_batch({"doc_id": b.ids[part], "n_bytes": b.sizes[part], "removed": spans[part], "kept": rest[part]}, _OUT)


def _columns(blobs: list[bytes]) -> dict[str, list[np.ndarray]]:
    out: dict[str, list[np.ndarray]] = {}
    for blob in blobs:
        for name, c in unpack(blob).items():
            out.setdefault(name, []).append(c)
    return out


def cut_repeats(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, n_bytes, removed (maximal spans of bytes) and kept (the other bytes) of every row."""
    spark = tuned(docs.sparkSession)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = lambda df, f, schema: df.mapInArrow(f, from_arrow_schema(schema))
    blocks = kept(run(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), _packed(p.block_bytes), _BLOCKS), "suffix-blocks")
    about = (blocks.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0) * 2 // (SIZE - ANCHOR + 2)
    slots = max(min(least, _FEW), -(-about // p.slot_anchors))
    bits = min(64, max(16, about.bit_length() + 8))
    flags = kept(run(run(blocks, _anchored(bits, slots), _SENT).repartitionById(slots, F.col("slot")), _flagged(p.hot_pieces), _FLAGS), "suffix-flags")
    sums = flags.agg(F.sum("cold").alias("cold"), F.sum("hot").alias("hot")).first()
    # a piece has about 70 bytes; a hot one becomes about 18 windows
    sorts = max(least, -(-((sums["cold"] or 0) * 70 + (sums["hot"] or 0) * 18 * SIZE) // p.sort_bytes))
    tasks = max(min(least, _FEW), -(-sorts // _PARTS))
    parts = -(-sorts // tasks)
    flags_of = flags.groupBy("block").agg(F.collect_list(F.struct("slot", "flags")).alias("flags"), (F.sum("cold") + F.sum("hot")).alias("any")).filter("any > 0").drop("any")
    strings = run(blocks.join(flags_of, "block"), _cut(tasks, parts), _SENT)
    found = kept(run(strings.repartitionById(tasks, F.col("slot")), _solved(parts), _FOUND), "suffix-found")
    found_of = found.groupBy("block").agg(F.collect_list("blob").alias("found"))
    return run(blocks.join(flags_of, "block", "left").join(found_of, "block", "left"), _removed, _OUT)
