"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers map into memory.

Tokens: ASCII capitals lower-cased, words `[^\\x20\\x09-\\x0D]+`, then one end token for each text; a begin mark is the
first token's context. Words are known by their XXH64 (seed 42).

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)        p(w) = max(t(w) - E(t(w)), 0) / T + h / (V + 1)

c: counts; t(w): distinct contexts of w; T: distinct bigrams; V: distinct tokens; D, E: the three discounts of each
order from its counts of counts, `FLOOR` at least; g, h: the mass that the discounts free, so p sums to 1 over the V
tokens and one for all unknown ones, and is never 0. A context that training has not seen leaves p(w).

Jobs. (1) Each partition counts its bigrams in chunks of `chunk_tokens` and sends compact blocks to buckets. A bucket is
chosen by the context's hash; contexts that hold more than `hot_share` of the tokens of a bounded sample of documents
are spread by the next word's hash too (the sample steers where counts meet, never what they are). (2) Each bucket
merges its blocks, writes its sorted array of (bigram hash, count), and sends what it knows about contexts and words
(bigrams with count 1, 2, more; tokens) to slots. (3) Each slot merges and writes its sorted arrays. The driver gets the names
of files and their sums. (4) Scoring looks the hashes of a batch up in the files, mapped read-only.

Files are written under names of their own by each attempt and count only if the manifest names them. What is not in a
file system that can be mapped is fetched on first use into the folder that Spark keeps for an executor's files and
deletes with it.

Cases. Null or empty text: the end token only. No training rows: every probability is 1, scores 0. Repeated rows: each
counts. Null doc_id: trained on, not held out.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyloom.llm.common import SPACE_CLASS, forget, gathered, kept, mix64, open_fs, record_batch, shared_dir, write_bytes

U64 = np.dtype("<u8")
BEGIN, END = (np.uint64(xxh64_intdigest(m, 42)) for m in (b" begin", b" end"))  # words have no space, so these are no words
#: Tokens that are scored at once, about: the more, the fewer visits to each array.
_AT_ONCE = 1_000_000
#: The least discount. Small corpora have counts of counts that would give none or a negative one; then nothing would be left for what follows a context for the first time.
FLOOR = 0.05


@dataclass(frozen=True)
class LmParams:
    chunk_tokens: int = 1_500_000
    #: Tokens whose bigrams a bucket takes, about.
    bucket_tokens: int = 2_500_000
    hot_docs: int = 2000
    hot_share: float = 0.002


def bigram_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(ctx * np.uint64(0x9E3779B97F4A7C15) + word)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """A slot for each key, in two bytes if they hold it: numpy sorts these fastest."""
    return (mix64(keys) % np.uint64(slots)).astype(np.uint16 if slots <= 1 << 16 else np.int32)


def _bucket_of(ids: np.ndarray, names: np.ndarray, contexts: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of bigrams (bigram_ids()): their context's, of hot contexts that of both words."""
    ctx = ids >> 32
    out = slot_of(contexts, buckets)[ctx]
    spread = np.flatnonzero(np.isin(contexts, hot)[ctx])
    c, w = contexts[ctx[spread]], names[ids[spread] & 0xFFFFFFFF]
    out[spread] = slot_of(c + w * np.uint64(0x9E3779B97F4A7C15), buckets)
    return out


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def word_hashes(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of the n > 0 bytes from each place on: words of one length at once, those of 32 bytes or more one by one."""
    out = np.empty(len(at), U64)
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    read = lambda places: eight[places].view(U64).ravel()
    short = np.minimum(n, 32).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    cuts = np.searchsorted(short[order], np.arange(1, 33))
    for size in range(1, 32):
        which = order[cuts[size - 1] : cuts[size]]
        if not len(which):
            continue
        p, k = at[which], 0
        h = np.full(len(which), np.uint64(42 + size) + _P5)
        while size - k >= 8:
            h = _rotated(h ^ (_rotated(read(p + k) * _P2, 31) * _P1), 27) * _P1 + _P4
            k += 8
        if size > k:
            rest = read(p + k)
        if size - k >= 4:
            h = _rotated(h ^ ((rest & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            rest, k = rest >> np.uint64(32), k + 4
        while size > k:
            h = _rotated(h ^ ((rest & np.uint64(255)) * _P5), 11) * _P1
            rest, k = rest >> np.uint64(8), k + 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[which] = h ^ (h >> np.uint64(32))
    for i in order[cuts[31] :].tolist():
        out[i] = xxh64_intdigest(data[at[i] : at[i] + n[i]].tobytes(), 42)
    return out


def texts_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of each text with its end token, one text after another, and the tokens of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, cuts = parts.values, parts.offsets.to_numpy()
    if not len(texts):
        return np.empty(0, U64), np.empty(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    at, n = ends[:-1] - ends[0], np.diff(ends)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    use = n > 0  # space at an end of a text has an empty word beside it
    until = np.concatenate(([0], np.cumsum(use)))[cuts]
    sizes = np.diff(until) + 1
    out = np.full(sizes.sum(), END, U64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = word_hashes(data, at[use], n[use])
    return out, sizes


def token_hashes(text: str | None) -> np.ndarray:
    """The tokens' hashes with the end token."""
    return texts_hashes(pa.array([text], pa.string()))[0]


def numbered(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, the same as contexts (an end token is the begin mark there), and the place of each token's among them."""
    ids, names = pd.factorize(word)
    order = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    names = names[order]
    return names, np.where(names == END, BEGIN, names), place[ids]


def bigram_ids(w: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Of texts one after another, places of tokens in names: context's place << 32 | word's place. Every text starts after an end token."""
    return np.concatenate(([np.searchsorted(names, END)], w[:-1])) << 32 | w


def grouped_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the place of one row of each, and the sums of the values."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.empty(0, np.int64)
    return ordered[first], order[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(**columns: np.ndarray) -> bytes:
    """Columns as bytes by significance, compressed in one: equal high bytes cost next to nothing, a small message little."""
    head, planes = [len(columns).to_bytes(8, "little")], []
    for name, c in columns.items():
        c = c.astype(U64 if c.dtype.kind in "ui" else c.dtype, copy=False)
        head.append(name.encode().ljust(8) + len(c).to_bytes(8, "little"))
        if len(c):
            planes.append(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes())
    return b"".join([*head, _PACKER.compress(b"".join(planes)) if planes else b""])


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    k = int.from_bytes(blob[:8], "little")
    heads = [(blob[at : at + 8].decode().strip(), int.from_bytes(blob[at + 8 : at + 16], "little")) for at in range(8, 8 + 16 * k, 16)]
    total = 8 * sum(n for _, n in heads)
    body = np.frombuffer(_UNPACKER.decompress(blob[8 + 16 * k :], max_output_size=total) if total else b"", np.uint8)
    out, at = {}, 0
    for name, n in heads:
        out[name] = np.ascontiguousarray(body[at : at + 8 * n].reshape(8, n).T).view(U64).ravel() if n else np.empty(0, U64)
        at += 8 * n
    return out


def pack_bigrams(ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Distinct contexts and words as sorted differences, bigrams as places among them, in the order of contexts."""
    cs, ci = np.unique(ctx, return_inverse=True)
    ws, wi = np.unique(word, return_inverse=True)
    order = np.lexsort((wi, ci))
    return pack_places(cs, ws, ci[order] << 32 | wi[order], n[order], np.empty(len(ws), np.int64))


def pack_places(contexts: np.ndarray, words: np.ndarray, ids: np.ndarray, n: np.ndarray, scratch: np.ndarray) -> bytes:
    """pack_bigrams() of sorted ids, context's place << 32 | word's place. scratch: room for a number for each word."""
    c, w = ids >> 32, ids & 0xFFFFFFFF
    heads = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.empty(0, np.int64)
    used = np.sort(w)
    used = used[np.concatenate(([True], used[1:] != used[:-1]))] if len(w) else used
    scratch[used] = np.arange(len(used))
    zero = U64.type(0)
    return pack(c=np.diff(contexts[c[heads]], prepend=zero), r=np.diff(heads, append=len(c)), w=np.diff(words[used], prepend=zero), i=scratch[w], n=n)


def unpack_bigrams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = unpack(blob)
    return np.repeat(np.cumsum(d["c"], dtype=U64), d["r"].astype(np.int64)), np.cumsum(d["w"], dtype=U64)[d["i"].astype(np.int64)], d["n"]


_BLOCKS = pa.schema([("kind", pa.string()), ("slot", pa.int32()), ("blob", pa.binary())])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """The blobs of each (kind, slot) of rows sorted by these."""
    key, held = None, []
    for b in batches:
        for k, s, x in zip(*(b.column(c).to_pylist() for c in ("kind", "slot", "blob")), strict=True):
            if (k, s) != key and held:
                yield *key, held
                held = []
            key = (k, s)
            held.append(x)
    if held:
        yield *key, held


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def discounts(t: list[int]) -> np.ndarray:
    """Entries 0 to 3: what is taken off a count of 0, 1, 2, 3 or more; FLOOR at least, 0.5 where counts of counts don't tell."""
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
    d = [0.0] + [min(max(k - (k + 1) * y * t[k] / t[k - 1], FLOOR), float(k)) if t[k - 1] else 0.5 for k in (1, 2, 3)]
    return np.array(d)


@dataclass
class Model:
    """Where the arrays are, and the sums that probabilities need."""

    hot: np.ndarray
    files: dict[str, list[str | None]]  # by kind, the URI of each bucket or slot
    bigrams: np.ndarray  # discounts
    words: np.ndarray
    train_tokens: int = 0
    vocabulary: int = 0
    types: int = 0
    freed: float = 0.0  # h above, times T


def hot_contexts(train: DataFrame, p: LmParams) -> np.ndarray:
    """Hashes of the words that hold more than hot_share of the tokens of a bounded sample; at most 1 / hot_share."""
    some = train.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(p.hot_docs)
    words = train.join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "left_semi").select(F.explode(F.split(F.lower("text"), SPACE_CLASS + "+")).alias("w")).groupBy("w").count()
    words = kept(words, "sample")
    total = words.agg(F.sum("count").alias("n")).first()["n"] or 0
    rows = [r["w"] for r in words.filter(F.col("count") > p.hot_share * total).collect()]
    forget(words)
    return np.array(sorted([xxh64_intdigest(w.encode().lower(), 42) for w in rows if w] + [int(BEGIN)]), dtype=U64)


def train_model(train: DataFrame, p: LmParams = LmParams()) -> Model:
    spark, train = train.sparkSession, train.select("doc_id", "text")
    path = shared_dir(spark, "lm")
    hot = hot_contexts(train, p)
    size = train.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = int(size // (6 * p.bucket_tokens)) + 1  # a word and its space take six bytes or so; this sets sizes only

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, n = [], 0

        def flush():
            names, contexts, w = numbered(np.concatenate(held))
            ids = np.sort(bigram_ids(w, names))
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            times, ids = np.diff(first, append=len(ids)).astype(U64), ids[first]
            bucket = _bucket_of(ids, names, contexts, hot, buckets)
            order = np.argsort(bucket, kind="stable")
            ids, times, scratch = ids[order], times[order], np.empty(len(names), np.int64)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                if cuts[k] < cuts[k + 1]:
                    o = slice(cuts[k], cuts[k + 1])
                    yield "bigram", k, pack_places(contexts, names, ids[o], times[o], scratch)

        for b in batches:
            if b.num_rows:
                held.append(texts_hashes(b.column("text"))[0])
                n += len(held[-1])
                if n >= p.chunk_tokens:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def store(kind: str, slot: int, arrays: list[np.ndarray]) -> str:
        uri = f"{path}/{kind}-{slot:06d}-{uuid.uuid4().hex}"
        head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], dtype=U64)
        write_bytes(uri, head.tobytes(), *[a.tobytes() for a in arrays])
        return uri

    def merge_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, slot, blobs in _groups(batches):
            ctx, word, n = (np.concatenate(x) for x in zip(*map(unpack_bigrams, blobs), strict=True))
            key, at, n = grouped_sums(bigram_key(ctx, word), n)
            ctx, word = ctx[at], word[at]
            many = n >= 255
            uri = store("bigram", slot, [key, np.where(many, 255, n).astype(np.uint8), key[many], n[many]])
            facts = pack(t=np.array([*_counts_of_counts(n), len(n)], dtype=U64))
            yield f"file:{uri}", slot, facts
            for kind, k, values in (
                ("context", ctx, {"total": n, "one": (n == 1), "two": (n == 2), "more": (n > 2)}),
                ("word", word, {"tokens": n, "types": np.ones(len(n))}),
            ):
                ks, _, *sums = grouped_sums(k, *(v.astype(U64) for v in values.values()))
                to = slot_of(ks, buckets)
                order = np.argsort(to, kind="stable")
                slots, first = np.unique(to[order], return_index=True)
                for s, o in zip(slots.tolist(), np.split(order, first[1:]), strict=True):
                    yield kind, s, pack(key=np.diff(ks[o], prepend=U64.type(0)), **{c: v[o] for c, v in zip(values, sums, strict=True)})

    def merge_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for kind, slot, blobs in _groups(batches):
            parts = [unpack(b) for b in blobs]
            names = [c for c in parts[0] if c != "key"]
            key, _, *sums = grouped_sums(np.concatenate([np.cumsum(d["key"], dtype=U64) for d in parts]), *(np.concatenate([d[c] for d in parts]) for c in names))
            uri = store(kind, slot, [key, *sums])
            by = dict(zip(names, sums, strict=True))
            facts = pack(t=np.array([*_counts_of_counts(by["types"]), len(key), by["types"].sum(), by["tokens"].sum()], dtype=U64)) if kind == "word" else b""
            yield f"file:{uri}", slot, facts

    ddl, sent = "kind string, slot int, blob binary", lambda f: lambda batches: gathered(f(batches), _BLOCKS)
    counted = train.select("text").mapInArrow(sent(count), ddl).repartitionById(buckets, F.col("slot")).sortWithinPartitions("slot").mapInArrow(sent(merge_bigrams), ddl)
    counted = kept(counted, "lm-parts")
    rest = counted.filter("kind in ('context', 'word')").repartitionById(2 * buckets, 2 * F.col("slot") + (F.col("kind") == "word").cast("int")).sortWithinPartitions("kind", "slot").mapInArrow(sent(merge_rest), ddl)
    model = Model(hot, {k: [None] * buckets for k in ("bigram", "context", "word")}, np.zeros(4), np.zeros(4))
    t2, t1 = np.zeros(5), np.zeros(7)
    for r in [*counted.filter("kind like 'file:%'").collect(), *rest.collect()]:
        uri = r["kind"].removeprefix("file:")
        kind = uri.rpartition("/")[2].split("-")[0]
        model.files[kind][r["slot"]] = uri
        if kind == "bigram":
            t2 += unpack(r["blob"])["t"]
        elif kind == "word":
            t1 += unpack(r["blob"])["t"]
    forget(counted)
    model.bigrams, model.words = discounts(t2[:4].tolist()), discounts(t1[:4].tolist())
    model.vocabulary, model.types, model.train_tokens = int(t1[4]), int(t1[5]), int(t1[6])
    model.freed = float(model.words[1] * t1[0] + model.words[2] * t1[1] + model.words[3] * (t1[4] - t1[0] - t1[1]))
    return model


_mapped: dict[str, list[np.ndarray]] = {}


def mapped(uri: str) -> list[np.ndarray]:
    """The arrays of a file, mapped read-only."""
    if uri not in _mapped:
        if uri.startswith("file:"):
            path = open_fs(uri)[1]
        else:
            path = os.path.join(SparkFiles.getRootDirectory(), "lm-" + hashlib.sha256(uri.encode()).hexdigest())
            if not os.path.exists(path):
                where, remote = open_fs(uri)
                part = f"{path}.{uuid.uuid4().hex}"
                with where.open_input_stream(remote) as src, open(part, "wb") as out:
                    while chunk := src.read(8 << 20):
                        out.write(chunk)
                os.replace(part, path)
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        k = int(raw[:8].view(U64)[0])
        sizes, at, arrays = raw[8 : 8 + 16 * k].view(U64).reshape(k, 2).astype(np.int64), 8 + 16 * k, []
        for n, width in sizes.tolist():
            arrays.append(raw[at : at + n * width].view({1: np.uint8, 8: U64}[width]) if at % width == 0 else np.frombuffer(raw[at : at + n * width].tobytes(), {1: np.uint8, 8: U64}[width]))
            at += n * width
        _mapped[uri] = arrays
    return _mapped[uri]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


def look_up(files: list[str | None], slots: np.ndarray, keys: np.ndarray, columns: int) -> np.ndarray:
    """A row of `columns` values for each key, 0 where there is none. For one column, large values are kept apart."""
    out = np.zeros((len(keys), columns))
    order = np.argsort(keys)
    order = order[np.argsort(slots[order], kind="stable")]
    cuts = np.flatnonzero(np.concatenate(([True], slots[order][1:] != slots[order][:-1], [True]))) if len(keys) else []
    for a, b in zip(cuts[:-1], cuts[1:]) if len(keys) else ():
        o = order[a:b]
        if (uri := files[slots[o[0]]]) is None:
            continue
        arrays = mapped(uri)
        at, hit = _find(arrays[0], keys[o])
        if columns > 1:
            for c in range(columns):
                out[o[hit], c] = arrays[1 + c][at[hit]]
            continue
        n = arrays[1][at[hit]].astype(np.float64)
        big = np.flatnonzero(n == 255)
        if len(big):
            n[big] = arrays[3][np.searchsorted(arrays[2], keys[o[hit]][big])]
        out[o[hit], 0] = n
    return out


def log_probabilities(m: Model, ctx: np.ndarray | None, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p(word | ctx) and the training count of each word. Without ctx, the words are those of texts one after another."""
    if ctx is None:
        names, contexts, w = numbered(word)
        ids = bigram_ids(w, names)
    else:
        names, w = np.unique(word, return_inverse=True)
        contexts, c = np.unique(ctx, return_inverse=True)
        ids = c << 32 | w
    buckets = len(m.files["word"])
    tokens, types = look_up(m.files["word"], slot_of(names, buckets), names, 2).T
    total, one, two, more = look_up(m.files["context"], slot_of(contexts, buckets), contexts, 4).T
    back, ids = pd.factorize(ids)
    c, w1 = ids >> 32, ids & 0xFFFFFFFF
    n = look_up(m.files["bigram"], _bucket_of(ids, names, contexts, m.hot, buckets), bigram_key(contexts[c], names[w1]), 1)[:, 0]
    if m.types:
        low = (np.maximum(types - m.words[np.minimum(types, 3).astype(int)], 0) + m.freed / (m.vocabulary + 1)) / m.types
    else:
        low = np.ones(len(names))
    seen = total > 0
    freed = np.where(seen, (m.bigrams[1] * one + m.bigrams[2] * two + m.bigrams[3] * more) / np.where(seen, total, 1), 1.0)
    top = np.maximum(n - m.bigrams[np.minimum(n, 3).astype(int)], 0) / np.where(seen, total, 1)[c]
    return np.log10(top + freed[c] * low[w1])[back], tokens[w]


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scorer(m: Model):
    """What scores batches of doc_id and text, many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, sizes, held = [], [], [], 0

        def scored() -> pa.RecordBatch:
            word, n = np.concatenate(words), np.concatenate(sizes)
            logs, count = log_probabilities(m, None, word)
            first = np.cumsum(n) - n
            base = np.log10((count + 1) / (m.train_tokens + m.vocabulary + 1))
            return record_batch({
                "doc_id": pa.concat_arrays(ids), "n_tokens": n, "n_known": np.add.reduceat((count > 0).astype(np.int64), first),
                "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(logs, first),
            }, _SCORES)

        for b in batches:
            if not b.num_rows:
                continue
            word, n = texts_hashes(b.column("text"))
            ids.append(b.column("doc_id"))
            words.append(word)
            sizes.append(n)
            held += len(word)
            if held >= _AT_ONCE:
                yield scored()
                ids, words, sizes, held = [], [], [], 0
        if ids:
            yield scored()

    return run


def score_documents(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-one unigrams) and score, both log10 probabilities of the whole text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scorer(m), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
