"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

Encoding. Added tokens split a text first, then a pattern parts it into pieces, then each piece's bytes are merged by
the merge list. All three are done on a stream of blocks with constant work space:

- A place after a character that is no white space and before white space always parts two pieces, so the stretches
  between such places are encoded on their own. Short ones are remembered in a cache of bounded size.
- A stretch longer than `LONG` characters is read in blocks. A piece is final once it ends `MARGIN` characters before
  what has been read; a piece that fills the block goes on as an open run of one character class. Of a run of white
  space the last character is held back: it belongs to the next piece if there is one.
- An open run's bytes go to a merge buffer. `lookahead(merges)` bytes after a token's end suffice to make it final,
  so such tokens are emitted and only the rest is kept.

Sufficient lookahead. Take two texts that agree on a prefix and run the merges in order of rank on both. At every time
there is a boundary that both share, left of which they agree; it starts at the prefix's end. Rule (u, v) can move it
only where u ends at it in both and v begins there in one: then it moves left by len(u), once a rule, as equal rules
pair up from the left. After that, what begins at the boundary has u on its left spine in both texts. So a chain of
moves by rules of rising rank needs each v to have the previous u on its left spine, and the largest sum of len(u) over
such chains bounds how far the boundary moves. One pass over the rules computes it. This needs every rule's parts to be
made by earlier rules, and every token by one rule; other merge lists are refused.

A token boundary, once final, also cuts the problem in two: no merge crossed it, so what follows is encoded as if it
stood alone.

Decoding. Token bytes go through a UTF-8 state machine that holds at most three bytes between tokens; bytes that form
no character become U+FFFD.

Cases. Null text: no tokens, decoded as the empty text. Empty text: no tokens. Repeated rows: a row each.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import record_batch

LONG = 2048
BLOCK = 4096
MARGIN = 4
#: Stretches or pieces of a generation of a cache.
CACHE = 250_000

#: White space as the pattern's \s has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and the stretch after it; each match ends before white space or at the end.
_STRETCH = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACES = regex.compile(r"\s+")
_CLASSES = [*[regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")], _SPACES]

#: What a tokenizer file must say for the pattern above and these added tokens to be its own. Fixed values.
_EXPECTED = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "post_processor": None}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def check_spec(spec: dict) -> None:
    """Refuse a tokenizer file that works in another way than this module does."""
    pre = {k: v for k, v in (spec.get("pre_tokenizer") or {}).items() if k != "trim_offsets"}
    found = {"normalizer": spec.get("normalizer"), "pre_tokenizer": pre, "post_processor": spec.get("post_processor")}
    model = {k: spec["model"].get(k, v) for k, v in _MODEL.items()}
    # The parts of an added token may be changed by a normalizer only, and there is none.
    odd = [t["content"] for t in spec["added_tokens"] if any(t.get(k, False) for k in ("single_word", "lstrip", "rstrip"))]
    if found != _EXPECTED or model != _MODEL or odd:
        raise ValueError(f"not a plain byte-level BPE file: {found}, {model}, added tokens {odd}")


def byte_letters() -> dict[int, str]:
    """The character that the vocabulary file writes for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return out


class Merges:
    """The merge list, vocabulary and added tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        model = spec["model"]
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = [(raw(a), raw(b)) for a, b in pairs]
        #: (id of u) << 32 | id of v of each rule: its rank; and the id it makes, by rank.
        self.rank = {self.ids[u] << 32 | self.ids[v]: r for r, (u, v) in enumerate(self.pairs)}
        self.makes = [self.ids[u + v] for u, v in self.pairs]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.lookahead = lookahead(self.pairs)
        self.longest = max(len(a) + len(b) for a, b in self.pairs)

    def table(self) -> list[bytes]:
        out = [b""] * (max(self.bytes) + 1)
        for i, b in self.bytes.items():
            out[i] = b
        return out


def lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that suffice to make it final; see the module's text."""
    left: dict[bytes, bytes] = {}
    made = {bytes([b]) for b in range(256)}
    far: dict[bytes, int] = {}
    most = 0
    for u, v in pairs:
        if u not in made or v not in made or u + v in made:
            raise ValueError(f"not a proper merge list at {u!r} {v!r}")
        spine, t = 0, v
        while True:
            spine = max(spine, far.get(t, 0))
            if t not in left:
                break
            t = left[t]
        far[u] = max(far.get(u, 0), len(u) + spine)
        most = max(most, far[u])
        made.add(u + v)
        left[u + v] = u
    return most


_NONE = 1 << 60


def merge_bytes(data: bytes, m: Merges) -> list[int]:
    """The ids of the bytes of one piece: the pair of least rank merges first, of equal ones the leftmost."""
    parts = [m.byte_ids[b] for b in data]
    if len(parts) > 64:
        return _merge_long(parts, m)
    rank, makes = m.rank.get, m.makes
    ranks = [rank(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
    while ranks and (best := min(ranks)) != _NONE:
        i = ranks.index(best)
        parts[i] = made = makes[best]
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank(made << 32 | parts[i + 1], _NONE)
        if i:
            ranks[i - 1] = rank(parts[i - 1] << 32 | made, _NONE)
    return parts


def _merge_long(parts: list[int], m: Merges) -> list[int]:
    """The same with a heap of pairs and a linked list of parts; -1 marks what has been merged away."""
    n, rank = len(parts), m.rank.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << 32 | b)) is not None]
    heapify(heap)
    while heap:
        r, i, a, b = heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = m.makes[r], -1, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := rank(parts[i] << 32 | parts[after[j]])) is not None:
                heappush(heap, (r, i, parts[i], parts[after[j]]))
        if (k := before[i]) >= 0 and (r := rank(parts[k] << 32 | parts[i])) is not None:
            heappush(heap, (r, k, parts[k], parts[i]))
    return [x for x in parts if x >= 0]


class PieceStream:
    """Merges one piece that comes in parts: feed returns the tokens that are final, finish the others."""

    def __init__(self, m: Merges):
        self.m, self.held = m, b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        if len(self.held) < 4 * self.m.lookahead + self.m.longest:
            return []
        out, end = [], 0
        for t in merge_bytes(self.held, self.m):
            size = len(self.m.bytes[t])
            if end + size + self.m.lookahead > len(self.held):
                break
            end += size
            out.append(t)
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = merge_bytes(self.held, self.m) if self.held else [], b""
        return out


def _serial(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Remembered:
    """A cache of two generations: when the young one is full it becomes the old one, so what is in use stays."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class Encoder:
    """Text to ids. encode_blocks takes a text as an iterator of strings and never holds more than a few blocks."""

    def __init__(self, m: Merges):
        self.m = m
        self.added = regex.compile("|".join(map(regex.escape, sorted(m.added, key=len, reverse=True)))) if m.added else None
        self.cache, self.pieces = Remembered(), Remembered()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(text)), dtype="<u4")

    def parts(self, text: str | None) -> Iterator[bytes]:
        """Serialized ids (little-endian, 32 bits), stretch by stretch."""
        cache = self.cache
        for s in _STRETCH.findall(text or ""):
            got = cache.young.get(s)
            if got is None:
                if len(s) > LONG:
                    got = b"".join(_serial(t) for t in self.encode_blocks(s[k : k + BLOCK] for k in range(0, len(s), BLOCK)))
                else:
                    got = cache.put(s, cache.old.get(s) or self._short(s))
            yield got

    def _short(self, s: str) -> bytes:
        if any(t in s for t in self.m.added):
            return b"".join(_serial([x]) if isinstance(x, int) else self._plain(x) for x in self._segments(s))
        return self._plain(s)

    def _plain(self, s: str) -> bytes:
        """A text without added tokens. One piece alone is remembered as a stretch, so pieces hold only parts of stretches."""
        found, pieces = _PIECE.findall(s), self.pieces
        if len(found) == 1:
            return _serial(merge_bytes(s.encode(), self.m))
        return b"".join([pieces.young.get(p) or pieces.put(p, pieces.old.get(p) or _serial(merge_bytes(p.encode(), self.m))) for p in found])

    def _segments(self, s: str) -> Iterator[str | int]:
        at = 0
        if self.added is not None:
            for x in self.added.finditer(s):
                if x.start() > at:
                    yield s[at : x.start()]
                yield self.m.added[x[0]]
                at = x.end()
        if at < len(s):
            yield s[at:]

    def encode_blocks(self, blocks: Iterator[str]) -> Iterator[list[int]]:
        """Ids in lists, as soon as they are final."""
        widest = max((len(t) for t in self.m.added), default=1)
        text = Segment(self.m)
        held = ""
        for block in blocks:
            held += block
            tail = ""
            # Text before an added token is whole; the stretch after the last one may hold the start of another.
            for seg in self._segments(held):
                if isinstance(seg, int):
                    if tail:
                        yield text.feed(tail)
                    yield [*text.finish(), seg]
                    text = Segment(self.m)
                    tail = ""
                else:
                    tail = seg
            cut = max(0, len(tail) - widest + 1)
            if cut:
                yield text.feed(tail[:cut])
            held = tail[cut:]
        if held:
            yield text.feed(held)
        yield text.finish()


class Segment:
    """Pieces of a text between added tokens, in blocks."""

    def __init__(self, m: Merges):
        self.m, self.held, self.run, self.stream = m, "", None, None

    def feed(self, block: str, last: bool = False) -> list[int]:
        out: list[int] = []
        self.held += block
        if self.run is not None:  # inside a long piece of one character class
            more = self.run.match(self.held)
            n = more.end() if more else 0
            if self.run is _SPACES and (n < len(self.held) or not last):
                n -= 1
            out += self.stream.feed(self.held[:n].encode())
            self.held = self.held[n:]
            if len(self.held) <= (self.run is _SPACES) and not last:
                return out
            out += self.stream.finish()
            self.run = self.stream = None
        end = 0
        for x in _PIECE.finditer(self.held):
            if x.end() > len(self.held) - MARGIN and not last:
                break
            out += merge_bytes(x[0].encode(), self.m)
            end = x.end()
        self.held = self.held[end:]
        if len(self.held) > LONG and not last and (x := _PIECE.match(self.held)) and x.end() == len(self.held):
            self.run = next(c for c in _CLASSES if c.match(x[0][-1]))
            self.stream = PieceStream(self.m)
            n = len(self.held) - (self.run is _SPACES)
            out += self.stream.feed(self.held[:n].encode())
            self.held = self.held[n:]
        return out

    def finish(self) -> list[int]:
        out = self.feed("", last=True)
        if self.stream is not None:
            out += self.stream.finish()
            self.stream = self.run = None
        return out


class Decoder:
    """Ids to text: feed ids as they come, finish at the end."""

    def __init__(self, table: list[bytes]):
        self.table, self.state = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


def decode(ids: np.ndarray, table: list[bytes], block: int = 1 << 14) -> str:
    d = Decoder(table)
    return "".join([*(d.feed(ids[k : k + block].tolist()) for k in range(0, len(ids), block)), d.finish()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    return Encoder(Merges(path))


@lru_cache(maxsize=2)
def decode_table(path: str) -> list[bytes]:
    return encoder(path).m.table()


def encode_documents(docs: DataFrame, path: str, keep_text: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id and token_ids of every text, text itself if asked for, and decoded_text, what the decoder makes of these ids.

    path: a tokenizer file that is there on all executors. Decoding here spares a second Python worker for each task."""
    fields = [("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32()))] + [("text", pa.string())] * keep_text + [("decoded_text", pa.string())] * decoded
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(path), decode_table(path) if decoded else []
        for b in batches:
            found = [b"".join(enc.parts(t)) for t in b.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
            back = [decode(np.frombuffer(x, dtype="<u4"), table) for x in found] if decoded else None
            yield record_batch({"doc_id": b.column("doc_id"), "token_ids": ids, "text": b.column("text"), "decoded_text": back}, schema)

    ddl = "doc_id bigint, token_ids array<int>" + ", text string" * keep_text + ", decoded_text string" * decoded
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ddl)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encoded, and decoded_text (null for null token_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(path)
        for b in batches:
            ids = b.column("token_ids")
            texts = [decode(ids[k].values.to_numpy(), table) if ids[k].is_valid else None for k in range(len(ids))]
            yield b.append_column("decoded_text", pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded_text", T.StringType())]))
