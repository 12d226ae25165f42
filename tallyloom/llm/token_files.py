"""Token files: every document's ids compressed on its own with a shared zstandard dictionary.

Encoding uses the tokenizers library. Stretches of text between safe places (see bpe) are encoded once and remembered
in a cache of bounded size; a new stretch is cut into the pieces of the tokenizer's pattern, and the library's model merges each.
That gives the library's own ids for whole texts. Where a file is no plain byte-level BPE, whole texts go to the library.

The dictionary is trained on serialized id arrays of `sample_docs` documents, those with the smallest hash of doc_id;
of each, `sample_pieces` pieces of `piece_bytes` at most, evenly spaced. It steers sizes only, never what is read back.

A file holds, all little-endian:
    8 bytes      b"TLTOKEN1"
    32 bytes     SHA-256 of the dictionary (of no bytes, if there is none)
    frames       a zstandard frame for each document: its ids as unsigned 32-bit integers
    index        n+1 unsigned 64-bit frame offsets, n unsigned 64-bit token counts, n signed 64-bit doc_ids, n bytes: 1 where doc_id is not null
    16 bytes     unsigned 64-bit n and place of the index
so a reader that wants one document reads the end, the index and one frame.

A folder holds the files, `dictionary`, and `manifest`, a Parquet table with a row a file: part (its place in the order),
name, docs, tokens, and the dictionary's SHA-256 in hexadecimal. The manifest is written last, by the job that writes the files, and
the reader starts from it; so a folder can be read from its path alone, and a folder without one is unfinished.

Jobs. Documents are encoded and compressed where they are read and written to the shared folder; these short rows are
then range-partitioned by doc_id, token count, CRC-32 and a random number drawn with them, and each partition streams its frames into one
file, so a task holds no more than an index, and rows of one doc_id may go to many. Files are named by the manifest only: a
retried task writes another file, and what an earlier attempt left is not read. Documents with equal doc_id lie next to
each other in the order of token count, then CRC-32.

Cases. Null or empty text: just the end id. Null doc_id: sorts first. Empty table: no files. Repeated rows: stored twice.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.bpe import _PIECE, _STRETCH, _WS, LONG, byte_letters, check_spec
from tallyloom.llm.common import forget, kept, open_fs, record_batch, shared_dir, write_bytes

MAGIC = b"TLTOKEN1"
#: Remembered stretches of a generation.
GENERATION = 500_000
#: Remembered pieces of stretches with several.
PIECES = 100_000
_WHITE = frozenset(re.findall(f"[{_WS}]", "".join(map(chr, range(0x3001)))))
#: What the pattern of pieces keeps together after a word; the apostrophe has rules of its own.
_MARKS = string.punctuation.replace("'", "")


@dataclass(frozen=True)
class TokenFileParams:
    end_id: int = 0
    level: int = 3
    dict_bytes: int = 32 << 10
    sample_docs: int = 1024
    sample_pieces: int = 8
    piece_bytes: int = 4096
    #: Compressed bytes of a file, about. Larger on a cluster.
    file_bytes: int = 16 << 20


class _Known(dict):
    """Serialized ids of stretches; those of one that is asked for the first time are made from its pieces'."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        self.letters, self.serial, self.pieces, self.old = _Letters(), _Serial(), {}, {}

    def __missing__(self, key: str | tuple[str]) -> bytes:
        if (ids := self.old.get(key)) is None:
            first = type(key) is tuple
            text = key[0] if first else key
            if len(text) > LONG:
                return library_ids(self.tokenizer, text if first or text[0] in _WHITE else " " + text)
            word = text.rstrip(_MARKS)
            if not word.isalpha():
                ids = b"".join(map(self.piece, _PIECE.findall(text if first or text[0] in _WHITE else " " + text)))
            elif len(word) == len(text):  # a word alone is one piece
                ids = self.merged(text if first else " " + text)
            else:  # a word and marks are two
                ids = self[(word,) if first else word] + self.piece(text[len(word) :])
        self[key] = ids
        return ids

    def merged(self, piece: str) -> bytes:
        return b"".join([self.serial[t.id] for t in self.merge("".join(map(self.letters.__getitem__, piece)))])

    def piece(self, p: str) -> bytes:
        if (got := self.pieces.get(p)) is None:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            got = self.pieces[p] = self.merged(p)
        return got

    def turn(self) -> None:
        """Two generations: when the young one is full it becomes the old one, so what is in use stays."""
        if len(self) > GENERATION:
            self.old = dict(self)
            self.clear()


class _Letters(dict):
    """A character: the letters that the vocabulary has for its bytes."""

    def __init__(self):
        super().__init__()
        self.of_byte = byte_letters()

    def __missing__(self, c: str) -> str:
        self[c] = out = "".join(self.of_byte[b] for b in c.encode())
        return out


def library_ids(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class LibraryEncoder:
    """The library's ids of whole texts.

    A plain byte-level BPE file: added tokens part a text, stretches are looked up, and the pieces of a new one go to the
    library's model. Long stretches, and whole texts where the file is any other, go to the library as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        try:
            check_spec(spec)
            self.plain = True
        except ValueError:
            self.plain = False
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.known = _Known(self.tokenizer) if self.plain else None

    def _encode(self, text: str) -> bytes:
        if not self.plain:
            return library_ids(self.tokenizer, text)
        if any(t in text for t in self.added):
            return b"".join(self.added[x] if x in self.added else self._encode(x) for x in self.parts.split(text) if x)
        return b"".join(map(self.known.__getitem__, stretches(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The serialized ids of each text."""
        if self.plain:
            self.known.turn()
        return [self._encode(t) if t else b"" for t in texts]


class _Serial(dict):
    def __missing__(self, i: int) -> bytes:
        self[i] = out = i.to_bytes(4, "little")
        return out


def stretches(text: str) -> list[str | tuple[str]]:
    """The stretches of a text (see bpe). A string without white space at its start stands for itself after one space;
    a stretch that has none before it, at the start of a text or a line, is in a tuple.

    Words with one space between them and lines without two empty ones in a row are cut by plain splits: a line feed or a
    pair of them before a word is a piece for each, and so is a single one at the end."""
    out, empty = [], False
    for k, line in enumerate(text.split("\n")):
        words = line.split()
        if " ".join(words) != line or (empty and not words):
            found = _STRETCH.findall(text)
            return found if found[0][0] in _WHITE else [(found[0],), *found[1:]]
        if k:
            out.append("\n")
        empty = not words
        if words:
            out.append((words[0],))
            out += words[1:]
    return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _zstd_dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train_dictionary(docs: DataFrame, path: str, p: TokenFileParams) -> bytes:
    """The dictionary's bytes; none if there is too little to train on."""
    chosen = docs.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(p.sample_docs)
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int32()), ("piece", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(path)
        for b in batches:
            rows = []
            for i, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                pieces = range(0, len(x), p.piece_bytes)
                step = max(1, -(-len(pieces) // p.sample_pieces))
                rows += [(i, k, x[a : a + p.piece_bytes]) for k, a in enumerate(pieces[::step])]
            yield record_batch({"doc_id": [r[0] for r in rows], "k": [r[1] for r in rows], "piece": [r[2] for r in rows]}, schema)

    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")
    rows = some.mapInArrow(cut, "doc_id bigint, k int, piece binary").orderBy(F.xxhash64("doc_id"), "doc_id", "k", "piece").limit(p.sample_docs * p.sample_pieces).collect()
    try:
        return zstandard.train_dictionary(p.dict_bytes, [bytes(r["piece"]) for r in rows], level=p.level).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_token_files(docs: DataFrame, tokenizer: str, p: TokenFileParams = TokenFileParams(), path: str | None = None) -> str:
    """Write the files and their manifest; returns the folder."""
    path = path or shared_dir(docs.sparkSession, "tokens")
    raw = train_dictionary(docs, tokenizer, p)
    write_bytes(f"{path}/dictionary", raw)
    packed = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("salt", pa.int32()), ("frame", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = library_encoder(tokenizer), np.array([p.end_id], dtype="<u4").tobytes()
        z = zstandard.ZstdCompressor(level=p.level, dict_data=_zstd_dict(raw))
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for b in batches:
            ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
            yield record_batch({"doc_id": b.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "crc": [zlib.crc32(x) for x in ids], "salt": rng.integers(0, 1 << 31, len(ids)), "frame": [z.compress(x) for x in ids]}, packed)

    frames = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pack, "doc_id bigint, n_tokens bigint, crc bigint, salt int, frame binary")
    frames = kept(frames, "frames")
    size = frames.agg(F.sum(F.length("frame")).alias("b")).first()["b"] or 0
    digest = hashlib.sha256(raw).digest()
    listed = pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("dictionary", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, offsets, counts, ids = None, 40, [], [], []
        name = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.tokens"
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                where, file = open_fs(f"{path}/{name}")
                where.create_dir(file.rpartition("/")[0], recursive=True)
                out = where.open_output_stream(file)
                out.write(MAGIC + digest)
            for x in b.column("frame"):
                offsets.append(at)
                at += out.write(x.as_buffer())
            counts += b.column("n_tokens").to_pylist()
            ids += b.column("doc_id").to_pylist()
        if out is None:
            return
        out.write(np.array([*offsets, at], dtype="<u8").tobytes())
        out.write(np.array(counts, dtype="<u8").tobytes())
        out.write(np.array([i or 0 for i in ids], dtype="<i8").tobytes())
        out.write(bytes(i is not None for i in ids))
        out.write(struct.pack("<QQ", len(ids), at))
        out.close()
        yield record_batch({"part": [TaskContext.get().partitionId()], "name": [name], "docs": [len(ids)], "tokens": [sum(counts)], "dictionary": [digest.hex()]}, listed)

    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "crc", "salt"]
    ordered = frames.repartitionByRange(int(size // p.file_bytes) + 1, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "n_tokens", "frame").mapInArrow(write, "part int, name string, docs bigint, tokens bigint, dictionary string").write.parquet(f"{path}/manifest")
    forget(frames)
    return path


def read_manifest(spark, path: str) -> DataFrame:
    """part, name, docs, tokens, dictionary and before, the tokens of all files before it: a row a file."""
    files = spark.read.schema("part int, name string, docs bigint, tokens bigint, dictionary string").parquet(f"{path}/manifest")
    # One partition, but of a few bytes for each file.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("before", F.coalesce(before, F.lit(0)))


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, uri: str, dictionary: bytes):
        where, path = open_fs(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        n, at = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        head = self.file.read_at(40, 0)
        if head[:8] != MAGIC or head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file of this dictionary")
        index = self.file.read_at(size - 16 - at, at)
        self.offsets = np.frombuffer(index, "<u8", n + 1).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n, 8 * (n + 1)).astype(np.int64)
        self.ids = np.frombuffer(index, "<i8", n, 8 * (2 * n + 1))
        self.valid = np.frombuffer(index, "u1", n, 8 * (3 * n + 1)).astype(bool)
        self.z = zstandard.ZstdDecompressor(dict_data=_zstd_dict(dictionary))

    def __len__(self) -> int:
        return len(self.counts)

    def __getitem__(self, k: int) -> np.ndarray:
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        return np.frombuffer(self.z.decompress(frame), dtype="<u4")


def read_dictionary(path: str) -> bytes:
    where, file = open_fs(f"{path}/dictionary")
    with where.open_input_stream(file) as f:
        return f.read()


def read_token_files(spark, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) and, if asked for, token_ids of every document, all from the files."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("token_ids", pa.list_(pa.int64()))] * ids
    schema = pa.schema(fields)
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for b in batches:
            for name, at in zip(b.column("name").to_pylist(), b.column("before").to_pylist(), strict=True):
                dictionary = read_dictionary(path) if dictionary is None else dictionary
                f = TokenFile(f"{path}/{name}", dictionary)
                starts = at + np.concatenate(([0], np.cumsum(f.counts)[:-1]))
                for k in range(0, len(f), 200):
                    top = min(len(f), k + 200)
                    found = [f[i] for i in range(k, top)]
                    sizes = np.array([len(x) for x in found], dtype=np.int64)
                    out = {"doc_id": pa.array(f.ids[k:top], mask=~f.valid[k:top]), "start": starts[k:top], "n_tokens": sizes, "ids_crc32": [zlib.crc32(x) for x in found]}
                    if ids:
                        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                        out["token_ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int64)))
                    yield record_batch(out, schema)

    files = read_manifest(spark, path).select("name", "before")
    files = files.repartition(max(1, files.count()), "name")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<bigint>" * ids)
