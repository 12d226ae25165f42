"""Language identification by hyperdimensional profiles.

Every letter (and the space that stands for anything else) has a fixed random vector of `dims` entries +1 and -1, drawn
from its code point. A trigram's vector binds its letters by place: the first letter's vector rotated twice, times the
second's rotated once, times the third's. A document's vector bundles (adds) the vectors of its trigrams, a language's
prototype those of all its training documents. The prediction is the language with the largest cosine.

Bundling is linear, so training counts trigrams by language with a grouped aggregation and binds each distinct trigram
once; what comes to the driver is languages x dims sums.

Cases. Text that is null or has no letter: `und`, score 0. No training rows: `und`, score 0. Ties: the language that
sorts first. Null doc_id: not held out. Repeated rows: a row each. More than max_languages labels: an error, as prototypes are
held by every task. Letters are those of str.isalpha after str.lower.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import record_batch

UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    dims: int = 1024
    seed: int = 7
    max_languages: int = 1000
    block: int = 64  # documents bundled at once


_letters: np.ndarray | None = None
_vectors: dict[tuple[int, int], dict[int, np.ndarray]] = {}


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters[codes]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, packed 21 bits a letter, and their counts. None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    letter = _is_letter(codes)
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate(([32], np.where(letter, codes, 32), [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def bound(grams: np.ndarray, p: LangParams) -> np.ndarray:
    """The trigrams' vectors, int8."""
    known = _vectors.setdefault((p.dims, p.seed), {})
    out = np.ones((len(grams), p.dims), dtype=np.int8)
    for turn, codes in ((2, grams >> 42), (1, grams >> 21 & 0x1FFFFF), (0, grams & 0x1FFFFF)):
        used, place = np.unique(codes, return_inverse=True)
        for c in used.tolist():
            if c not in known:
                if len(known) > 20_000:
                    known.clear()
                known[c] = (2 * np.random.Generator(np.random.PCG64([p.seed, c])).integers(0, 2, p.dims) - 1).astype(np.int8)
        out *= np.roll(np.stack([known[c] if c in known else bound_letter(c, p) for c in used.tolist()]), turn, axis=1)[place]
    return out


def bound_letter(code: int, p: LangParams) -> np.ndarray:
    return (2 * np.random.Generator(np.random.PCG64([p.seed, code])).integers(0, 2, p.dims) - 1).astype(np.int8)


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # a row of unit length for each language


def train(docs: DataFrame, p: LangParams = LangParams()) -> Prototypes:
    """Prototypes from text and lang of all rows with a lang."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts.setdefault(lang, []).append(trigrams(text))
            for lang, found in parts.items():
                grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                n = np.bincount(place, weights=np.concatenate([c for _, c in found]), minlength=len(grams)).astype(np.int64)
                yield record_batch({"lang": [lang] * len(grams), "gram": grams, "n": n}, schema)

    sums = pa.schema([("lang", pa.string()), ("dim", pa.int32()), ("v", pa.int64())])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, grams, n = np.array(b.column("lang").to_pylist()), b.column("gram").to_numpy(), b.column("n").to_numpy()
            for lang in np.unique(langs):
                at = np.flatnonzero(langs == lang)
                for k in range(0, len(at), 4096):
                    rows = at[k : k + 4096]
                    total[lang] = total.get(lang, 0) + n[rows].astype(np.float64) @ bound(grams[rows], p).astype(np.float64)
        for lang, v in total.items():
            yield record_batch({"lang": [str(lang)] * p.dims, "dim": np.arange(p.dims, dtype=np.int32), "v": v.astype(np.int64)}, sums)

    counted = docs.filter(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.mapInArrow(bundle, "lang string, dim int, v bigint").groupBy("lang", "dim").agg(F.sum("v").alias("v")).limit(p.max_languages * p.dims + 1).collect()
    if len(rows) > p.max_languages * p.dims:
        raise ValueError(f"more than {p.max_languages} languages")
    languages = sorted({r["lang"] for r in rows})
    vectors = np.zeros((len(languages), p.dims))
    for r in rows:
        vectors[languages.index(r["lang"]), r["dim"]] = r["v"]
    return Prototypes(languages, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12))


def predict(docs: DataFrame, model: Prototypes, p: LangParams = LangParams()) -> DataFrame:
    """doc_id, lang_pred and score, the cosine with the prototype, cut to 0..1."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names, scores = b.column("text").to_pylist(), [], []
            for k in range(0, len(texts), p.block):
                found = [trigrams(t) for t in texts[k : k + p.block]]
                cos = np.zeros((len(found), max(1, len(model.languages))))
                grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                if len(grams) and model.languages:
                    counts = np.zeros((len(found), len(grams)), dtype=np.float32)
                    counts[np.repeat(np.arange(len(found)), [len(g) for g, _ in found]), place] = np.concatenate([c for _, c in found])
                    vecs = np.zeros((len(found), p.dims))
                    for g in range(0, len(grams), 4096):
                        vecs += counts[:, g : g + 4096] @ bound(grams[g : g + 4096], p).astype(np.float32)
                    cos = vecs @ model.vectors.T / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
                best = cos.argmax(axis=1)
                for i, (g, _) in enumerate(found):
                    known = len(g) > 0 and bool(model.languages)
                    names.append(model.languages[best[i]] if known else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, cos[i, best[i]]))) if known else 0.0)
            yield record_batch({"doc_id": b.column("doc_id"), "lang_pred": names, "score": scores}, schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
