"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Patterns (kinds assign, access, hex) are found leftmost and non-overlapping per kind. Entropy spans come on top: a
candidate is a run of `CANDIDATE` characters; a window of the class's width slides over it with counts kept
incrementally (one character in, one out), so its entropy costs constant time a step. Windows at or above the class's
threshold that hold at least two of small letters, capitals and digits are merged into spans. A candidate of hex digits
only is judged by the class "hex", any other by "base64". Candidates that an allow-list pattern matches whole are left
alone.

Spans are half-open in code points, sorted by start, then kind in the order of `KINDS`.

Cases. Null or empty text: no spans. Very long runs: one pass, constant work space. Repeated rows: a row each. Other
columns are ignored; redact keeps them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import record_batch

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_WORDS = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ALL_HEX = re.compile(r"[0-9a-fA-F]+")


@dataclass(frozen=True)
class EntropyParams:
    """For each character class the window's width and the least entropy in bits a character."""

    width: dict = field(default_factory=lambda: {"hex": 20, "base64": 20})
    least: dict = field(default_factory=lambda: {"hex": 3.0, "base64": 3.8})
    #: A candidate that one of these matches from end to end is no secret: UUIDs, plain numbers, words joined by - _ /, runs of one character, alphabets.
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        r"[0-9_+/=-]+",
        r"[A-Za-z_/=+-]+[0-9]{0,4}",
        r"(.)\1*",
        r"(?i:.*(?:abcdefghijkl|0123456789abcdef|example|placeholder|changeme).*)",
    )


def windows_above(run: str, width: int, least: float) -> list[tuple[int, int]]:
    """The merged windows of the run with entropy >= least and two kinds of characters."""
    width = min(width, len(run))
    gain = [(c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0) for c in range(width + 1)]
    # gain[c]: what c log2 c grows by from c to c + 1
    counts: dict[str, int] = {}
    group = [0, 0, 0]
    kind = lambda ch: 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else -1
    total, found = 0.0, []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += gain[c]
        counts[ch] = c + 1
        if (k := kind(ch)) >= 0:
            group[k] += 1
        if i >= width:
            old = run[i - width]
            c = counts[old] - 1
            total -= gain[c]
            counts[old] = c
            if (k := kind(old)) >= 0:
                group[k] -= 1
        if i >= width - 1 and sum(g > 0 for g in group) >= 2 and math.log2(width) - total / width >= least - 1e-9:
            start, end = i - width + 1, i + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], end)
            else:
                found.append((start, end))
    return found


def find_spans(text: str | None, p: EntropyParams, allow: list[re.Pattern]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, sorted."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        if run.isalpha() or any(a.fullmatch(run) for a in allow):
            continue
        cls = "hex" if _ALL_HEX.fullmatch(run) else "base64"
        out += [(m.start() + a, 3, m.start() + b) for a, b in windows_above(run, p.width[cls], p.least[cls])]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def secret_spans(docs: DataFrame, p: EntropyParams = EntropyParams()) -> DataFrame:
    """doc_id and secret_spans, an array of (kind, start, end)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("secret_spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = [re.compile(a) for a in p.allow]
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, k, e in find_spans(t, p, allow)] for t in b.column("text").to_pylist()]
            yield record_batch({"doc_id": b.column("doc_id"), "secret_spans": spans}, schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, secret_spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, p: EntropyParams = EntropyParams(), mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each union of overlapping spans in text replaced by mark. Null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        allow = [re.compile(a) for a in p.allow]

        def one(text):
            merged: list[list[int]] = []
            for s, _, e in find_spans(text, p, allow):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            for s, e in reversed(merged):
                text = text[:s] + mark + text[e:]
            return text

        return texts.map(one)

    return docs.withColumn("text", clean("text"))
