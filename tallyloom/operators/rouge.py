"""ROUGE scores of predictions against references, as columns; stems and longest common subsequences need Python."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(ts: Column, n: int) -> Column:
    at = F.when(F.size(ts) >= n, F.sequence(F.lit(1), F.size(ts) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(ts, i, n), " "))


def f_measure(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    return F.when(hits > 0, 2.0 * hits / (n_pred + n_ref)).otherwise(F.lit(0.0))


def rouge_n(df: DataFrame, id_: str, pred: str, ref: str, n: int, stemmed: bool = False) -> DataFrame:
    """id and rouge: F1 of the n-gram multisets, counted by group so long texts stay distributed."""
    base = df.select(id_, *[(stem_words(tokens(F.col(c))) if stemmed else tokens(F.col(c))).alias(a) for c, a in ((pred, "_p"), (ref, "_r"))])
    side = lambda c, k: base.select(id_, F.explode(ngrams(F.col(c), n)).alias("g"), F.lit(k).alias("k"))
    per = side("_p", 0).unionByName(side("_r", 1)).groupBy(id_, "g").agg(F.sum(1 - F.col("k")).alias("p"), F.sum("k").alias("r"))
    sums = per.groupBy(id_).agg(F.sum(F.least("p", "r")).alias("hits"), F.sum("p").alias("np"), F.sum("r").alias("nr"))
    return df.select(id_).join(sums, id_, "left").select(id_, F.coalesce(f_measure(F.col("hits"), F.col("np"), F.col("nr")), F.lit(0.0)).alias("rouge"))


#: The extended form of Porter's algorithm that scorers use. Words with stems of their own, and for each step
#: the endings with what takes their place; the longest that fits decides. Steps 2 and 3 need a stem of measure above 0, step 4 above 1.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem_: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    return len(re.findall("v+c+", _shape(stem_)))


def _ends_short(word: str) -> bool:
    """Consonant, vowel, consonant, the last none of w, x, y; or two letters, vowel and consonant."""
    shape = _shape(word)
    return shape.endswith("cvc") and word[-1] not in "wxy" or shape == "vc"


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, endings: tuple, least: int) -> str:
    """The longest of the endings goes, if what is before it measures more than `least`."""
    for end, new in sorted(endings, key=lambda e: -len(e[0])):
        if word.endswith(end):
            head = word[: len(word) - len(end)]
            return head + new if _measure(head) > least and (end != "ion" or head.endswith(("s", "t"))) else word
    return word


def _no_plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _no_past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
    if cut is None:
        return word
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if _ends_double(cut):
        return cut if cut[-1] in "lsz" else cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _ends_short(cut) else cut


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replaced(word, STEP_2, 0)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a word by the extended form of Porter's algorithm. Words of up to three letters stay, as scorers leave them."""
    if len(word) <= 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = _no_past(_no_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1]).endswith("c"):
        word = word[:-1] + "i"
    word = _replaced(_second(word), STEP_3, 0)
    word = _replaced(word, tuple((e, "") for e in STEP_4), 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _ends_short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def _by_text(f, kind: T.DataType):
    """A column function of texts by f, a text at a time: lists of words exist for one row only, as a batch has thousands."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # of one column Spark gives the series itself
            yield pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype="int64" if kind == T.LongType() else object)

    return run


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def _parted(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


_stem_text = _by_text(lambda words: " ".join(map(stem, words.split())), T.StringType())


def stem_words(words: Column) -> Column:
    """The stems of words without white space, which no token has."""
    return _parted(_stem_text(_joined(words)))


def union_common(pred: list[list[str]], ref: list[list[str]]) -> int:
    """Words of the reference's sentences that lie in a longest common subsequence with some sentence of the prediction,
    each word of the prediction counted as often as it is there."""
    left, hits = Counter(w for s in pred for w in s), 0
    for r in ref:
        on: set[int] = set()
        for p in pred:
            on |= set(common_places(r, p))
        for i in sorted(on):
            if left[r[i]] > 0:
                left[r[i]] -= 1
                hits += 1
    return hits


def _masks(b: list[str]) -> dict[str, int]:
    """For each word the bits of its places."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    size = len(b) // 8 + 1
    out = {}
    for w, js in places.items():
        bits = bytearray(size)
        for j in js:
            bits[j >> 3] |= 1 << (j & 7)
        out[w] = int.from_bytes(bits, "little")
    return out


def _next(row: int, mask: int, full: int) -> int:
    """The row of the table of common lengths below `row`. Bit j of a row is 0 where the length grows from j to j + 1 words of b."""
    hit = row & mask
    return ((row + hit) | (row - hit)) & full


def common_length(a: list[str], b: list[str]) -> int:
    """The length of a longest common subsequence: a row of the table is one number, a word of a a few operations on it."""
    masks, full = _masks(b), (1 << len(b)) - 1
    row = full
    for w in a:
        if w in masks:
            row = _next(row, masks[w], full)
    return len(b) - row.bit_count()


def common_places(a: list[str], b: list[str]) -> list[int]:
    """Places in a of one longest common subsequence: from the ends, equal words are taken, else the last word of a goes
    unless that of b alone loses nothing more. Rows are kept at every sqrt(len(a))-th word and made again between."""
    masks, full = _masks(b), (1 << len(b)) - 1
    step = max(1, int(len(a) ** 0.5))
    kept, row = [full], full
    for i, w in enumerate(a):
        row = _next(row, masks.get(w, 0), full)
        if (i + 1) % step == 0:
            kept.append(row)
    out, i, j = [], len(a), len(b)
    first, rows = len(a) + 1, []

    def row_of(i: int) -> int:
        nonlocal first, rows
        if not first <= i < first + len(rows):
            first = i // step * step
            rows = [kept[i // step]]
            for w in a[first : min(first + step, len(a))]:
                rows.append(_next(rows[-1], masks.get(w, 0), full))
        return rows[i - first]

    grows = lambda i, j: not row_of(i) >> j & 1
    length = lambda i, j: j - (row_of(i) & ((1 << j) - 1)).bit_count()
    here, above = length(i, j), length(i - 1, j) if i else 0
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
            here, above = length(i, j), length(i - 1, j) if i else 0
            continue
        left = here - grows(i, j - 1)
        if left > above:
            above -= grows(i - 1, j - 1)
            here, j = left, j - 1
        else:
            i -= 1
            here, above = above, length(i - 1, j) if i else 0
    return out[::-1]


def _sentences(text: str, stemmed: bool) -> list[list[str]]:
    return [[stem(w) for w in line.split()] if stemmed else line.split() for line in text.split("\n")]


_union_stemmed = _by_text(lambda p, r: union_common(_sentences(p, True), _sentences(r, True)), T.LongType())
_union_plain = _by_text(lambda p, r: union_common(_sentences(p, False), _sentences(r, False)), T.LongType())
_lcs = _by_text(lambda p, r: common_length(p.split(), r.split()), T.LongType())
_lcs_stemmed = _by_text(lambda p, r: common_length([stem(w) for w in p.split()], [stem(w) for w in r.split()]), T.LongType())


def rouge_lsum(df: DataFrame, id_: str, pred: str, ref: str, stemmed: bool = True) -> DataFrame:
    """id and rouge: F1 of the union of common subsequences of sentences, which are lines."""
    lines = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), tokens)
    size = lambda x: F.size(F.flatten(x))
    text = lambda x: F.array_join(F.transform(x, _joined), "\n")
    p, r = lines(pred), lines(ref)
    return df.select(id_, f_measure((_union_stemmed if stemmed else _union_plain)(text(p), text(r)), size(p), size(r)).alias("rouge"))


def rouge_l(df: DataFrame, id_: str, pred: str, ref: str, stemmed: bool = False) -> DataFrame:
    p, r = tokens(F.col(pred)), tokens(F.col(ref))
    return df.select(id_, f_measure((_lcs_stemmed if stemmed else _lcs)(_joined(p), _joined(r)), F.size(p), F.size(r)).alias("rouge"))


def rouge_means(scores: dict[str, DataFrame]) -> DataFrame:
    """metric and mean of several score frames (id, rouge)."""
    out = None
    for name, df in scores.items():
        one = df.agg(F.lit(name).alias("metric"), F.avg("rouge").alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out
