"""Quality rules: hashed n-gram log-likelihood ratio between a trusted-target and the raw-corpus multinomial.

Everything is a DataFrame expression; nothing leaves the JVM but the table of bucket weights, whose size is the
parameter `buckets`.

Model. Each word and each pair of consecutive words falls into one of `buckets` buckets (xxhash64). The raw
multinomial counts all documents. The target multinomial counts the trusted documents: at most `trusted_rows` rows of
labels with quality 1, those with the smallest hash of doc_id, so the choice does not depend on the order of rows. The
target is smoothed by a Dirichlet prior of weight prior * buckets centred on the raw multinomial: a bucket that the
trusted documents have never filled stays near the raw one. A document's score is the mean over its n-grams of
log p_target - log p_raw; it is kept if base_failed is false and the score is at least `threshold`.

The threshold -0.04 was read off labelled documents that pass the base rules: those of quality 1 score -0.02 or more but
for one in a thousand, those of quality 0 score below -0.09 but for one in ten. It is the geometric middle of these, the
same for every input.

Cases. Null or empty text: no words, all counts 0, base_failed, score 0. An empty table, or no trusted rows: all
weights are 0, the base rules alone decide. Repeated rows: each gets its own row. Other columns are ignored, except
that quality_filter returns the input's columns unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE_CHARS, SPACE_CLASS, let


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 16384
    prior: float = 20.0
    threshold: float = -0.04
    trusted_rows: int = 20_000
    min_words: int = 50
    max_repeat_percent: int = 50


SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def _buckets(ws: Column, p: QualityParams) -> Column:
    """The bucket of every word and of every pair of consecutive words."""
    n = F.lit(p.buckets).cast("bigint")
    ones = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), n).cast("int"))
    twos = F.transform(
        F.when(F.size(ws) > 1, F.sequence(F.lit(0), F.size(ws) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.pmod(F.xxhash64(F.get(ws, i), F.get(ws, i + 1)), n).cast("int"),
    )
    return F.concat(ones, twos)


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more. Sorting windows by (hash, place) brings equal ones
    together, so a window repeats if a neighbour has its hash; the places then give the length of their union."""
    grams = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def union(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            places = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
            return let(places, lambda ps: F.aggregate(F.transform(ps, lambda i, k: F.coalesce(F.least(F.get(ps, k + 1) - i, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(placed, union))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(grams, covered))


def ngram_weights(docs: DataFrame, labels: DataFrame, p: QualityParams) -> list[float]:
    """log p_target - log p_raw of each bucket, over all documents. Only `buckets` rows reach the driver."""
    trusted = (
        labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_trusted")).filter(F.col("_trusted").isNotNull()).distinct()
        .orderBy(F.xxhash64("_trusted"), "_trusted").limit(p.trusted_rows)
    )
    counts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(trusted), F.col("doc_id") == F.col("_trusted"), "left")
        .select(F.col("_trusted").isNotNull().cast("bigint").alias("t"), F.inline(F.transform(F.array(words_of(F.col("text"))), lambda ws: F.struct(_buckets(ws, p).alias("bs")))))
        .select("t", F.explode("bs").alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    )
    raw, target = [0] * p.buckets, [0] * p.buckets
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n_raw, n_target, prior = sum(raw), sum(target), p.prior * p.buckets
    if not n_target:
        return [0.0] * p.buckets
    base = [(c + 1) / (n_raw + p.buckets) for c in raw]
    return [math.log((c + prior * b) / (n_target + prior)) - math.log(b) for c, b in zip(target, base, strict=True)]


def quality_scores(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with word_chars, n_symbols, n_dup_lines, n_words, n_repeat_words, base_failed, kept and llr_score."""
    weights = F.split(F.lit(",".join(f"{w:.6f}" for w in ngram_weights(docs, labels, p))), ",").cast("array<double>")

    def measures(ws: Column, table: Column) -> Column:
        total = F.aggregate(_buckets(ws, p), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        grams = F.size(ws) + F.greatest(F.size(ws) - 1, F.lit(0))
        return F.struct(
            F.size(ws).cast("bigint").alias("_n_words"),
            _repeat_words(ws).cast("bigint").alias("_n_repeat"),
            F.when(grams > 0, total / grams).otherwise(F.lit(0.0)).alias("_score"),
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    base = docs.select(
        *[F.col(c) for c in keep],
        F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("_word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("_n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("_n_dup_lines"),
        F.inline(F.transform(F.array(words_of(text)), lambda ws: let(weights, lambda t: measures(ws, t)))),
    )
    failed = (F.col("_n_words") < p.min_words) | (100 * F.col("_n_repeat") > p.max_repeat_percent * F.col("_n_words"))
    return base.select(
        *keep,
        F.col("_n_words").alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("_score") >= p.threshold)).alias("kept"),
        F.col("_score").alias("llr_score"),
    )


def quality_filter(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The documents that the rules keep, with the columns they had."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("text"))
    return quality_scores(row, labels, p, keep=("_row",)).filter("kept").select("_row.*")
