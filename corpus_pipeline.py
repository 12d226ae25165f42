"""Documents made ready for training: quality rules, near-duplicate removal, decontamination, secret scan, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. A stage works on all that its predecessor kept:

1. quality rules: documents that the rules reject go.
2. near-dedup by the exact similarity of shingle sets: one document of each group stays, that with the smallest doc_id.
3. benchmark decontamination: leaked spans are cut out; documents that are almost all leak go.
4. secret scan: secrets are replaced by a mark.
5. BPE: token ids of what is left, and whether decoding them gives the text back.

Stages 1 to 4 return the columns of documents; n_chars follows the text. ORACLE_SQL is None: SQL expresses neither
SimHash components nor BPE; the tests hold run() against a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe import encode_documents
from tallyloom.llm.common import kept, table
from tallyloom.llm.decontaminate import remove_leaks
from tallyloom.llm.quality_rules import quality_filter
from tallyloom.llm.queries import byte_bpe_path
from tallyloom.llm.secret_scan import redact
from tallyloom.llm.similar import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(remove_leaks(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(redact(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip. A null text has no tokens and comes back as the empty text, which counts as its own."""
    both = encode_documents(docs, byte_bpe_path(), keep_text=True, decoded=True)
    return both.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", (F.col("decoded_text") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scan", secrets),
    ("bpe", bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
