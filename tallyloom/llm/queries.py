"""The queries over the tables that apply the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.oracle import ORACLE_SQL  # noqa: F401  read with QUERIES


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.quality_rules import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def byte_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _sha(strings: Column) -> Column:
    return F.sha2(F.array_join(strings, ","), 256)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.decontaminate import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leak_spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "leak_items").select(
        "doc_id", "n_words", "n_hit", F.size("leak_items").cast("bigint").alias("n_items"), _sha(F.col("leak_items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.token_files import read_token_files, write_token_files

    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), byte_bpe_path()), ids=False)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.bpe import encode_documents

    both = encode_documents(table(spark, sf_dir, "documents"), byte_bpe_path(), decoded=True)
    return both.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), _sha(F.col("token_ids").cast("array<string>")).alias("ids_sha256"), F.sha2("decoded_text", 256).alias("decoded_sha256")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.sharding import size_of, write_shards

    return write_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.kneser_ney import score_documents, train_model

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train_model(docs.filter(~held_out))
    return score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.secret_scan import secret_spans

    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    shown = lambda xs: F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        _sha(shown(F.filter(spans, lambda s: s["kind"] != "entropy"))).alias("base_sha256"), F.array_join(shown(spans), ",").alias("spans"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.license_scan import license_scan

    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = predict(docs, train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.merkle import fold, leaf_of, merkle_manifest

    lowered = leaf_of(text=F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = merkle_manifest(table(spark, sf_dir, "documents"), {"shown_leaf": F.when(tampered, lowered).otherwise(leaf_of())})
    steps = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(steps, 256).alias("proof_sha256"), fold(F.col("shown_leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.suffix_dedup import cut_repeats

    return cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def _with_period(docs: DataFrame) -> DataFrame:
    """docs with a stretch of words in one text of ten, by its id, that repeats: words from a on are those of a .. a + p - 1 again and again."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("w").cast("bigint")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    some = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("some")).withColumn("w", F.when(F.col("some"), words))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))), " ")
    made = F.col("some") & (n > 0)
    return some.withColumn("a", F.when(made, a)).withColumn("p", F.when(made, p)).select("doc_id", F.when(made, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.periodic_runs import periodic_runs

    found = periodic_runs(_with_period(table(spark, sf_dir, "documents")))
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("r.length") / F.col("r.period"))
    return found.select("doc_id", "n_runs", "r.start", "r.length", "r.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_files": op2_token_files,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_secret_scan": op8_secret_scan,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_merkle": op11_merkle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
