import re
from collections import Counter

import pytest

from tallyloom.llm.quality_rules import QualityParams, ngram_weights, quality_filter, quality_scores
from tests.llm.helpers import AWKWARD, awkward, documents, with_clashes


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_columns_match_brute_force(spark, sf_dir):
    real = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [*AWKWARD, *real]
    got = {r["doc_id"]: r for r in quality_scores(with_clashes(documents(spark, texts)), labels(spark, [(0, 1, 0), (None, 1, 0)])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t
        assert r["kept"] in (False, not r["base_failed"])


def test_score_is_the_mean_log_ratio(spark):
    docs = documents(spark, ["good words here " * 20, "bad ### stuff " * 20, None])
    p = QualityParams(buckets=64)
    trust = labels(spark, [(0, 1, 0), (1, 0, 0), (7, 1, 0)])
    w = ngram_weights(docs, trust, p)
    got = {r["doc_id"]: r["llr_score"] for r in quality_scores(docs, trust, p).collect()}
    row = spark.sql(f"select transform(array('good','words','here'), x -> int(pmod(xxhash64(x), 64L))) u, transform(array(struct('good' a,'words' b),struct('words' a,'here' b),struct('here' a,'good' b)), x -> int(pmod(xxhash64(x.a,x.b), 64L))) v").first()
    expect = (20 * (w[row.u[0]] + w[row.u[1]] + w[row.u[2]]) + 20 * (w[row.v[0]] + w[row.v[1]]) + 19 * w[row.v[2]]) / 119
    assert got[0] == pytest.approx(expect, abs=1e-5)
    assert got[0] > 0 > got[1] and got[2] == 0


def test_awkward_rows_and_empty_tables(spark):
    docs = with_clashes(awkward(spark))
    trust = labels(spark, [(12, 1, 0), (12, 1, 0), (None, 0, 0)])
    assert quality_scores(docs, trust).count() == docs.count()
    assert quality_scores(docs.limit(0), trust).count() == 0
    assert quality_scores(docs, trust.limit(0)).filter("kept").count() == quality_scores(docs, trust.limit(0)).filter("not base_failed").count()
    out = quality_filter(docs, trust)
    assert out.columns == docs.columns


def test_separates_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_scores(docs, lab).join(lab, "doc_id").filter("n_words >= 50").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
