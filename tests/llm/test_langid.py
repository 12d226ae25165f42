import zlib
from collections import Counter
from functools import lru_cache

import numpy as np

from tallyloom.llm.langid import LangParams, bound, predict, train, trigrams
from tallyloom.llm.queries import op10_language_id
from tests.llm.helpers import awkward, documents, with_clashes


def brute_vector(text, p):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + " ".join(low.split(" ")).strip() + " "
    while "  " in low:
        low = low.replace("  ", " ")
    letter = lambda c: (2 * np.random.Generator(np.random.PCG64([p.seed, ord(c)])).integers(0, 2, p.dims) - 1).astype(np.int64)
    v = np.zeros(p.dims, dtype=np.int64)
    for a, b, c in zip(low, low[1:], low[2:]):
        v += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return v


def test_bundles_match_brute_force():
    p = LangParams(dims=64)
    for t in ("Hello, World! 42 again", "aa", "über  straße\n\nnoch", "a"):
        grams, n = trigrams(t)
        assert (n @ bound(grams, p).astype(np.int64) == brute_vector(t, p)).all()


def test_prediction_is_the_largest_cosine(spark):
    p = LangParams(dims=128)
    texts = ["the cat and the dog", "der hund und die katze", "le chien et le chat", "the end of the day"]
    docs = documents(spark, texts, langs=["en", "de", "fr", "en"])
    model = train(docs, p)
    assert model.languages == ["de", "en", "fr"]
    proto = {"de": brute_vector(texts[1], p), "en": brute_vector(texts[0], p) + brute_vector(texts[3], p), "fr": brute_vector(texts[2], p)}
    for r in predict(documents(spark, ["the dog and the end", "und der hund"]), model, p).collect():
        v = brute_vector(["the dog and the end", "und der hund"][r["doc_id"]], p)
        cos = {k: v @ x / np.linalg.norm(v) / np.linalg.norm(x) for k, x in proto.items()}
        assert r["lang_pred"] == max(cos, key=cos.get) and abs(r["score"] - max(cos.values())) < 1e-5


def brute_grams(text):
    low = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    return Counter(zip(low, low[1:], low[2:]))


@lru_cache(maxsize=None)
def brute_bound(gram, dims, seed):
    letter = lambda c: (2 * np.random.Generator(np.random.PCG64([seed, ord(c)])).integers(0, 2, dims) - 1).astype(np.int64)
    a, b, c = gram
    return np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)


def test_query_matches_brute_force(spark, sf_dir):
    """Every document of the table: prototypes of the training fold and cosines, from the definition."""
    p = LangParams()
    bundle = lambda grams: sum((n * brute_bound(g, p.dims, p.seed) for g, n in grams.items()), np.zeros(p.dims, dtype=np.int64))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    proto: dict = {}
    for i, r in docs.items():
        if not held[i] and r["lang"] is not None:
            proto.setdefault(r["lang"], Counter()).update(brute_grams(r["text"]))
    unit = {k: bundle(g) / np.linalg.norm(bundle(g)) for k, g in proto.items()}
    rows = op10_language_id(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        grams = brute_grams(docs[r["doc_id"]]["text"])
        assert r["held_out"] == held[r["doc_id"]]
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = bundle(grams)
        cos = {k: float(v @ x / np.linalg.norm(v)) for k, x in unit.items()}
        assert cos[r["lang_pred"]] >= max(cos.values()) - 1e-6 and abs(r["score"] - min(1.0, max(0.0, max(cos.values())))) < 1e-5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").filter("held_out and length(text) > 40").select("lang", "lang_pred").collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    model = train(docs)
    rows = predict(docs, model).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == "und" and by[19]["lang_pred"] == "und" and by[18]["lang_pred"] == "en"
    empty = train(docs.limit(0))
    assert {r["lang_pred"] for r in predict(docs, empty).collect()} == {"und"}
    assert predict(docs.limit(0), model).count() == 0
