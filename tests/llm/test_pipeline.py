import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm.common import table
from tallyloom.llm.quality_rules import quality_scores
from tallyloom.llm.secret_scan import EntropyParams, find_spans
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_decontaminate import words
from tests.llm.test_similar import brute_jaccard

HF = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def test_run_matches_a_plain_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    keep = {r["doc_id"] for r in quality_scores(docs, table(spark, sf_dir, "labels")).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in keep}
    assert 0.6 * docs.count() < len(texts) < docs.count()
    lead = brute_jaccard(texts)
    texts = {d: t for d, t in texts.items() if lead[d] == d}
    items = [(str(r["item_id"]), words(r["text"])) for r in table(spark, sf_dir, "benchmark").collect()]
    items = [(i, w) for i, w in items if len(w) >= 10]
    left, cut = {}, 0
    for d, t in texts.items():
        hit, _ = leaks(words(t), items)
        if len(hit) > 0.8 * len(words(t)):
            continue
        if hit:
            cut += 1
            at, out, end = [m.span() for m in WORD.finditer(t)], "", 0
            runs = [(s, next(e for e in range(s, len(at) + 1) if e not in hit)) for s in sorted(hit) if s - 1 not in hit]
            for s, e in runs:
                out += t[end : at[s][0]].rstrip(" ")
                end = at[e - 1][1]
            t = out + t[end:]
        left[d] = t
    p = EntropyParams()
    allow = [re.compile(a) for a in p.allow]
    for d, t in left.items():
        hidden = sorted({i for s, _, e in find_spans(t, p, allow) for i in range(s, e)}, reverse=True)
        marks = set(hidden)
        for i in hidden:
            t = t[:i] + ("[SECRET]" if i - 1 not in marks else "") + t[i + 1 :]
        left[d] = t
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert cut and rows.keys() == left.keys()
    for d, t in left.items():
        assert rows[d]["token_ids"] == HF.encode(t, add_special_tokens=False).ids and rows[d]["round_trip"]


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
