import re

from tallyloom.llm.license_scan import PHRASES, TEMPLATES, license_scan
from tallyloom.llm.queries import op9_license_scan
from tests.llm.helpers import AWKWARD, awkward, documents, with_clashes

K, SLACK, COVERAGE, STRETCH = 3, 3, 0.6, 0.5


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(t):
    ws = words(t)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    base = {x for _, x in places}
    score, verified = 0.0, []
    for label, text in TEMPLATES:
        tw = words(text)
        n = len(tw) - K + 1
        votes = {}
        for p in range(len(ws) - K + 1):
            for q in range(n):
                if ws[p : p + K] == tw[q : q + K]:
                    votes.setdefault(p - q, []).append((p, q))
        runs, prev = [], None
        for d in sorted(votes):
            if prev is None or d - prev > SLACK:
                runs.append([])
            runs[-1] += votes[d]
            prev = d
        for run in runs:
            cover = len({q for _, q in run}) / n
            score = max(score, cover)
            first, last = min(p for p, _ in run), max(p for p, _ in run) + K - 1
            if cover >= COVERAGE and last + 1 - first <= len(tw) * (1 + STRETCH) + SLACK:
                verified.append((label, cover, first, last))
    labels = base | {a for a, c, f, l in verified if not any(a != b and c < d and f <= m and g <= l for b, d, g, m in verified)}  # noqa: E741
    at = [i for i, _ in places]
    return len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


MORE = [
    "MIT License mit license MIT-License", "general public license apache license", "x " * 50 + TEMPLATES[5][1] + " y" * 50, "License", "the mit  LICENSE. and public license",
    TEMPLATES[12][1].replace("binary", "object code").replace("permitted", ""), "Licensed under CC BY-NC 3.0. Licensed under CC BY-NC 4.0.", " ".join(TEMPLATES[1][1].split()[:12]), "This worK is licensed under a Creative Commons Attribution", (TEMPLATES[13][1] + " ") * 40, "Mİt license kelvin Kit",
]


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_matches_brute_force(spark):
    texts = [*AWKWARD, *MORE]
    got = rows_of(license_scan(with_clashes(documents(spark, texts))))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"]), ",".join(r["labels"]), r["score"]) == brute(t), t


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").filter("doc_id % 5 = 0 or text like '%icense%'").collect()}
    got = rows_of(op9_license_scan(spark, d))
    assert len(got) == 1000
    for i, t in texts.items():
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute(t), t
    assert any("cc-by-nc" in r["labels"] for r in got.values())


def test_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    assert license_scan(docs).count() == docs.count() and license_scan(docs.limit(0)).count() == 0
    twice = documents(spark, [MORE[0], MORE[0], None], [5, 5, None])
    assert [len(r["labels"]) for r in license_scan(twice).orderBy("doc_id").collect()] == [0, 1, 1]


def test_notices_of_a_family_are_told_apart(spark):
    by = {label: text for label, text in TEMPLATES}
    gpl = "under the terms of the GNU General Public License as published by the Free Software Foundation"
    texts = [gpl, f"words before. It is free software: you can use it {gpl}, and words after", by["lgpl"], by["agpl"], by["cc-by"], by["cc-by-sa"], by["cc-by-nc"], f"{by['cc-by-sa']} {'filler ' * 9} {by['mpl']}"]
    got = rows_of(license_scan(documents(spark, texts)))
    assert [",".join(got[i]["labels"]) for i in range(len(texts))] == ["gpl", "gpl", "gpl,lgpl", "agpl,gpl", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-sa,mpl"]
