import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm.queries import op2_token_files
from tallyloom.llm.token_files import LibraryEncoder, TokenFile, TokenFileParams, read_dictionary, read_manifest, read_token_files, write_token_files
from tests.llm.helpers import awkward, documents, with_clashes

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
HF = Tokenizer.from_file(PATH)


def ids_of(t):
    return [*HF.encode(t or "", add_special_tokens=False).ids, 0]


def test_query_round_trip(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in op2_token_files(spark, sf_dir).collect()}
    start = 0
    for d, t in docs:
        ids = ids_of(t)
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_many_files_and_single_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    path = write_token_files(docs, PATH, TokenFileParams(file_bytes=40_000))
    manifest = read_manifest(spark, path).orderBy("part").collect()
    assert len(manifest) > 2 and [m["before"] for m in manifest] == [sum(x["tokens"] for x in manifest[:k]) for k in range(len(manifest))]
    raw = read_dictionary(path)
    assert raw
    texts, seen = {r["doc_id"]: r["text"] for r in docs.collect()}, []
    for m in manifest:
        f = TokenFile(f"{path}/{m['name']}", raw)
        assert len(f) == m["docs"] and f[len(f) // 2].tolist() == ids_of(texts[int(f.ids[len(f) // 2])])
        seen += f.ids.tolist()
    assert seen == sorted(texts)


def test_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    rows = read_token_files(spark, write_token_files(docs, PATH)).collect()
    want = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, ids_of(r["text"])) for r in docs.collect()], key=lambda x: (x[0], x[1], len(x[2])))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["token_ids"]) for r in sorted(rows, key=lambda r: r["start"])] == want
    assert read_token_files(spark, write_token_files(docs.limit(0), PATH)).count() == 0
    assert read_token_files(spark, write_token_files(documents(spark, ["only one"]), PATH)).first()["token_ids"] == ids_of("only one")


def test_rows_of_one_id_go_to_many_files(spark):
    texts = [f"some words {i} " * 40 for i in range(300)] + ["the very same"] * 300
    path = write_token_files(documents(spark, texts, [5] * 600), PATH, TokenFileParams(file_bytes=3000))
    assert max(m["docs"] for m in read_manifest(spark, path).collect()) < 300
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(600)]
    assert sorted(r["token_ids"] for r in rows) == sorted(map(ids_of, texts))


def test_files_beside_the_manifest_are_not_read(spark):
    path = write_token_files(documents(spark, ["one", "two"]), PATH)
    with open(path.removeprefix("file://") + "/part-0000000-left.tokens", "wb") as f:
        f.write(b"what a lost attempt has left")
    assert read_token_files(spark, path).count() == 2


@pytest.mark.parametrize("generation", [1, 500_000])
def test_stretches_give_the_ids_of_whole_texts(monkeypatch, generation):
    monkeypatch.setattr("tallyloom.llm.token_files.GENERATION", generation)
    monkeypatch.setattr("tallyloom.llm.token_files.PIECES", 20)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "\u4e2d", "1", "'s", "'", ".", "$$", "foo!", "é!!", "\x1c", "\x85", "\u3000", "<|endoftext|>", "_", "x" * 3000]
    rnd, enc = random.Random(7), LibraryEncoder(PATH)
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(4000)] + [None, "", "\n", "one\n\ntwo\n", " one", "one "]
    for k in range(0, len(texts), 100):
        for t, ids in zip(texts[k : k + 100], enc.encode(texts[k : k + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(t)[:-1], t


def test_other_tokenizer_files_get_whole_texts(tmp_path):
    spec = json.load(open(PATH))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(spec))
    enc = LibraryEncoder(str(tmp_path / "lower.json"))
    assert not enc.plain and np.frombuffer(enc.encode(["Some WORDS here"])[0], "<u4").tolist() == ids_of("some words here")[:-1]
