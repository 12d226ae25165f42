import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyloom.operators import clustering as cl
from tallyloom.operators import models, rouge, tables, tasks
from tallyloom.sources import readers, sinks
from tallyloom.streaming import snapshots


def test_linkage_and_cut():
    d = cl.distances(np.array([[1, 0], [1, 0.01], [0, 1], [0.01, 1]]))
    assert cl.cut(cl.linkage(d), 4, 0.5).tolist() == [0, 0, 1, 1]
    assert cl.best_cut(d).tolist() == [0, 0, 1, 1]


def test_every_item_gets_one_cluster():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 17, 40):
        labels = cl.cluster(cl.distances(rng.normal(size=(n, 6))))
        assert len(labels) == n and sorted(set(labels)) == list(range(labels.max() + 1))


def test_average_linkage_matches_mean_distance():
    rng = np.random.default_rng(1)
    d = cl.distances(rng.normal(size=(12, 4)))
    groups = {i: [i] for i in range(12)}
    for height, a, b in cl.linkage(d):
        assert np.isclose(height, np.mean([d[i, j] for i in groups[a] for j in groups[b]]))
        groups[a] += groups.pop(b)


def test_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, "", "x"), (3, "a b c d", "a c d b")], "id long, p string, r string")
    f1 = lambda d: {r["id"]: round(r["rouge"], 4) for r in d.collect()}
    assert f1(rouge.rouge_n(df, "id", "p", "r", 1)) == {1: 0.6667, 2: 0.0, 3: 1.0}
    assert f1(rouge.rouge_n(df, "id", "p", "r", 2)) == {1: 0.5, 2: 0.0, 3: 0.3333}
    assert f1(rouge.rouge_l(df, "id", "p", "r")) == {1: 0.6667, 2: 0.0, 3: 0.75}


def test_renumber_is_gapless(spark):
    got = [r["n"] for r in tables.renumber(spark.range(1000).repartition(7), [F.col("id")]).orderBy("id").collect()]
    assert got == list(range(1000))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", "10:00:00", "10:00:02", 0.5, "Command", "echo a, b")], "date string, open string, close string, minutes double, type string, name string")
    sinks.tabs(df, str(tmp_path / "t"))
    assert readers.activity_tabs(readers.ordered_lines(spark, str(tmp_path / "t"))).first()["name"] == "echo a, b"
    sinks.lines(df, str(tmp_path / "c"))
    assert readers.activity_commas(readers.ordered_lines(spark, str(tmp_path / "c"))).first()["name"] == "echo a, b"
    sinks.jsonl(df, str(tmp_path / "j"))
    sinks.jsonl(df, str(tmp_path / "j"), mode="append")
    assert readers.jsonl(spark, str(tmp_path / "j"), "name string").count() == 2
    sinks.semicolons(df, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), sep=";", header=True).columns == df.columns


def test_stream_of_snapshots(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    q = snapshots.window_changes(spark.readStream.schema(snapshots.ROW).json(str(src))).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, windows in enumerate((["a", "b"], ["a", "c", "c"], ["c"])):
            pd.DataFrame([{"ts": f"2024-01-01T10:00:0{k}Z", "host": "h", "windows": windows}]).to_json(src / f"{k}.json", orient="records", lines=True)
            q.processAllAvailable()
        got = sorted((r["ts"].second, r["kind"], r["window"]) for r in spark.sql("select * from changes").collect())
    finally:
        q.stop()
    assert got == [(1, "closed", "b"), (1, "opened", "c"), (1, "opened", "c"), (2, "closed", "a"), (2, "closed", "c")]


def test_stems_and_lsum(spark):
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "falling": "fall", "happy": "happi", "sky": "sky", "sized": "size", "conflated": "conflat", "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
                       "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formality": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
                       "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "cease": "ceas", "controller": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}.items():
        assert rouge.stem(word) == want
    df = spark.createDataFrame([(1, "cats running", "the cat runs\nagain"), (2, "a b\nc d", "c d\na b")], "id long, p string, r string")
    f1 = lambda d: {r["id"]: round(r["rouge"], 4) for r in d.collect()}
    assert f1(rouge.rouge_n(df, "id", "p", "r", 1, stemmed=True)) == {1: 0.6667, 2: 1.0}
    assert f1(rouge.rouge_l(df, "id", "p", "r", stemmed=True)) == {1: 0.6667, 2: 0.5}
    assert f1(rouge.rouge_lsum(df, "id", "p", "r")) == {1: 0.6667, 2: 1.0}


def test_models_plug_in(spark):
    df = spark.createDataFrame([("Command", "ls -l"), ("directory/App", "x")], "type string, name string")
    assert [r["description"] for r in models.describe_activity(df, lambda ps: [p.upper() for p in ps]).collect()][0].startswith("DESCRIBE THE SHELL COMMAND: LS -L")
    assert models.describe_activity(df).columns == ["type", "name", "description"]
    v = models.encode_texts(df.withColumn("id", F.col("name")), "name")
    assert all(r["agrees"] for r in models.stored_vectors_agree(v, v, "id").collect())


def test_linkage_picks_the_lowest_of_equal_pairs():
    """The same merges as a search of the whole matrix at each step, ties included."""
    rng = np.random.default_rng(6)
    for n in (2, 3, 9, 25):
        for d in (cl.distances(rng.normal(size=(n, 5))), np.abs(np.subtract.outer(*[rng.integers(0, 4, n)] * 2)).astype(float), np.ones((n, n))):
            own, size, want = d.copy(), np.ones(n), []
            np.fill_diagonal(own, np.inf)
            for _ in range(n - 1):
                a, b = sorted(divmod(int(np.argmin(own)), n))
                want.append((own[a, b], a, b))
                row = (size[a] * own[a] + size[b] * own[b]) / (size[a] + size[b])
                own[a], own[:, a] = row, row
                own[a, a] = own[b] = np.inf
                own[:, b] = np.inf
                size[a] += size[b]
            assert cl.linkage(d) == want


def test_first_containing_keeps_repeated_rows(spark, monkeypatch):
    items = spark.createDataFrame([(1, "A b c"), (1, "A b c"), (2, "none"), (3, None)], "id long, text string")
    known = spark.createDataFrame([(1, "c"), (0, "B"), (2, "a")], "o int, kw string")
    for most in (10_000, 1):
        monkeypatch.setattr(tables, "PATTERNS_AT_ONCE", most)
        got = tables.first_containing(items, known, "text", "kw", "o").collect()
        assert sorted((r["id"], r["kw"]) for r in got if r["kw"]) == [(1, "B"), (1, "B")] and len(got) == 4


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.5, 5.0, 9.9, 10.0, None, -3.0, 12.0)], "x double")
    count = lambda *a: {r["bin"]: r["n"] for r in tables.histogram(df, F.col("x"), *a).collect()}
    assert count(2, 0.0, 10.0) == {0: 1, 1: 3, 2: 3, 3: 1} and sum(count(30).values()) == 8 and count(1) == {1: 8}
    assert tables.histogram(df.limit(0), F.col("x"), 3).count() == 0


def test_lines_of_a_large_file_keep_their_order(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {i}" + " x" * (i % 50) for i in range(5000)))
    (tmp_path / "small.txt").write_text("a\n\nb\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.ordered_lines(spark, str(tmp_path))
        got = [r["value"].split(" x")[0] for r in rows.filter("source like '%big.txt'").orderBy("pos").collect()]
        assert got == [f"line {i}" for i in range(5000)] and rows.select("source", "pos").distinct().count() == 5003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_later_pairs_do_not_depend_on_the_block(spark):
    rows = [(g, i, f"{g}{i // 2}" if i % 5 else None) for g, n in (("a", 23), ("b", 1), ("c", 8)) for i in range(n)] + [(None, 0, "x"), (None, 1, "y"), ("d", 0, "same"), ("d", 0, "same")]
    items = spark.createDataFrame(rows, "g string, pos int, text string").repartition(5)
    want = []
    for g in ("a", "b", "c", "d", None):
        texts = [t for k, _, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])]
        want += [(g, texts[i], texts[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    for block in (1, 4, 1000):
        got = [tuple(r) for r in tasks.later_pairs(items, "g", "pos", "text", block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
