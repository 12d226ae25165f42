import pytest
from pyspark.sql import functions as F

from tallyloom.sources import readers, rejects, sinks


def lines(spark, values):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "source string, pos int, value string")


@pytest.mark.parametrize(("kind", "good", "bad"), [
    ("events", ["2024-01-01 10:00:00 a title", "2024-01-02 1:0:0 x y z"], ["2024-01-01 10:00:00", "nothing", "soon 10:00:00 t"]),
    ("intervals", ["2024-01-01  10:00:00 10:01:00 t u"], ["2024-01-01 10:00:00 10:01:00", "x 1 2 t"]),
    ("activity_commas", ["2024-01-01, 10:00:00, 10:00:02, 0.5, Command, echo a, b"], ["2024-01-01, 10:00:00", "2024-01-01, 1, 2, many, Command, x", "x, 1, 2, 0.5, Command, x"]),
    ("activity_tabs", ["2024-01-01\t1\t2\t0.5\tCommand\tls", ""], ["2024-01-01\t1\t2", "2024-01-01\t1\t2\tx\tCommand\tls"]),
    ("history", ["#1700000000", "ls", "", "cd"], ["# note", "#x"]),
])
def test_bad_lines_are_counted_and_kept(spark, kind, good, bad):
    frame = lines(spark, [*good, *bad])
    assert [r["value"] for r in rejects.rejected(frame, kind).orderBy("pos").collect()] == bad
    seen_lines, seen = rejects.observed(frame, kind)
    read = getattr(readers, kind)(seen_lines)
    read.write.format("noop").mode("overwrite").save()
    assert seen.get == {"lines": len(good) + len(bad), "bad": len(bad)} or kind == "history"
    if kind == "history":  # its scan reads the lines twice
        assert seen.get["bad"] in (len(bad), 2 * len(bad))


def test_bad_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"name": "x", "n": 1}\n{"name": \n\nno json\n{"name": "y", "n": "many"}\n{"name": "z"}\n')
    rows, bad = rejects.jsonl(spark, str(tmp_path / "a.jsonl"), "name string, n int")
    assert sorted((r["name"], r["n"]) for r in rows.collect() if r["n"] is not None) == [("x", 1)]
    assert {r["name"] for r in rows.collect()} == {"x", "z"}
    assert sorted(r["value"] for r in bad.collect()) == ['no json', '{"name": ', '{"name": "y", "n": "many"}']


def test_bad_dictionary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ls": [{"description": "List", "cmd": "ls -l"}]}')
    (tmp_path / "b.json").write_text('{"ls": [')
    (tmp_path / "c.json").write_text("[1, 2]")
    rows, bad = rejects.dictionary(spark, str(tmp_path))
    assert [r["pattern"] for r in rows.collect()] == ["ls -l"]
    assert sorted((r["file"].rpartition("/")[2], r["bytes"]) for r in bad.collect()) == [("b.json", 8), ("c.json", 6)]


DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _activity(spark, n, first=0):
    return spark.range(first, first + n).select(F.lit(1700000000).alias("epoch"), F.lit("2024-01-01").alias("day"), F.concat(F.lit("cmd "), F.col("id").cast("string")).alias("name"))


def test_jdbc_batches_are_repeated_without_doubles(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sinks.commands_jdbc(_activity(spark, 5), url, "plain", DERBY)
    assert spark.read.jdbc(url, "plain", properties=DERBY).count() == 5
    for batch, n in ((0, 7), (1, 4), (1, 4), (0, 7), (2, 0)):
        sinks.batch_jdbc(_activity(spark, n, 100 * batch), batch, url, "commands", DERBY)
    back = spark.read.jdbc(url, "commands", properties=DERBY)
    assert {(r["BATCH_ID"] if "BATCH_ID" in r else r["batch_id"], r["name"]) for r in back.collect()} == {(0, f"cmd {i}") for i in range(7)} | {(1, f"cmd {i}") for i in range(100, 104)}
    assert back.count() == 11


def test_jdbc_stream(spark, tmp_path):
    url, src = f"jdbc:derby:{tmp_path}/db;create=true", str(tmp_path / "in")
    _activity(spark, 6).coalesce(1).write.json(src)
    stream = lambda: spark.readStream.schema("epoch long, day string, name string").json(src)
    run = lambda cp: sinks.stream_jdbc(stream(), url, "commands", DERBY, str(tmp_path / cp)).awaitTermination()
    run("cp")
    _activity(spark, 3, 50).coalesce(1).write.mode("append").json(src)
    run("cp")
    names = lambda: sorted(r["name"] for r in spark.read.jdbc(url, "commands", properties=DERBY).collect())
    want = sorted([f"cmd {i}" for i in [*range(6), 50, 51, 52]])
    assert names() == want


def test_embedded_batches_keep_odd_texts_and_are_repeated_without_doubles(spark, tmp_path):
    """Tasks never open the database, which lies in the driver's process."""
    rows = [("a", 1.5), (' "b", c', 2.0), ("two\nlines", 3.0), ("", 4.0), (None, 5.0), ("é ", None)]
    df = spark.createDataFrame(rows, "name string, minutes double").repartition(3)
    url = f"jdbc:derby:{tmp_path}/own;create=true"
    for batch in (0, 1, 1):
        sinks.batch_embedded(df, batch, url, "commands", DERBY)
    back = sinks.back_embedded(spark, url, "commands", DERBY, "name string, minutes double, batch_id bigint", [0, 1])
    assert sorted(map(repr, (tuple(r) for r in back.collect()))) == sorted(repr((*r, b)) for r in rows for b in (0, 1))


@pytest.fixture
def small_files(spark):
    """Text is read in many small pieces."""
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{k}", "200")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_lines_keep_their_places_and_are_not_sorted(spark, tmp_path, small_files):
    texts = {f"{i}.txt": [f"line {k} of {i}" + "x" * (k * i % 70) if k % 9 else "" for k in range(n)] for i, n in enumerate((90, 1, 0, 40))}
    for name, values in texts.items():
        (tmp_path / name).write_text("".join(f"{v}\n" for v in values))
    got = readers.ordered_lines(spark, str(tmp_path))
    assert "row_number" not in got.filter("value <> ''")._jdf.queryExecution().executedPlan().toString()
    for name, values in texts.items():
        rows = got.filter(F.col("source").endswith(f"/{name}")).orderBy("pos").collect()
        assert [(r["pos"], r["value"]) for r in rows] == list(enumerate(values))


POLL = [
    "0x1 0 me before", "2024-01-01 10:00:00 - Nouvelles :", "0x2 0 me a  b", "0x2 0 me a  b", "0x3 0 other c", "-----", None, "", " 0x4 0 me d", "0x5 0 me", "2024-01-01 10:00:02 - Fenêtres fermées :", "-----",
    "2024-01-01 10:00:04 - x ferm", "0x6 1 me2 e", "0x0", "2024-13-01 10:00:04- y", "0x7\t1\tme f",
]


def test_poll_log_moves_and_sorts_only_headers_and_rows_and_once(spark, monkeypatch):
    from tallyloom.operators import ordered

    rows = [(s, i, v) for s in ("a", None) for i, v in enumerate(POLL)]
    frame = spark.createDataFrame([*rows, *rows[:3]], "source string, pos int, value string").repartition(5)  # some lines come twice
    of = lambda first: sorted((r["source"] or "", r["block"], r["pos"], r["ts"].strftime("%S"), r["kind"], r["window_id"], r["host"], r["title"]) for r in readers.event_log(frame, "me", first).collect())
    whole, first = of(False), of(True)
    one = lambda s, k: [(s, k, 2, "00", "opened", "0x2", "me", "a  b"), (s, k, 3, "00", "opened", "0x2", "me", "a  b"), (s, k + 2, 13, "04", "closed", "0x6", "me2", "e"), (s, k + 2, 16, "04", "closed", "0x7", "me", "f")]
    assert [x for x in whole if x[0] == ""] == one("", 1)
    assert {x[3:] for x in whole if x[0] == "a"} == {x[3:] for x in one("", 1)}, "lines that come twice are in two blocks"
    monkeypatch.setattr(ordered, "LINES_PER_BLOCK", 3)
    assert [x[2:] for x in of(False) if x[0] == ""] == [x[2:] for x in whole if x[0] == ""] and [x for x in of(True) if x[0] == ""] == [x for x in first if x[0] == ""]
    plan = readers.event_log(frame, "me").select("ts", "kind", "window_id", "title")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", pos#") and sum(", pos#" in x for x in plan.splitlines() if "Sort [" in x) == 1, "one sort of rows"
    assert not any("SortMergeJoin" in x for x in plan.splitlines())
