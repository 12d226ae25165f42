import json
import os
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.streaming import snapshots
from tallyloom.streaming.polls import PollSource


def put(folder, number, rows):
    beside = f"{folder}-new"
    with open(beside, "w") as f:
        f.write("\n".join(json.dumps({"ts": ts, "host": h, "windows": w}) for ts, h, w in rows))
    os.rename(beside, f"{folder}/{number:012d}.jsonl")


def run(spark, folder, out, checkpoint, most=1000, silent=None):
    polls = spark.readStream.format("polls").option("most", str(most)).load(folder)
    q = snapshots.window_changes(polls, silent).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def shown(spark, out):
    return Counter((r["host"], r["kind"], r["window"], r["ts"].strftime("%H:%M:%S")) for r in spark.read.parquet(out).collect())


def test_polls_restart_without_loss_or_doubles(spark, tmp_path):
    spark.dataSource.register(PollSource)
    folder, out, cp = (str(tmp_path / x) for x in ("polls", "out", "cp"))
    os.mkdir(folder)
    at = lambda k: f"2024-01-01T10:00:{k:02d}"
    put(folder, 0, [(at(0), "a", ["x", "y"]), (at(0), "b", ["p"])])
    put(folder, 1, [(at(2), "a", ["x", "z", "z"])])
    (tmp_path / "polls" / "notes.txt").write_text("no poll")
    run(spark, folder, out, cp, most=1)
    want = Counter({("a", "opened", "z", "10:00:02"): 2, ("a", "closed", "y", "10:00:02"): 1})
    assert shown(spark, out) == want
    run(spark, folder, out, cp)  # nothing new
    assert shown(spark, out) == want
    put(folder, 2, [(at(4), "a", ["z"]), (at(4), "b", ["p", "q"])])
    put(folder, 3, [(at(6), "b", [])])
    run(spark, folder, out, cp, most=1)
    want += Counter({("a", "closed", "x", "10:00:04"): 1, ("a", "closed", "z", "10:00:04"): 1, ("b", "opened", "q", "10:00:04"): 1, ("b", "closed", "p", "10:00:06"): 1, ("b", "closed", "q", "10:00:06"): 1})
    assert shown(spark, out) == want


def test_silent_hosts_are_closed(spark, tmp_path):
    spark.dataSource.register(PollSource)
    folder, out, cp = (str(tmp_path / x) for x in ("polls", "out", "cp"))
    os.mkdir(folder)
    put(folder, 0, [("2024-01-01T10:00:00", "a", ["x"]), ("2024-01-01T10:00:00", "b", ["p"])])
    put(folder, 1, [("2024-01-01T10:00:30", "a", ["x"])])
    put(folder, 2, [("2024-01-01T10:02:00", "a", ["x", "y"])])
    put(folder, 3, [("2024-01-01T10:02:10", "a", ["x", "y"]), ("2024-01-01T10:02:10", "b", ["q"])])
    run(spark, folder, out, cp, most=1, silent=60_000)
    got = shown(spark, out)
    assert got["b", "closed", "p", "10:01:00"] == 1
    assert not any(k[:2] == ("b", "opened") for k in got), "a host that comes back has a new base line"


def test_days_have_folders_of_their_own(spark, tmp_path):
    from tallyloom.sources import sinks

    rows = [("2024-01-01 23:59:58", "a"), ("2024-01-02 00:00:00", "b")]
    df = spark.createDataFrame(rows, "t string, w string").select(F.col("t").cast("timestamp").alias("ts"), "w")
    sinks.by_date(df, str(tmp_path / "log"))
    sinks.by_date(df.filter("w = 'b'"), str(tmp_path / "log"))
    assert {r["date"].isoformat(): r["count"] for r in spark.read.parquet(str(tmp_path / "log")).groupBy("date").count().collect()} == {"2024-01-01": 1, "2024-01-02": 2}


def test_changes_of_odd_snapshots_and_repeated_ones(spark, tmp_path):
    """Null times come last and stay null, null hosts are a host, null windows are none; equal or reordered snapshots change nothing."""
    spark.dataSource.register(PollSource)
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    os.mkdir(source)
    rows = [
        [{"ts": "2024-01-01T10:00:02.000001Z", "host": "a", "windows": ["y", "x", "x"]}, {"ts": None, "host": "a", "windows": ["q"]}, {"ts": "2024-01-01T10:00:00Z", "host": "a", "windows": ["x", "y", "x"]}, {"ts": "2024-01-01T10:00:04Z", "host": "a", "windows": ["x", "z", "z"]}],
        [{"ts": "2024-01-01T10:00:00Z", "host": None, "windows": ["x"]}, {"ts": "2024-01-01T10:00:01Z", "host": None, "windows": None}, {"ts": "2024-01-01T10:00:02Z", "host": None, "windows": ["x", "x"]}, {"ts": "2024-01-01T10:00:02Z", "host": None, "windows": []}],
        [{"ts": "1999-12-31T23:59:59.999999Z", "host": "b", "windows": []}, {"ts": "2000-01-01T00:00:00.000001Z", "host": "b", "windows": ["é", ""]}],
    ]
    for i, some in enumerate(rows):
        with open(f"{source}/{i}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in some))
    frame = snapshots.window_changes(spark.readStream.schema(snapshots.ROW).json(source))
    assert [f"{n} {t}" for n, t in frame.dtypes] == snapshots.OUT.split(", ")
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = Counter((r["t"], r["host"], r["kind"], r["window"]) for r in spark.read.schema(snapshots.OUT).parquet(out).selectExpr("cast(ts as string) t", "*").collect())
    at = "2024-01-01 10:00:0"
    assert got == Counter({
        (at + "4", "a", "opened", "z"): 2, (at + "4", "a", "closed", "x"): 1, (at + "4", "a", "closed", "y"): 1, (None, "a", "opened", "q"): 1, (None, "a", "closed", "x"): 1, (None, "a", "closed", "z"): 2,
        (at + "1", None, "closed", "x"): 1, (at + "2", None, "opened", "x"): 2, (at + "2", None, "closed", "x"): 2,
        ("2000-01-01 00:00:00.000001", "b", "opened", "é"): 1, ("2000-01-01 00:00:00.000001", "b", "opened", ""): 1,
    })


class Held:
    exists, got = False, None

    def update(self, value):
        self.got = value


def test_a_host_costs_python_one_frame_and_no_times():
    import pandas as pd

    made = lambda n: [pd.DataFrame({"at": range(k, k + 5), "host": "a", "windows": [["x", str(i % n)] for i in range(5)]}) for k in (5, 0)]
    state = Held()
    out = list(snapshots.changes(("a",), iter(made(2)), state))
    assert len(out) == 1 and str(out[0].dtypes["at"]) == "int64" and state.got == (["x", "0"],)
    assert list(out[0]["at"]) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert (out[0]["opened"][0], out[0]["closed"][0]) == (["1"], ["0"])
    assert list(snapshots.changes(("a",), iter(made(1)), Held())) == [], "nothing has changed, so no frame is made"
