"""Numbers, splits and scans over whole rows, with whatever partitions and ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import events, ordered, tables
from tallyloom.sources import readers


@pytest.fixture(params=["true", "false"], ids=["aqe", "no aqe"])
def aqe(spark, request):
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("shuffles", [2, 4, 23])
@pytest.mark.parametrize(("name", "order"), [("lineitem", ["l_shipdate", "l_suppkey"]), ("documents", ["source"])])
def test_renumber_keeps_whole_rows(spark, aqe, name, order, shuffles):
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
    try:
        df = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
        got = tables.renumber(df.repartition(shuffles + 3), [F.col(c) for c in order], rows_per_range=df.count() // 20)
        got.write.mode("overwrite").saveAsTable("numbered")
        got = spark.table("numbered")
        assert got.drop("n").exceptAll(df).isEmpty() and df.exceptAll(got.drop("n")).isEmpty()
        seen = got.select("n", *order).orderBy("n").collect()
        assert [r["n"] for r in seen] == list(range(df.count()))
        keys = [tuple(r)[1:] for r in seen]
        assert keys == sorted(keys)
    finally:
        spark.sql("drop table if exists numbered")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_renumber_awkward_rows(spark):
    df = spark.createDataFrame([(None, "a", {"x": 1}), (None, "a", {"x": 1}), (2, None, None), (2, None, {"y": 2, "z": 3}), (1, "b", None)] * 30, "k int, `odd name` string, m map<string,int>")
    rows = tables.renumber(df, [F.col("k")], 5, "k2", rows_per_range=11).collect()
    assert sorted(r["k2"] for r in rows) == list(range(5, 155))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["k2"])] == [None] * 60 + [1] * 30 + [2] * 60
    again = tables.renumber(df.repartition(9), [F.col("k")], 5, "k2", rows_per_range=11).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert tables.renumber(df.limit(0), [F.col("k")]).collect() == []
    assert tables.renumber(df, [F.col("k")], 0, "k", rows_per_range=11).columns == ["odd name", "m", "k"]


def test_split_shuffle_and_zip_keep_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    n = docs.count()
    split = tables.positional_split(tables.renumber(docs, [F.col("doc_id")], rows_per_range=90), "n", n, {"a": 0.85, "b": 0.1, "c": 0.05})
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"a": int(n * 0.85), "b": int(n * 0.95) - int(n * 0.85), "c": n - int(n * 0.95)}
    assert docs.exceptAll(tables.seeded_shuffle(docs, "doc_id", 3).drop("place")).isEmpty()
    both = tables.zip_by_place({"text": (docs, "doc_id", "text"), "price": (orders, "o_orderkey", "o_totalprice")})
    c = both.agg(F.count("text"), F.count("price"), F.countDistinct("n")).first()
    assert tuple(c) == (docs.filter("text is not null").count(), orders.count(), max(n, orders.count()))


def _lines(spark, values, source="f"):
    return spark.createDataFrame([(source, i, v) for i, v in enumerate(values)], "source string, pos int, value string")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordered, "LINES_PER_BLOCK", 7)


def test_scans_over_blocks(spark, small_blocks):
    rng = random.Random(2)
    rows = [(s, i, rng.choice([None, None, None, "x", "y"])) for s in ("a", None) for i in range(120)]
    rows = [(s, i, None if 20 < i < 70 else v) for s, i, v in rows]
    df = spark.createDataFrame(rows, "source string, pos int, v string").repartition(5)
    out = ordered.counted(df, ["source"], "pos", F.col("v") == "x", "n")
    out = ordered.carried(out, ["source"], "pos", F.col("v"), "last")
    out = ordered.followed(out, ["source"], "pos", "v", "next")
    got = {(r["source"], r["pos"]): (r["n"], r["last"], r["next"]) for r in out.collect()}
    for s in ("a", None):
        n, last, vs = 0, None, [v for t, _, v in rows if t == s]
        for i, v in enumerate(vs):
            n, last = n + (v == "x"), v or last
            assert got[s, i] == (n, last, vs[i + 1] if i + 1 < len(vs) else None)


def test_readers_along_one_large_file(spark, small_blocks, monkeypatch):
    rng = random.Random(4)
    history = [rng.choice(["#17000000%02d" % i, "# note", "", "ls -l", "cd /tmp"]) if rng.random() < 0.5 else "cmd %d" % i for i in range(200)]
    poll, tldr, helps = [], [], []
    for i in range(30):
        poll += ["2024-01-01 10:00:%02d - " % i + ("Fenêtres fermées :" if i % 3 else "Nouvelles fenêtres ajoutées :"), *["0x%d 0 me title %d" % (k, i) for k in range(rng.randint(0, 25))], "----"]
        tldr += ["# t", "", "- Do %d:" % i, *[""] * rng.randint(0, 20), "`cmd %d`" % i]
        helps += ["  -o%d, --opt  first" % i, *["        more %d" % k for k in range(rng.randint(0, 12))], "text"]
    of = lambda: [
        sorted(map(repr, f.collect()))
        for f in (readers.history(_lines(spark, history)), readers.event_log(_lines(spark, poll), "me"), readers.event_log(_lines(spark, poll), "me", True), readers.tldr_pages(_lines(spark, tldr)), readers.help_blocks(_lines(spark, helps)))
    ]
    cut = of()
    monkeypatch.setattr(ordered, "LINES_PER_BLOCK", 1 << 16)
    assert cut == of() and all(cut)


def test_pairing_of_a_hot_title_in_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "a", "b", None]), i // 2, rng.random() < 0.5) for i in range(3000)]
    o = spark.createDataFrame([(k, p, i) for i, (k, p, x) in enumerate(rows) if x], "title string, pos int, id int")
    c = spark.createDataFrame([(k, p, i) for i, (k, p, x) in enumerate(rows) if not x], "title string, pos int, id int")
    whole = events.pair_intervals(o, c, ["title"])
    cut = events.pair_intervals(o.repartition(5), c, ["title"], rows_per_range=100)
    assert sorted(map(repr, whole.select("title", "open_pos", "close_pos").collect())) == sorted(map(repr, cut.select("title", "open_pos", "close_pos").collect()))
    want = 0
    for t in {k for k, _, _ in rows}:
        opens, closes = sorted(p for k, p, x in rows if k == t and x), sorted(p for k, p, x in rows if k == t and not x)
        for p in opens:
            near = next((q for q in closes if q >= p), None)
            if near is not None:
                closes.remove(near)
                want += 1
    assert cut.count() == want


def test_long_rows_make_more_ranges(spark, monkeypatch):
    """A range is bounded by its bytes as well as by its rows."""
    df = spark.range(400).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit("y" * 50)).alias("more"))
    monkeypatch.setattr(ordered, "BYTES_PER_RANGE", 40_000)
    used = []
    real = ordered.with_ranges
    monkeypatch.setattr(ordered, "with_ranges", lambda *a, **k: used.append(real(*a, **k)) or used[-1])
    got = tables.renumber(df.repartition(3), [F.col("id")]).collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(i, i) for i in range(400)]
    assert used[0].groupBy("\x00range").agg(F.sum(F.length("text")).alias("b")).agg(F.count("*"), F.max("b") < 80_000).first()[0:2] >= (8, True)


def test_ranges_are_searched_without_a_join_and_have_a_task_each(spark, aqe):
    rng = random.Random(3)
    rows = [(None if i % 7 == 0 else 5 if i % 5 == 0 else rng.randint(0, 9), rng.choice(["a", "b", None]), i // 2) for i in range(1000)]  # pairs of rows share i, many share k
    df = spark.createDataFrame(rows, "k int, s string, i int").repartition(6)
    got = tables.renumber(df, [F.col("k"), F.col("i")], 1, "n", rows_per_range=40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "aggregate(" not in plan
    first = lambda v: (v is not None, v)
    out = got.select("*", F.spark_partition_id().alias("task")).orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1, 1001))
    assert [(r["k"], r["i"]) for r in out] == [(k, i) for k, _, i in sorted(rows, key=lambda r: (first(r[0]), first(r[2])))]
    assert sorted(map(repr, rows)) == sorted(repr((r["k"], r["s"], r["i"])) for r in out)
    assert len({r["task"] for r in out}) > 15 and max(sum(r["task"] == t for r in out) for t in {r["task"] for r in out}) < 120
    ranged = ordered.with_ranges(df, F.col("i"), "part", rows_per_range=40).select("i", "part").distinct().orderBy("i").collect()
    assert len(ranged) == 500, "rows of one key are in one range"
    assert [r["part"] for r in ranged] == sorted(r["part"] for r in ranged) and {r["part"] for r in ranged} == set(range(25))
