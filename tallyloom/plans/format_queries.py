"""Each format written from a table and read back; the SQL says what the table itself holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.operators import tasks
from tallyloom.plans.registry import query, table
from tallyloom.sources import readers, rejects, sinks
from tallyloom.streaming import snapshots

_TIME = "HH:mm:ss"


def _back(spark, df, name, write, read):
    """Written to a new folder by write(df, path), then read by read(path)."""
    path = sinks.scratch(spark, name)
    write(df, path)
    return read(path)


def _text(spark, value: Column, df, name):
    """One column as text, read back as numbered lines. A value may hold several lines."""
    return _back(spark, df.select(value.alias("v")), name, sinks.lines, lambda path: readers.ordered_lines(spark, path))


def _activity(spark, d):
    e = table(spark, d, "events")
    end = F.date_format(F.col("ts") + F.expr("interval 2 seconds"), _TIME).alias("close")
    name = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(", user "), F.col("user_id").cast("string"))
    return e.select(F.to_date("ts").alias("date"), F.date_format("ts", _TIME).alias("open"), end, F.round("value", 3).alias("minutes"), F.col("event_type").alias("type"), name.alias("name"))


_ACTIVITY = """select cast(ts as date) date, strftime(ts, '%H:%M:%S') open, strftime(ts + interval 2 second, '%H:%M:%S') "close", round("value", 3) "minutes", event_type as type,
'event ' || event_id || ', user ' || user_id as name from events"""


@query(_ACTIVITY)
def format_tabs(spark, d):
    return _back(spark, _activity(spark, d), "tabs", sinks.tabs, lambda p: readers.activity_tabs(readers.ordered_lines(spark, p))).drop("source", "pos")


@query(_ACTIVITY)
def format_commas(spark, d):
    return _back(spark, _activity(spark, d), "commas", sinks.lines, lambda p: readers.activity_commas(readers.ordered_lines(spark, p))).drop("source", "pos")


@query("select doc_id, quality, toxic from labels")
def format_jsonl_append(spark, d):
    """One half written, the other appended."""
    l, path = table(spark, d, "labels"), sinks.scratch(spark, "jsonl")  # noqa: E741
    sinks.jsonl(l.filter("doc_id % 2 = 0"), path)
    sinks.jsonl(l.filter("doc_id % 2 = 1"), path, mode="append")
    return readers.jsonl(spark, path, "doc_id bigint, quality int, toxic int")


@query("select doc_id, quality, toxic from labels")
def format_semicolons(spark, d):
    read = lambda p: spark.read.csv(p, sep=";", header=True, schema="doc_id bigint, quality int, toxic int")
    return _back(spark, table(spark, d, "labels"), "semicolons", sinks.semicolons, read)


@query("select cast(ts as date) date, count(*) n, sum(user_id)::bigint users from events group by 1")
def format_day_log(spark, d):
    """The event log, appended in two runs, a folder a day."""
    e, path = table(spark, d, "events"), sinks.scratch(spark, "log")
    for part in (0, 1):
        sinks.by_date(e.filter(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("select n_nationkey, n_name from nation union all select n_nationkey + 100, n_name from nation")
def format_versions(spark, d):
    """A dictionary rewritten beside its former version; both are there."""
    n, path = table(spark, d, "nation").select("n_nationkey", "n_name"), sinks.scratch(spark, "versions")
    a = sinks.version(n, path, "1")
    b = sinks.version(n.withColumn("n_nationkey", F.col("n_nationkey") + 100), path, "2")
    return spark.read.parquet(a).unionByName(spark.read.parquet(b))


@query("select cast(ts as date) date, strftime(ts, '%H:%M:%S') as time, 'title ' || event_id || ' - ' || event_type title from events where user_id % 3 <> 0")
def format_event_lines(spark, d):
    """date time title; a third of the lines is too short and left out."""
    title = F.concat(F.lit(" title "), F.col("event_id").cast("string"), F.lit(" - "), F.col("event_type"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("user_id") % 3 == 0, "").otherwise(title))
    return readers.events(_text(spark, line, table(spark, d, "events"), "events")).select("date", "time", "title")


@query("select cast(ts as date) date, strftime(ts, '%H:%M:%S') open, strftime(ts, '%H:%M:%S') \"close\", 'a b ' || event_id title from events")
def format_intervals(spark, d):
    """date open close title, parted by any white space."""
    t = F.date_format("ts", _TIME)
    line = F.concat_ws("  ", F.date_format("ts", "yyyy-MM-dd"), t, t, F.lit("a \tb"), F.col("event_id").cast("string"))
    return readers.intervals(_text(spark, line, table(spark, d, "events"), "intervals")).select("date", "open", "close", "title")


@query("select epoch_s + 0 epoch, cmd command from (select cast(floor(epoch(ts)) as bigint) epoch_s, 'run ' || event_id cmd from events union all select cast(floor(epoch(ts)) as bigint), 'again ' || event_id from events where event_id % 5 = 0)")
def format_history(spark, d):
    """`#epoch`, a command, for some a second one; a remark ends its reach."""
    i = F.col("event_id").cast("string")
    more = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\nagain "), i, F.lit("\n\n# a remark\nlost "), i)).otherwise("")
    line = F.concat(F.lit("#"), F.unix_timestamp("ts").cast("string"), F.lit("\nrun "), i, more)
    return readers.history(_text(spark, line, table(spark, d, "events"), "history")).select("epoch", "command")


@query("select date_trunc('second', ts) ts, case when event_id % 2 = 0 then 'opened' else 'closed' end kind, '0x' || event_id window_id, 'file ' || user_id || ' - dir - app' title from events")
def format_poll_log(spark, d):
    """Blocks of the poll log: a header, a row, and a row of another host, which is left out."""
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, F.lit(" - Nouvelles :")).otherwise(F.lit(" - Fenêtres fermées :")))
    line = F.concat(head, F.lit("\n0x"), i, F.lit("  0 host-a file "), u, F.lit(" - dir - app\n0x9  0 other-b x\n-----"))
    return readers.event_log(_text(spark, line, table(spark, d, "events"), "poll"), "host-").select("ts", "kind", "window_id", "title")


@query("""select n_name cmd_name, 0 entry_ord, 0 pattern_ord, n_name || ' -a' pattern, 'entry of ' || n_name description from nation
union all select n_name, 1, i::int, n_name || case i when 0 then ' -b' else ' --both' end, 'second' from nation, range(0, 2) r(i)""")
def format_dictionary(spark, d):
    """JSON dictionaries, a file for each region, with entries of one and of several commands."""
    n = table(spark, d, "nation")
    one = F.struct(F.concat(F.lit("entry of "), "n_name").alias("description"), F.concat("n_name", F.lit(" -a")).alias("cmd"), F.lit(None).cast("array<string>").alias("cmds"))
    two = F.struct(F.lit("second").alias("description"), F.lit(None).cast("string").alias("cmd"), F.array(F.concat("n_name", F.lit(" -b")), F.concat("n_name", F.lit(" --both"))).alias("cmds"))
    files = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.array(one, two))))).alias("value"))
    write = lambda df, p: df.write.partitionBy("n_regionkey").text(p)
    return _back(spark, files, "dictionary", write, lambda p: readers.dictionary(spark, p)).drop("file")


@query("select 's' || s_suppkey ext, 'text/x-' || s_suppkey as type, 'kind ' || s_suppkey comment from supplier")
def format_mime_xml(spark, d):
    i = F.col("s_suppkey").cast("string")
    xml = F.concat(
        F.lit('<mime-type type="text/x-'), i, F.lit('"><comment>kind '), i, F.lit('</comment><comment xml:lang="fr">genre</comment><glob pattern="*.s'), i, F.lit('"/><glob pattern="Make'), i, F.lit('"/></mime-type>')
    )
    files = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 5).alias("f")).agg(F.array_join(F.collect_list(xml), "\n").alias("v"))
    files = files.select("f", F.concat(F.lit("<mime-info>\n"), "v", F.lit("\n</mime-info>")).alias("value"))
    return _back(spark, files, "mime", lambda df, p: df.write.partitionBy("f").text(p), lambda p: readers.mime_types(spark, p))


@query("select 'Make ' || n_name description, 'make ' || n_name || ' {{path}}' command from nation")
def format_pages(spark, d):
    line = F.concat(F.lit("# page\n\n- Make "), F.col("n_name"), F.lit(":\n\n`make "), F.col("n_name"), F.lit(" {{path}}`\n"))
    return readers.tldr_pages(_text(spark, line, table(spark, d, "nation"), "pages")).select("description", "command")


def _help() -> Column:
    return F.concat(F.lit("Usage: x"), F.lit("\n  -a, --all"), F.col("n_nationkey").cast("string"), F.lit("  show\n      the rest\nCommands:\n  run"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij"), F.lit("   do it\n"))


@query("select '-a, --all' || n_nationkey || '  show the rest' block from nation")
def format_help_options(spark, d):
    return readers.help_blocks(_text(spark, _help(), table(spark, d, "nation"), "help")).select("block")


@query("select 'run' || translate(n_nationkey::varchar, '0123456789', 'abcdefghij') subcommand, 'do it' description from nation")
def format_help_subcommands(spark, d):
    return readers.help_subcommands(_text(spark, _help(), table(spark, d, "nation"), "help")).select("subcommand", "description")


@query("""with s as (select user_id, dayofyear(ts) d, event_type t, count(*) n from events group by all), days as (select user_id, d, lag(d) over (partition by user_id order by d) p from (select distinct user_id, d from s)),
x as (select y.user_id, y.d, t.t, coalesce(a.n, 0) a, coalesce(b.n, 0) b from days y, (select distinct event_type t from events) t left join s a on a.user_id = y.user_id and a.d = y.d and a.t = t.t left join s b on b.user_id = y.user_id and b.d = y.p and b.t = t.t where y.p is not null)
select user_id::varchar host, d::bigint as day, case when a > b then 'opened' else 'closed' end kind, t as window_title, abs(a - b) n from x where a <> b""")
def stream_changes(spark, d):
    """Snapshots, one a day and user, written as files and read as a stream: what each opened and closed against the one before."""
    e = table(spark, d, "events").withColumn("day", F.dayofyear("ts"))
    shots = e.groupBy("user_id", "day").agg(F.sort_array(F.collect_list("event_type")).alias("windows"))
    shots = shots.select(F.timestamp_seconds(F.col("day") * 86400).alias("ts"), F.col("user_id").cast("string").alias("host"), "windows")
    source, out, state = (sinks.scratch(spark, f"stream-{x}") for x in ("in", "out", "state"))
    sinks.jsonl(shots, source)
    rows = snapshots.window_changes(spark.readStream.schema(snapshots.ROW).json(source))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(snapshots.OUT).parquet(out)
    day = F.floor(F.unix_timestamp("ts") / 86400)
    return got.groupBy("host", day.alias("day"), "kind", F.col("window").alias("window_title")).agg(F.count("*").alias("n"))


@query(_ACTIVITY)
def format_jdbc(spark, d):
    """Commands in a database: three batches or more, one of them run twice, leave every row once. The database is Derby within the driver's process."""
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    path = sinks.scratch(spark, "derby").removeprefix("file:").lstrip("/")
    url, rows = f"jdbc:derby:/{path};create=true", _activity(spark, d)
    batches = list(range(max(3, -(-rows.count() // 1_000_000))))  # so a file of a batch has a bounded size
    for batch in (0, 1, *batches[1:]):
        sinks.batch_embedded(rows.filter(F.pmod(F.xxhash64("name"), F.lit(len(batches))) == batch), batch, url, "commands", props)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return sinks.back_embedded(spark, url, "commands", props, f"{kinds}, batch_id bigint", batches).select(*rows.columns)


_SPOILT = """case event_id % 7 when 0 then cast(ts as date) || ', ' || strftime(ts, '%H:%M:%S') when 1 then 'someday, 1, 2, 0.5, x, y' when 2 then cast(ts as date) || ', 1, 2, much, x, event ' || event_id else cast(ts as date) || ', 1, 2, 0.5, x, event ' || event_id end"""


@query(f"""select value, case event_id % 7 when 0 then 'fewer than 6 parts' when 1 then 'no date' else 'no number' end reason, count(*) n from (select event_id, {_SPOILT} as "value" from events where event_id % 7 < 3) group by all""")
def format_bad_lines(spark, d):
    """Lines that the reader of comma lines can't read, with the reason."""
    e, k = table(spark, d, "events"), F.col("event_id") % 7
    day, n = F.to_date("ts").cast("string"), F.col("event_id").cast("string")
    value = (
        F.when(k == 0, F.concat_ws(", ", day, F.date_format("ts", _TIME))).when(k == 1, F.lit("someday, 1, 2, 0.5, x, y")).when(k == 2, F.concat(day, F.lit(", 1, 2, much, x, event "), n))
        .otherwise(F.concat(day, F.lit(", 1, 2, 0.5, x, event "), n))
    )
    return rejects.rejected(_text(spark, value, e, "spoilt"), "activity_commas").groupBy("value", "reason").agg(F.count("*").alias("n"))


@query("""with g as (select conv_id, turn, text, string_agg(text, ' ') over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) b from conversations) select conv_id, md5(text) a, md5(b) b from g""")
def format_pairs(spark, d):
    """The pairs of tasks and blocks, saved and loaded again."""
    made = tasks.contrastive_pairs(table(spark, d, "conversations"), "conv_id", "turn", "text").filter("kind = 'task_block'").select("conv_id", "a", "b")
    return _back(spark, made, "pairs", sinks.pairs, lambda p: readers.pairs(spark, p)).select("conv_id", F.md5("a").alias("a"), F.md5("b").alias("b"))
