"""Readers of the activity formats. Each takes a frame of lines (source, pos, value) or a path, and returns typed rows.

The order of lines has a meaning in most formats, so lines are numbered as they are read. A large file is read by blocks
like any text, and the lines of each block are shifted by those of the blocks before it. What is carried along a file (its
headers, epochs, counts and next lines) is found in blocks of lines, with one row a block for what passes from one to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordered import block_of, carried, counted, followed
from tallyloom.sources.sinks import written

DICTIONARY = "map<string,array<struct<description:string,cmd:string,cmds:array<string>>>>"


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """source (file), pos (from 0) and value of every line."""
    at = [F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block")]
    # one task reads a file block from its first line to its last, so their ids have no gaps; written, as another scan could deal blocks to other tasks
    rows = written(spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("n"), "value"), "lines")
    blocks = rows.groupBy("source", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a file block, as the driver's own list of them has
    shifts = F.broadcast(blocks.select("source", "block", (before - F.col("first")).alias("shift")))
    return rows.join(shifts, ["source", "block"]).select("source", (F.col("n") + F.col("shift")).cast("int").alias("pos"), "value")


def number(lines: DataFrame, order: list[Column], by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    return lines.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def events(lines: DataFrame) -> DataFrame:
    """`date time title`: source, pos, date, time, title. Lines of fewer parts are left out."""
    p = F.split(F.trim("value"), " ", 3)
    return lines.filter(F.size(p) == 3).select("source", "pos", p[0].try_cast("date").alias("date"), p[1].alias("time"), p[2].alias("title"))


def intervals(lines: DataFrame) -> DataFrame:
    """`date open close title...` parted by white space."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.size(p) >= 4).select("source", "pos", p[0].try_cast("date").alias("date"), p[1].alias("open"), p[2].alias("close"), F.array_join(F.slice(p, 4, F.size(p)), " ").alias("title"))


def event_log(lines: DataFrame, host_prefix: str, first_only: bool = False) -> DataFrame:
    """Rows of the poll log: source, block, ts, kind (opened or closed), window_id, desktop, host, title.

    A header `ts - text :` begins a block, a rule of dashes ends it. first_only keeps each block's first row."""
    stamp = F.regexp_extract("value", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) - ", 1)
    header = F.when(stamp != "", F.struct(stamp.alias("ts"), F.when(F.contains("value", F.lit("ferm")), "closed").otherwise("opened").alias("kind")))
    p = F.split(F.trim("value"), r"\s+", 4)
    is_row = F.col("value").startswith("0x") & (F.size(p) == 4) & p[2].startswith(host_prefix)
    # other lines neither begin a block nor are returned, so they are not moved; what is kept is written, so that no scan below parses lines again
    kept = lines.filter((stamp != "") | is_row).select("source", "pos", block_of("pos").alias("lines"), header.alias("header"), F.when(stamp == "", F.col("value")).alias("value"))
    kept = written(kept, "log")
    marked = counted(kept, ["source"], "pos", F.col("header").isNotNull(), "block", "lines")
    head = carried(marked, ["source"], "pos", F.col("header"), "header", "lines").select("*", "header.ts", "header.kind")
    per = Window.partitionBy("source", "block").orderBy("pos")
    rows = head.filter((F.col("block") > 0) & F.col("value").isNotNull())
    rows = rows.withColumn("row", F.row_number().over(per))
    return rows.filter((F.col("row") == 1) | F.lit(not first_only)).select("source", "block", "pos", F.col("ts").cast("timestamp").alias("ts"), "kind", p[0].alias("window_id"), p[1].alias("desktop"), p[2].alias("host"), p[3].alias("title"))


def history(lines: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Shell history with `#epoch` lines: source, pos, epoch, command. Any other `#` line resets the epoch."""
    is_hash = F.col("value").startswith("#")
    epoch = F.expr("try_cast(substr(value, 2) as bigint)")
    along = carried(lines, ["source"], "pos", F.when(is_hash, F.struct(epoch.alias("epoch"))), "last").withColumn("epoch", F.col("last.epoch"))
    keep = F.lit(True) if keep_blank else F.trim("value") != ""
    return along.filter(~is_hash & F.col("epoch").isNotNull() & keep).select("source", "pos", "epoch", F.trim("value").alias("command"))


def activity_commas(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """`date, open, close, minutes, type, name`. Commas in the name stay; legacy turns them into spaces."""
    p = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rest = F.slice(p, 6, F.size(p))
    name = F.array_join(rest, " ") if legacy else F.trim(F.split("value", ",", 6)[5])
    kind = F.when(F.lower(p[4]).isin("commande", "command"), "Command").otherwise(p[4])
    return lines.filter(F.size(p) >= 6).select("source", "pos", p[0].try_cast("date").alias("date"), p[1].alias("open"), p[2].alias("close"), p[3].try_cast("double").alias("minutes"), kind.alias("type"), name.alias("name"))


def activity_tabs(lines: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    return lines.filter((F.trim("value") != "") & (F.size(p) >= 6)).select("source", "pos", p[0].try_cast("date").alias("date"), p[1].alias("open"), p[2].alias("close"), p[3].try_cast("double").alias("minutes"), p[4].alias("type"), p[5].alias("name"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs that sinks.pairs() has saved; a folder without them is an error."""
    return spark.read.parquet(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all JSON dictionaries: file, cmd_name, entry_ord, pattern_ord, pattern, description. A bad file gives no rows."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", DICTIONARY).alias("d"))
    entries = files.select("file", F.explode("d").alias("cmd_name", "entries")).select("file", "cmd_name", F.posexplode("entries").alias("entry_ord", "e"))
    patterns = F.concat(F.when(F.col("e.cmd").isNotNull(), F.array("e.cmd")).otherwise(F.array().cast("array<string>")), F.coalesce("e.cmds", F.array().cast("array<string>")))
    return entries.select("file", "cmd_name", "entry_ord", F.posexplode(patterns).alias("pattern_ord", "pattern"), F.col("e.description").alias("description"))


def mime_types(spark: SparkSession, path: str) -> DataFrame:
    """ext, type and comment of shared MIME descriptions (XML)."""
    schema = "_type string, comment array<struct<_VALUE:string,`_xml:lang`:string>>, glob array<struct<_pattern:string>>"
    rows = spark.read.format("xml").option("rowTag", "mime-type").schema(schema).load(path)
    plain = F.filter("comment", lambda c: c["_xml:lang"].isNull())
    globs = rows.select(F.col("_type").alias("type"), F.get(plain, F.lit(0))["_VALUE"].alias("comment"), F.explode("glob").alias("g"))
    return globs.filter(F.col("g._pattern").startswith("*.")).select(F.substr("g._pattern", F.lit(3)).alias("ext"), "type", "comment")


def tldr_pages(lines: DataFrame) -> DataFrame:
    """source, description and command: a `- text:` line and the next line that is not blank."""
    rows = followed(lines.filter(F.trim("value") != ""), ["source"], "pos", "value", "next")
    return rows.filter(F.col("value").startswith("- ") & F.col("next").isNotNull()).select("source", "pos", F.regexp_replace(F.trim(F.substr("value", F.lit(3))), ":$", "").alias("description"), F.btrim(F.trim("next"), F.lit("`")).alias("command"))


def help_blocks(lines: DataFrame) -> DataFrame:
    """Option blocks of captured help text: a line that begins with an option and the deeper lines after it, in one."""
    head = F.regexp_like("value", F.lit(r"^\s{0,3}-{1,2}\S")) | F.regexp_like("value", F.lit(r"^\s+-{1,2}[A-Za-z?]"))
    more = F.regexp_like("value", F.lit(r"^(    |\t)")) & ~head
    marked = counted(lines, ["source"], "pos", ~more, "run").withColumn("opens", head)
    per = marked.groupBy("source", "run").agg(F.min("pos").alias("pos"), F.min_by("opens", "pos").alias("opens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.trim(x["value"])), " ").alias("block"))
    return per.filter("opens").select("source", "pos", F.trim("block").alias("block"))


def help_subcommands(lines: DataFrame) -> DataFrame:
    """Names that captured help text lists, two to eight spaces in, with a description two spaces after."""
    m = F.regexp_extract("value", r"^ {2,8}([a-z][a-z0-9-]*) {2,}(\S.*)$", 1)
    return lines.filter(m != "").select("source", "pos", m.alias("subcommand"), F.regexp_extract("value", r"^ {2,8}([a-z][a-z0-9-]*) {2,}(\S.*)$", 2).alias("description"))
