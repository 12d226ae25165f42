"""What the readers can't read: counts beside their rows, and the rejected records themselves.

`observed` counts read and bad lines while the rows are made, without a pass of its own; `rejected` gives the bad lines with a
reason. JSON and dictionary files have readers here that return their rows and their bad records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources import readers


def _short(sep: str, least: int) -> Column:
    parts = F.split(F.trim("value") if sep in (" ", r"\s+") else F.col("value"), sep)
    return F.when(F.size(parts) < least, F.lit(f"fewer than {least} parts"))


def _date(c: Column) -> Column:
    return F.when(c.try_cast("date").isNull(), "no date")


def _number(c: Column) -> Column:
    return F.when(F.trim(c).try_cast("double").isNull(), "no number")


def reason(kind: str) -> Column:
    """Why a line is bad for a reader; null for a good one. Blank lines are no records where the format has them."""
    v = F.col("value")
    if kind == "events":
        return F.coalesce(_short(" ", 3), _date(F.split(F.trim(v), " ")[0]))
    if kind == "intervals":
        return F.coalesce(_short(r"\s+", 4), _date(F.split(F.trim(v), r"\s+")[0]))
    if kind == "activity_commas":
        return F.coalesce(_short(",", 6), _date(F.trim(F.split(v, ",")[0])), _number(F.get(F.split(v, ","), F.lit(3))))
    if kind == "activity_tabs":
        return F.when(F.trim(v) != "", F.coalesce(_short("\t", 6), _date(F.split(v, "\t")[0]), _number(F.get(F.split(v, "\t"), F.lit(3)))))
    if kind == "history":
        return F.when(v.startswith("#") & F.expr("try_cast(substr(value, 2) as bigint)").isNull(), "no time after #")
    raise ValueError(f"no reader {kind}")


def rejected(lines: DataFrame, kind: str) -> DataFrame:
    """source, pos, value and reason of the lines that the reader leaves out or reads with an empty field."""
    return lines.withColumn("reason", reason(kind)).filter("reason is not null").select("source", "pos", "value", "reason")


def observed(lines: DataFrame, kind: str) -> tuple[DataFrame, Observation]:
    """lines as they are, and an observation of `lines` and `bad` once what is made of them has run."""
    seen = Observation(f"{kind} lines")
    return lines.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(reason(kind)).alias("bad")), seen


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON lines, and the lines that are no such records: source and value."""
    kept = "_corrupt_record"
    rows = spark.read.option("columnNameOfCorruptRecord", kept).schema(f"{schema}, {kept} string").json(path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value").filter(F.trim("value") != "")
    # parsed once more from the text, as Spark does not return corrupt records alone
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, {kept} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": kept}))
    bad = parsed.filter(F.col("r").isNull() | F.col(f"r.{kept}").isNotNull()).select("source", "value")
    return rows.filter(F.col(kept).isNull()).drop(kept), bad


def dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all dictionaries, and the files that are none: file and bytes."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"), F.from_json("value", readers.DICTIONARY, {"mode": "PERMISSIVE"}).alias("d"))
    bad = files.filter(F.col("d").isNull() | (F.size("d") < 1)).select("file", F.octet_length("value").alias("bytes"))
    return readers.dictionary(spark, path), bad
