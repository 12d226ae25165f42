"""Writers of the activity formats."""

from __future__ import annotations

import atexit
import glob
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, sep: str = ", ", mode: str = "overwrite") -> None:
    """Columns joined by sep, unquoted."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode(mode).text(path)


def tabs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep="\t", quote="\u0000")


def semicolons(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep=";", header=True)


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pairs for training, saved whole; readers.pairs() loads them again."""
    df.write.mode(mode).parquet(path)


def by_date(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """The event log, one folder a day; a new day never touches the old ones."""
    df.withColumn("date", F.to_date(ts)).write.mode(mode).partitionBy("date").parquet(path)


def version(df: DataFrame, path: str, name: str) -> str:
    """A rewritten dictionary beside the former ones."""
    df.write.mode("errorifexists").parquet(f"{path}/version={name}")
    return f"{path}/version={name}"


def commands_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Command activity into a database table, without the epoch."""
    df.drop("epoch").write.jdbc(url, table, mode="append", properties=properties)


def _connection(spark: SparkSession, url: str, properties: dict[str, str]):
    if "driver" in properties:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    known = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        known.setProperty(k, v)
    return spark._jvm.java.sql.DriverManager.getConnection(url, known)


def _delete_batch(spark: SparkSession, url: str, table: str, properties: dict[str, str], batch: int) -> None:
    con = _connection(spark, url, properties)
    try:
        quote = con.getMetaData().getIdentifierQuoteString()  # Spark has quoted the column's name
        con.createStatement().executeUpdate(f"delete from {table} where {quote}batch_id{quote} = {int(batch)}")
    finally:
        con.close()


def batch_jdbc(df: DataFrame, batch: int, url: str, table: str, properties: dict[str, str]) -> None:
    """One batch of command activity, with its number in batch_id. Rows that an earlier attempt of the same batch has left go
    first, so a batch that is run again leaves what it would have left the first time, wherever that one broke off."""
    rows = df.drop("epoch").withColumn("batch_id", F.lit(batch).cast("bigint"))
    if _exists(df.sparkSession, url, table, properties):
        _delete_batch(df.sparkSession, url, table, properties, batch)
    rows.write.jdbc(url, table, mode="append", properties=properties)


def _exists(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> bool:
    con = _connection(spark, url, properties)
    try:
        found = con.getMetaData().getTables(None, None, table.upper(), None)
        return found.next() or con.getMetaData().getTables(None, None, table, None).next()
    finally:
        con.close()


_CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _local(path: str) -> str:
    if not path.startswith(("file:", "/")):
        raise ValueError("an embedded database loads from and exports to local files only")
    return "/" + path.removeprefix("file:").lstrip("/")


def _calls(spark: SparkSession, url: str, properties: dict[str, str], *statements: str) -> None:
    con = _connection(spark, url, properties)
    try:
        for one in statements:
            con.createStatement().execute(one)
    finally:
        con.close()


def batch_embedded(df: DataFrame, batch: int, url: str, table: str, properties: dict[str, str]) -> None:
    """batch_jdbc() for a Derby database within the driver's process, which tasks in other processes can't open: they write files, which the
    database loads one after another. The batch's number has an index."""
    spark, rows = df.sparkSession, df.drop("epoch").withColumn("batch_id", F.lit(batch).cast("bigint"))
    if _exists(spark, url, table, properties):
        _delete_batch(spark, url, table, properties, batch)
    else:
        rows.limit(0).write.jdbc(url, table, mode="append", properties=properties)  # makes the table; no task has a row
        _calls(spark, url, properties, f'create index {table}_batch on {table} ("batch_id")')
    path = scratch(spark, "load")
    rows.write.options(**_CSV).csv(path)
    files = sorted(glob.glob(f"{_local(path)}/part-*"))
    load = "call syscs_util.syscs_import_table(null, '{}', '{}', ',', '\"', 'UTF-8', 0)"
    _calls(spark, url, properties, *[load.format(table.upper(), f) for f in files])


def back_embedded(spark: SparkSession, url: str, table: str, properties: dict[str, str], schema: str, batches: list[int]) -> DataFrame:
    """The rows of these batches, exported to a file each."""
    path = scratch(spark, "export")
    os.makedirs(_local(path))
    get = "call syscs_util.syscs_export_query('select * from {} where \"batch_id\" = {}', '{}/{}.csv', ',', '\"', 'UTF-8')"
    _calls(spark, url, properties, *[get.format(table, int(b), _local(path), int(b)) for b in batches])
    # what is quoted and empty is a text, what is not quoted is null
    return spark.read.schema(schema).options(**_CSV, multiLine=True, nullValue="\x00").csv(path)


def stream_jdbc(commands: DataFrame, url: str, table: str, properties: dict[str, str], checkpoint: str):
    """A stream of command activity into a database table, each batch once; returns the started query."""
    write = lambda df, batch: batch_jdbc(df, batch, url, table, properties)
    return commands.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and Spark runs in one process, a temporary one that goes with it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="activity-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a folder of scratch() and read back: for what is needed more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def unwritten(*frames: DataFrame) -> None:
    """Delete what written() has left for these frames, once nothing that is still to be computed reads it."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
