"""What several operators share: the folder that all executors see, and small column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that parts words in most operators, as a Java character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, as a URI; below a local temporary folder only where that setting is unset
    and driver and executors are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="tallyloom-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        base = "file://" + _own["dir"]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: this cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what kept() has written for these frames, once nothing that is still to be computed reads it."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as pyarrow knows it, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, *parts: bytes | memoryview) -> int:
    """Write a file under a name that no other task attempt uses; the caller's manifest names the files that count."""
    where, path = open_fs(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as out:
        for part in parts:
            out.write(part)
    return sum(len(memoryview(p).cast("B")) if len(p) else 0 for p in parts)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row. A plain column could be put into every use of it, in lambdas even once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches of few rows, as texts can be very long: memory in a Python worker stays bounded by a batch and a document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit (SplitMix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "replace")


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def gathered(rows: Iterable[tuple], schema: pa.Schema, rows_most: int = 500, bytes_most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, in the order of the schema, as batches of many: a batch costs Spark about a millisecond, whatever is in it."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= rows_most or size >= bytes_most:
            yield out()
            held, size = [], 0
    if held:
        yield out()
