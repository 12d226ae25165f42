"""A streaming source of polls: numbered snapshots of open windows, with the number of the next one as its offset.

A poller puts each poll into a folder under its number, as JSON lines of ts, host and windows: `000000000017.jsonl`. The source reads what
lies between two numbers, so a query that starts again from its checkpoint reads the same polls, and no more. Files that
are not numbered are not polls. A poll that is written must be whole: pollers write beside the folder and rename.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tallyloom.streaming.snapshots import ROW

_NAME = re.compile(r"(\d+)\.jsonl")
#: Polls of a partition.
POLLS_PER_TASK = 100


class Polls(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PollReader(DataSourceStreamReader):
    """Offsets are {"next": n}: all polls below n are read. A batch takes at most `most` polls."""

    def __init__(self, uri: str, most: int):
        self.uri, self.most = uri, most
        self.seen = 0

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return (fs.LocalFileSystem(), self.uri.removeprefix("file://")) if "://" not in self.uri or self.uri.startswith("file:") else fs.FileSystem.from_uri(self.uri)

    def _numbers(self) -> dict[int, str]:
        where, path = self._folder()
        files = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {int(m[1]): f.path for f in files if f.is_file and (m := _NAME.fullmatch(f.base_name))}

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        there = sorted(n for n in self._numbers() if n >= self.seen)[: self.most]
        return {"next": there[-1] + 1 if there else self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # after a restart this is the first that tells how far the query is
        self.seen = max(self.seen, end["next"])
        paths = [p for n, p in sorted(self._numbers().items()) if start["next"] <= n < end["next"]]
        return [Polls(paths[k : k + POLLS_PER_TASK]) for k in range(0, len(paths), POLLS_PER_TASK)]

    def read(self, partition: Polls) -> Iterator[tuple]:
        where, _ = self._folder()
        for path in partition.paths:
            with where.open_input_stream(path) as f:
                for line in f.read().decode().splitlines():
                    if line.strip():
                        row = json.loads(line)
                        yield datetime.fromisoformat(row["ts"]), row["host"], row["windows"]

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end["next"])


class PollSource(DataSource):
    """spark.dataSource.register(PollSource); spark.readStream.format("polls").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "polls"

    def schema(self) -> str:
        return ROW

    def streamReader(self, schema) -> PollReader:
        return PollReader(self.options["path"], int(self.options.get("most", "1000")))
