"""A data source that reads the ends of log files: blocks from the back until enough lines match, not the whole files.

``spark.read.format("log_tail")`` has a partition for each file; a task reads its file backwards in blocks of ``BLOCK`` bytes and
stops when it has ``limit`` matching lines, so what is read is bounded by the tail and not by the log. The newest lines of all
files are then the ones with the latest times.

Lines are JSON with ts, level, logger and message; others are passed over. A last line without a line feed counts; lines
longer than a block are joined; bytes that aren't UTF-8 become replacement characters; an empty file has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.session import prepare

BLOCK = 1 << 16
ROW = "file string, pos bigint, ts string, level string, logger string, message string, bytes_read bigint"


def lines_from_the_end(read: Callable[[int, int], bytes], size: int, block: int = BLOCK) -> Iterator[tuple[int, bytes, int]]:
    """(place, line, bytes read so far) of a file's lines, last first; ``read(at, n)`` gives bytes."""
    end, held, done = size, b"", 0
    while end > 0:
        start = max(0, end - block)
        held = read(start, end - start) + held
        done += end - start
        end = start
        cut = len(held)
        while (at := held.rfind(b"\n", 0, cut)) >= 0:
            if at + 1 < cut:
                yield end + at + 1, held[at + 1 : cut], done
            cut = at
        held = held[:cut]
    if held:
        yield 0, held, done


def parsed(line: bytes, level: str | None, search: str | None) -> dict | None:
    """The row of a line that matches, or None."""
    text = line.decode("utf-8", "replace")
    if search and search.lower() not in text.lower():
        return None
    try:
        row = json.loads(text)
    except ValueError:
        return None
    if not isinstance(row, dict) or row.get("ts") is None or level and level != "all" and row.get("level") != level.upper():
        return None
    return row


class FilePartition(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(self.options["path"])
        found = fs.get_file_info(base)
        files = [found] if found.is_file else [f for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.is_file and f.base_name.endswith(self.options.get("suffix", ""))]
        head = self.options["path"][: len(self.options["path"].rstrip("/")) - len(base.rstrip("/"))]
        return [FilePartition(f"{head}{f.path}") for f in sorted(files, key=lambda f: f.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        from pyarrow import fs as pafs

        limit, level, search = int(self.options.get("limit", 100)), self.options.get("level"), self.options.get("search")
        fs, path = pafs.FileSystem.from_uri(partition.uri)
        with fs.open_input_file(path) as file:
            left = limit
            for pos, line, done in lines_from_the_end(lambda at, n: file.read_at(n, at), file.size(), int(self.options.get("block", BLOCK))):
                if left <= 0:
                    return
                if row := parsed(line, level, search):
                    left -= 1
                    text = lambda k, row=row: None if row.get(k) is None else str(row[k])
                    yield partition.uri, pos, text("ts"), text("level"), text("logger"), text("message"), done


class LogTail(DataSource):
    """Options: path, limit, level, search, suffix, block."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> TailReader:
        return TailReader(self.options)


def newest(spark: SparkSession, path: str, limit: int = 100, level: str | None = None, search: str | None = None) -> DataFrame:
    """The newest matching rows of the log files below a path, newest first."""
    prepare(spark).dataSource.register(LogTail)
    reader = spark.read.format("log_tail").option("limit", limit)
    for key, value in (("level", level), ("search", search)):
        reader = reader.option(key, value) if value else reader
    return reader.load(path).orderBy(F.desc("ts"), F.desc("file"), F.desc("pos")).limit(limit)
