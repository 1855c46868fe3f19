"""Token ids as Arrow IPC files of fixed-size lists: zero-copy random access to sequences of equal length.

Documents are dealt out by ranges of the id (ties by a hash of the text), sorted, encoded and written one after another;
each file is a run of rows of ``LENGTH`` ids with a mask of the same shape, whose last row is padded. All record batches
of a file but the last have ``ROWS`` rows, so an id's place is arithmetic. ``starts`` turns places in a file into places
in the corpus; ``read`` slices the files, memory-mapped where they are local.

Edge cases: a null or empty text has the end id alone; a very long text is encoded whole by its task and spans as many rows
of a file as it needs; null ids come first; rows with equal ids keep an order fixed by
their text; an empty table writes nothing and reads nothing; other columns are ignored. A retried task writes under a new
name and only the successful attempt's rows are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.encode import batches_of, encoder, slices, vocabulary_path
from quern.session import maybe_broadcast, prepare, scratch, table

LENGTH, ROWS, END = 1024, 256, 2
INDEX = "doc_id bigint, part int, file string, at bigint, n_tokens bigint"


def schema(dtype: np.dtype, length: int = LENGTH) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """Appends ids to one file; keeps less than a record batch in memory."""

    def __init__(self, out, dtype: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.out, self.dtype, self.length, self.rows = out, dtype, length, rows
        self.writer = pa.ipc.new_file(out, schema(dtype, length))
        self.held, self.size, self.at = [], 0, 0

    def append(self, ids: np.ndarray) -> int:
        """The place of the first id in the file."""
        start = self.at
        self.held.append(ids)
        self.size += len(ids)
        self.at += len(ids)
        full = self.rows * self.length
        if self.size >= full:
            data = np.concatenate(self.held)
            for k in range(0, len(data) - full + 1, full):
                self._put(data[k : k + full], full)
            rest = data[len(data) // full * full :]
            self.held, self.size = [rest.copy()], len(rest)
        return start

    def _put(self, data: np.ndarray, real: int) -> None:
        mask = np.zeros(len(data), bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (data, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema(self.dtype, self.length)))

    def close(self) -> None:
        if self.size:
            data = np.concatenate(self.held)
            self._put(np.concatenate([data, np.zeros(-len(data) % self.length, self.dtype)]), len(data))
        self.writer.close()
        self.out.close()


class Reader:
    """Slices of a file's ids; a slice within one record batch is a view of the mapped file."""

    def __init__(self, fs, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.file.schema.field(0).type.list_size
        self.last = (-1, None)

    def _batch(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.last = (k, self.file.get_batch(k).column(0).flatten().to_numpy())
        return self.last[1]

    def slice(self, at: int, n: int, rows: int = ROWS) -> np.ndarray:
        full = rows * self.length
        parts = []
        while n > 0:
            data = self._batch(at // full)[at % full : at % full + n]
            parts.append(data)
            at, n = at + len(data), n - len(data)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write(docs: DataFrame, root: str, path: str, end: int = END) -> DataFrame:
    """Writes the ids of ``docs`` below ``root``; the index (doc_id, part, file, at, n_tokens). Consume it once."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, part = encoder(path), None, TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}.arrow"
        last = np.array([end], enc.dtype)
        for batch in slices(batches):
            if writer is None:
                fs, base = pafs.FileSystem.from_uri(root)
                fs.create_dir(base, recursive=True)
                writer = Writer(fs.open_output_stream(f"{base}/{name}"), enc.dtype)
            texts, at, n = [x or "" for x in batch.column(1).to_pylist()], [], []
            for a, b in batches_of(texts):
                for ids in enc.encode(texts[a:b]):
                    at.append(writer.append(np.concatenate([np.frombuffer(ids, enc.dtype), last])))
                    n.append(len(ids) // enc.dtype.itemsize + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(at), pa.int32()), pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "part", "file", "at", "n_tokens"])
        if writer is not None:
            writer.close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    return rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(run, INDEX)


def starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``, the ids of all documents before: each file's place plus the place in the file."""
    # one row a file
    sums = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return index.join(maybe_broadcast(places), "file").withColumn("start", F.col("first") + F.col("at"))


def read(index: DataFrame, root: str) -> DataFrame:
    """Adds ids_crc32, from the files, to the rows of an index, which are read in the order of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        name = reader = None
        for batch in batches:
            crc = []
            for file, at, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
                if file != name:
                    name, reader = file, Reader(fs, f"{base}/{file}")
                crc.append(zlib.crc32(reader.slice(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())], names=[*batch.schema.names, "ids_crc32"])

    had = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.sortWithinPartitions("file", "at").mapInArrow(run, f"{had}, ids_crc32 bigint")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    root = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), f"{root}/files", vocabulary_path()).write.parquet(f"{root}/index")
    return read(starts(spark.read.parquet(f"{root}/index")), f"{root}/files").select("doc_id", "start", "n_tokens", "ids_crc32")
