"""Media columns: payloads stored once per digest in tar shards, addressed by digest, offset and length.

``write_shards`` turns each text into a grey-scale PNG (64 samples a row, 8 bits a sample) and appends it to the
task's tar shard in the shared folder; equal payloads of a shard are stored once, under their SHA-256. The rows of the
index carry digest, shard, offset and length, never the bytes. ``read_metadata`` fills the metadata columns from a
range read of the first bytes of each object; ``read_features`` range-reads whole objects and decodes them.

No step shuffles a payload, only the index is dealt out by shard. A retried task writes a shard under a new name, and only the rows of the attempt that
succeeded are in the index, so a lost executor costs a repeated task and an unreferenced file.

Edge cases: a null text is an empty one; an empty text is one row of 64 zero bytes; copies share one object per shard and
have equal values, and so do ties and repeated rows, each of which is a row of the index; a very long text is one payload, held whole
by its task; an empty table gives an empty index; columns besides the id and the text are ignored; null ids stay.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import prepare, scratch, table

WIDTH = 64
HEAD = 53  # signature 8, IHDR chunk 25, private chunk with the unpadded length 20
SHARD_BYTES = 1 << 30
ENTRY = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
META = [("width", pa.int64()), ("height", pa.int64()), ("bit_depth", pa.int32()), ("n_bytes", pa.int64())]
FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}


def ddl(fields) -> str:
    return ", ".join(f"`{f[0]}` {DDL[f[1]]}" for f in ((x.name, x.type) if isinstance(x, pa.Field) else x for x in fields))


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes) -> bytes:
    """A PNG whose samples are the padded bytes; a private chunk right after the header keeps the unpadded length."""
    rows = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 in front of each line
    lines[:, 1:] = rows
    return b"".join((
        b"\x89PNG\r\n\x1a\n",
        _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)),
        _chunk(b"quLn", struct.pack(">Q", len(data))),
        _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)),
        _chunk(b"IEND", b""),
    ))


def read_head(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and unpadded length from the first ``HEAD`` bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[37:41] != b"quLn":
        raise ValueError("not an object of this store")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth, struct.unpack(">Q", head[41:49])[0]


def decode_png(data: bytes) -> bytes:
    """The payload of ``encode_png``."""
    _, height, _, _ = read_head(data)
    (size,) = struct.unpack(">I", data[HEAD : HEAD + 4])
    lines = np.frombuffer(zlib.decompress(data[HEAD + 8 : HEAD + 8 + size]), np.uint8).reshape(height, WIDTH + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy and a 16-bin histogram of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    values = np.arange(256)
    mean = float(share @ values)
    dev = float(share @ (values - mean) ** 2) ** 0.5
    some = share[share > 0]
    return f"mean={mean:.3f};dev={dev:.3f};bits={float(-(some * np.log2(some)).sum()) + 0.0:.3f};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(1)))


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        out, shard, at, seen = None, "", 0, {}
        try:
            for batch in batches:
                rows = []
                texts = batch.column(1).cast(pa.binary())
                for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    data = text.as_py() or b""
                    digest = hashlib.sha256(pad(data) + struct.pack(">Q", len(data))).hexdigest()
                    if digest not in seen:
                        if out is None or at > SHARD_BYTES:
                            if out is not None:
                                out.write(bytes(1024))
                                out.close()
                            shard, at, seen = f"{uuid.uuid4().hex}.tar", 0, {}
                            out = fs.open_output_stream(f"{base}/{shard}")
                        body = encode_png(data)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(body)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT) + body + bytes(-len(body) % 512))
                        seen[digest] = (shard, at + 512, len(body))
                        at += 512 + len(body) + -len(body) % 512
                    rows.append((doc_id, digest, *seen[digest]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)] if rows else [pa.array([], f.type) for f in ENTRY], schema=ENTRY)
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    return run


def write_shards(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text below ``root`` and returns the index; consume the result once (it writes as it runs)."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_write(root), ddl(ENTRY))


def _ranges(root: str, fields: list, size, compute):
    """Appends ``compute(bytes)`` of the range of each row; the last objects are remembered, for copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        name, file, known = None, None, {}
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if (shard, offset) not in known:
                    if shard != name:
                        file = fs.open_input_file(f"{base}/{shard}")
                        name = shard
                    if len(known) >= 50_000:
                        known.clear()
                    known[shard, offset] = compute(file.read_at(size or length, offset))
                found.append(known[shard, offset])
            new = [pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), fields, strict=True)] if found else [pa.array([], t) for _, t in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _ in fields)])

    return run


def _append(index: DataFrame, fields: list, run) -> DataFrame:
    had = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(run, f"{had}, {ddl(fields)}")


def read_metadata(index: DataFrame, root: str) -> DataFrame:
    """Adds width, height, bit_depth and n_bytes; reads ``HEAD`` bytes of each object."""
    return _append(index, META, _ranges(root, META, HEAD, read_head))


def describe(data: bytes) -> tuple:
    payload = decode_png(data)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)


def read_features(index: DataFrame, root: str) -> DataFrame:
    """Adds what the stored bytes, read back and decoded, say; each object of a shard is decoded once a task."""
    return _append(index, FEATURES, _ranges(root, FEATURES, None, describe))


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores all texts, then reads metadata and features back from the shards."""
    spark = docs.sparkSession
    root = scratch(spark, "media")
    write_shards(docs, f"{root}/shards").write.parquet(f"{root}/index")
    # a shard's rows go to one task, in the order of its bytes: reads are sequential and copies stand together
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = spark.read.parquet(f"{root}/index").repartition(parts, "shard").sortWithinPartitions("shard", "offset")
    return read_features(read_metadata(index, f"{root}/shards"), f"{root}/shards")


def op1_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "width", "height")
