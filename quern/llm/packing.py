"""Mixture-controlled packing: deficit round-robin over source queues, windows filled to target token proportions.

Each source is a queue of its documents' ids (each document ends with the id 0). A window of ``WINDOW`` ids grants every
queue its share by weight; what a share cannot pay in whole ids is carried to the next window as that queue's deficit, and
an exhausted queue's share goes to the others. The service of a queue after w windows therefore has a closed form
(``Schedule``): with weight p it has sent min(total, floor(p * v)) ids, where v is the virtual time at which all queues
together have sent w * WINDOW. So no task has to replay the rounds before its own: a document knows from its place in its
queue in which windows, and where in them, its ids lie, and deficits carry across windows and partitions alike. Windows
follow each other without gaps and are cut into sequences of ``LENGTH``; only the last sequence is padded. The targets are
stated: sources in code-point order (null last) weigh 1, 2, 3, repeating, unless ``weights`` says otherwise; ``shares``
reports what each window got of each source.

Two passes: ids are encoded and written with their place in the partition's part of the queue; sums by partition and
source then give each part its place. Documents aren't shuffled. Tasks get the totals and weights of all queues, 40 bytes a
source; names stay on the executors.

Edge cases: a null or empty text is the end id alone; very long texts are cut over windows like any other; a null source is
a queue of its own; copies and repeated rows are packed each; an empty table gives an empty result; columns other than
doc_id, text and source are ignored.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.encode import batches_of, encoder, slices, vocabulary_path
from quern.session import materialise, maybe_broadcast, prepare, table

LENGTH, END = 1024, 0
WINDOW = 64 * LENGTH
#: Numbers of windows' plans that a task keeps.
KNOWN = 1 << 21
TOKENS = "doc_id bigint, queue string, part int, at bigint, n bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window_id bigint, source string"


class Schedule:
    """Where each id of each queue goes, from the queues' totals and integer weights (1 or more)."""

    def __init__(self, totals: list[int], weights: list[int], window: int = WINDOW):
        if totals and (min(weights) < 1 or max(weights) * max(1, sum(totals)) >= 1 << 62):
            raise ValueError("weights must be whole numbers from 1 on, and small")
        self.window, self.n = window, sum(totals)
        self.totals, self.weights = np.array(totals, np.int64), np.array(weights, np.int64)
        # queues by the virtual time total / weight at which they run dry
        order = sorted(range(len(totals)), key=lambda k: (totals[k] / weights[k], k))
        dry = [0, *accumulate(totals[k] for k in order)]
        left = [0, *accumulate(weights[k] for k in reversed(order))][::-1]
        # ids sent by all queues when the k-th runs dry; the products can be longer than 64 bits
        sent = [dry[i] + totals[k] * left[i] // weights[k] for i, k in enumerate(order)]
        self.rank = np.empty(len(totals), np.int64)
        self.rank[order] = np.arange(len(totals))
        self.dry, self.left, self.sent = np.array(dry, np.int64), np.array(left, np.int64), np.array(sent, np.int64)
        self.times = np.array([totals[k] / weights[k] for k in order])
        self.windows = -(-self.n // window)
        self.known: OrderedDict[int, tuple[np.ndarray, int, np.ndarray]] = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"known": OrderedDict()}

    def served(self, window: int) -> np.ndarray:
        """Ids that each queue has sent before ``window``."""
        ids = window * self.window
        if ids >= self.n:
            return self.totals
        i = int(np.searchsorted(self.sent, ids, side="right"))
        now = np.minimum(self.totals, self.weights * (ids - self.dry[i]) // self.left[i])
        return np.where(self.rank < i, self.totals, now)

    def of(self, window: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Served before the window, the window's place, and each queue's place in the window."""
        if window in self.known:
            self.known.move_to_end(window)
        else:
            while len(self.known) * 2 * len(self.totals) > KNOWN:
                self.known.popitem(last=False)
            now, then = self.served(window), self.served(window + 1)
            self.known[window] = (now, int(now.sum()), np.concatenate([[0], np.cumsum(then - now)]))
        return self.known[window]

    def window_of(self, queue: int, at: int) -> int:
        """The window in which the queue sends its id ``at``."""
        v = at / int(self.weights[queue])
        i = int(np.searchsorted(self.times, v))
        guess = int(self.dry[i] + self.left[i] * v) // self.window
        low, high = max(0, guess - 2), min(max(0, self.windows - 1), guess + 3)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.of(mid)[0][queue] <= at else (low, mid - 1)
        return low

    def pieces(self, queue: int, at: int, n: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
        """(ids before it in the stretch, length, place in the stream, window) for a queue's ids at .. at + n."""
        done = 0
        window = self.window_of(queue, at)
        while done < n:
            now, first, places = self.of(window)
            size = int(places[queue + 1] - places[queue])
            x = at + done - int(now[queue])
            if x >= size:
                window += 1
                continue
            here = min(n - done, size - x)
            place = first + int(places[queue]) + x
            while here:
                part = min(here, length - place % length)
                yield done, part, place, window
                done, here, place = done + part, here - part, place + part


def tokens(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """The ids of each row with its place in the partition's part of its queue."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, places = encoder(path), TaskContext.get().partitionId(), {}
        last = np.array([end], enc.dtype).tobytes()
        for batch in slices(batches):
            texts, queues = [x or "" for x in batch.column(2).to_pylist()], batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                ids = [x + last for x in enc.encode(texts[a:b])]
                n, at = [len(x) // enc.dtype.itemsize for x in ids], []
                for q, k in zip(queues[a:b], n, strict=True):
                    at.append(places.get(q, 0))
                    places[q] = at[-1] + k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(queues[a:b], pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "at", "n", "ids"])

    queue = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, weights: dict[str, int] | None = None, path: str | None = None, window: int = WINDOW, length: int = LENGTH) -> DataFrame:
    """One row a piece; ``weights``: whole number by source (1 for others), by default 1, 2, 3 repeating in code-point order."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    held = materialise(tokens(docs, path), "packing-tokens")
    # one row for each partition and source, then one for each source
    parts = held.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = materialise(parts.select("queue", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "packing-places")
    number = (F.row_number().over(Window.orderBy("queue")) - 1).alias("number")
    given = F.lit(None) if not weights else F.create_map(*(F.lit(x) for s, w in weights.items() for x in (f"0{s}", w)))[F.col("queue")]
    share = F.col("number") % 3 + 1 if weights is None else F.coalesce(given, F.lit(1))
    queues = materialise(places.groupBy("queue").agg(F.sum("n").alias("total")).select("queue", "total", number).withColumn("weight", share.cast("long")), "packing-queues")
    sums = queues.orderBy("number").select("total", "weight").toArrow()
    plan = spark.sparkContext.broadcast(Schedule(sums["total"].to_pylist(), sums["weight"].to_pylist(), window))
    wide = encoder(path).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            rows = []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "queue", "number", "at", "first", "n")]
            blobs = batch.column(batch.schema.get_field_index("ids"))
            for k, (doc_id, queue, number, at, first, n) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                data = np.frombuffer(blobs[k].as_buffer(), wide).astype("<u4").tobytes()
                source = queue[1:] if queue[0] == "0" else None
                for start, size, place, own in plan.value.pieces(number, first + at, n, length):
                    rows.append((doc_id, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, place // length, place % length, own, source))
            out = list(zip(*rows, strict=True)) if rows else [()] * 9
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id", "source"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:8]), pa.array(out[8], pa.string())], names=names)

    where = places.drop("n").join(maybe_broadcast(queues.select("queue", "number")), "queue")
    return held.join(maybe_broadcast(materialise(where, "packing-where")), ["queue", "part"]).select("doc_id", "queue", "number", "at", "first", "n", "ids").mapInArrow(run, PIECES)


def shares(pieces: DataFrame) -> DataFrame:
    """(window_id, source, tokens, share): what each window of packed pieces got of each source."""
    found = pieces.groupBy("window_id", "source").agg(F.sum("length").alias("tokens"))
    return found.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("window_id")))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
