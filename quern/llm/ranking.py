"""Quality classifier: Bradley-Terry ranking of documents, thresholded at a quantile of the scores.

All rows that may be learnt from take part. They are dealt to blocks of some ``ROWS`` by a hash of the id; preference pairs (a row
labelled 1 over a row labelled 0) are made within a block. The strength of a document is linear in its hashed n-grams and a few shares
of its words; the logistic loss of the strengths' differences over all pairs of all blocks is minimised until it falls no more: each
step reads the texts once, and a task gives the sum of its blocks' gradients, as long as the model, whatever the table. A fifth of
the rows, by a hash of the id, is left out of the pairs; the share of zeros among its labels fixes the quantile of its strengths
that becomes score 0.5.

Edge cases: null and empty texts get a score from the dense features; very long texts are scored whole; without labels of
both kinds each score is 0.5; repeated rows and equal texts have equal scores, whatever their ids; an empty table gives an
empty result; columns other than doc_id and text are ignored; a null id has no remainder and isn't held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import encode, grams, quality
from quern.session import materialise, maybe_broadcast, prepare, table

#: Rows of a block, about; cells of a histogram, and values that are sorted at once; steps that no fit needs.
ROWS, CELLS, STEPS = 512, 4096, 1000
#: Rows of the labels up to which they are broadcast.
LABELS = 1_000_000
PAIRS_PER_ROW = 16
RIDGE = 1e-4
SCALE, DENSE_SCALE = 30.0, 10.0
HELD = "crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1"


def pairs(label: np.ndarray, each: int = PAIRS_PER_ROW) -> tuple[np.ndarray, np.ndarray]:
    """Indices of (preferred, other): each row meets ``each`` rows of the other label, evenly spread."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, int), np.zeros(0, int)
    n = each * max(len(good), len(bad))
    k = np.arange(n)
    return good[k % len(good)], bad[(k + k // len(good)) % len(bad)]


class Block:
    """The n-grams and dense features of some texts, for the loss over the pairs of those that aren't ``left`` out."""

    def __init__(self, texts: list[str], label: np.ndarray, left: np.ndarray, dense: np.ndarray | None = None):
        self.n, self.parts, found, at = len(texts), [], [], 0
        for part in grams.chunks(texts):
            scan = grams.Scan(part)
            own = [(bucket, scan.per_doc(doc)) for bucket, doc in scan.grams()]
            self.parts.append((slice(at, at + scan.n), own))
            if dense is None:
                found.append(scan.dense(scan.base()))
            at += scan.n
        self.dense = dense if dense is not None else np.concatenate(found) if found else np.zeros((0, grams.DENSE))
        kept = np.flatnonzero(~left)
        self.better, self.worse = (kept[k] for k in pairs(label[kept]))

    def strengths(self, x: np.ndarray) -> np.ndarray:
        """x: gram weights, then dense weights, both unscaled."""
        z, w = self.dense @ x[-grams.DENSE :] * DENSE_SCALE, (x[: -grams.DENSE] * SCALE).reshape(grams.KINDS, -1)
        for rows, own in self.parts:
            for kind, (bucket, n) in enumerate(own):
                some = np.flatnonzero(n)
                if len(some):
                    z[rows.start + some] += np.add.reduceat(w[kind][bucket], (np.cumsum(n) - n)[some], dtype=float) / n[some]
        return z

    def loss(self, x: np.ndarray, grad: np.ndarray) -> float:
        """The sum of the losses of all pairs; adds their gradient to ``grad``."""
        z = self.strengths(x)
        d = z[self.better] - z[self.worse]
        r = quality.sigmoid(d) - 1
        pull = np.bincount(self.better, r, minlength=self.n) - np.bincount(self.worse, r, minlength=self.n)
        for rows, own in self.parts:
            for kind, (bucket, n) in enumerate(own):
                grad[kind << grams.BITS : (kind + 1) << grams.BITS] += np.bincount(bucket, np.repeat(pull[rows] * SCALE / np.maximum(n, 1), n), minlength=1 << grams.BITS)
        grad[-grams.DENSE :] += self.dense.T @ pull * DENSE_SCALE
        return float(np.logaddexp(0, -d).sum())


def minimum(*totals) -> np.ndarray:
    """Gram weights, dense weights and centres (zero, as differences have none) at the least mean loss of the pairs.

    ``total(x)``: the sum, its gradient, the number. Of several the last one is minimised, from the minimum of the one before it.
    """

    def mean(total, x):
        value, grad, n = total(x)
        return value / n + RIDGE / 2 * float(x @ x), (grad / n).astype(np.float32) + np.float32(RIDGE) * x

    # what the driver holds of the steps before is single precision, sums in the tasks are double
    x = np.zeros((grams.KINDS << grams.BITS) + grams.DENSE, np.float32)
    for total in totals:
        x = grams.minimise(lambda x, total=total: mean(total, x), x, STEPS, 4)
    x = x.astype(float)
    return np.concatenate([x[: -grams.DENSE] * SCALE, x[-grams.DENSE :] * DENSE_SCALE, np.zeros(grams.DENSE)])


def fit_bradley_terry(texts: list[str], label: np.ndarray) -> np.ndarray:
    """The model of one block: gram weights, dense weights, their centres, then threshold and temperature."""
    left = np.arange(len(label)) % 5 == 4
    block = Block(texts, label, left)
    if not len(block.better):
        return np.append(np.zeros((grams.KINDS << grams.BITS) + 2 * grams.DENSE), (0, 1))

    def total(x):
        grad = np.zeros(len(x))
        return block.loss(x, grad), grad, len(block.better)

    weights = minimum(total)
    z = block.strengths(np.concatenate([weights[: -2 * grams.DENSE] / SCALE, weights[-2 * grams.DENSE : -grams.DENSE] / DENSE_SCALE]))
    # the quantile that splits the rows left out as their labels do, halfway between its neighbours
    fresh = left if len(set(label[left])) == 2 else ~left
    ordered, at = np.sort(z[fresh]), int((label[fresh] == 0).sum())
    return np.append(weights, ((ordered[at - 1] + ordered[at]) / 2, max(1e-3, float(np.std(z)))))


def strengths(scan: grams.Scan, model: np.ndarray) -> np.ndarray:
    size = grams.KINDS << grams.BITS
    w, c = model[size : size + grams.DENSE].astype(float), model[size + grams.DENSE : size + 2 * grams.DENSE].astype(float)
    return grams.scores(scan, model[:size].reshape(grams.KINDS, -1)) + (scan.dense(scan.base()) - c) @ w


def score(scan: grams.Scan, model: np.ndarray) -> np.ndarray:
    return quality.sigmoid((strengths(scan, model) - float(model[-2])) / float(model[-1]) * 2)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label, left, block, dense) of all labelled documents, in blocks; of several texts of an id the smallest, of several labels the largest."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    blocks = max(1, -(-own.count() // ROWS))
    joined = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(maybe_broadcast(own, LABELS), "id")
    rows = joined.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = rows.select("id", "text", "label", (F.pmod(F.xxhash64("id", F.lit("left")), F.lit(5)) == 4).alias("left"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode.slices(batches, 2000):
            found = [(scan := grams.Scan(part)).dense(scan.base()) for part in grams.chunks(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(np.concatenate(found)), pa.list_(pa.float64()))], names=[*batch.schema.names, "dense"])

    # a file is a task's in each step, so as many gradients reach the driver in a step as the cluster has cores
    dealt = rows.repartition(min(blocks, spark.sparkContext.defaultParallelism), "block").sortWithinPartitions("block", "id")
    return dealt.select("text", "label", "left", "block").mapInArrow(run, "text string, label int, left boolean, block int, dense array<double>")


def fitted(rows: DataFrame) -> np.ndarray | None:
    """The weights at the least loss over the pairs of all blocks of (text, label, left, block, dense); None without a pair."""
    spark = rows.sparkSession

    def total(rows, x):
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, grad, value, n = shared.value, np.zeros(len(shared.value)), 0.0, 0

            def add(table: pa.Table) -> tuple[float, int]:
                block = Block(table.column(0).to_pylist(), table.column(1).to_numpy(), table.column(2).to_numpy(), np.array(table.column(4).to_pylist()))
                return block.loss(x, grad), len(block.better)

            held, last = [], None
            for batch in batches:
                number = batch.column(3).to_numpy()
                for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                    if len(part):
                        if held and number[part[0]] != last:
                            some, held = add(pa.Table.from_batches(held)), []
                            value, n = value + some[0], n + some[1]
                            encode.release()
                        held.append(batch.slice(part[0], len(part)))
                        last = number[part[0]]
            if held:
                some = add(pa.Table.from_batches(held))
                value, n = value + some[0], n + some[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([n]), pa.array([grad.astype(np.float32).tobytes()], pa.binary())], names=["value", "n", "grad"])

        found, grad = rows.mapInArrow(run, "value double, n bigint, grad binary").toArrow(), np.zeros(len(x))
        for one in found.column("grad"):
            grad += np.frombuffer(one.as_buffer(), np.float32)
        shared.destroy()
        return pc.sum(found.column("value")).as_py() or 0.0, grad, max(1, pc.sum(found.column("n")).as_py() or 0)

    some = rows.groupBy("block").agg(F.count_distinct(F.when(~F.col("left"), F.col("label"))).alias("kinds")).where("kinds > 1").limit(1).count()
    if not some:
        return None
    # an eighth of the blocks says where to begin, which spares readings of all
    return minimum(lambda x: total(rows.where("block % 8 = 0"), x), lambda x: total(rows, x)).astype(np.float32)


def nth(values: DataFrame, k: int) -> float:
    """The k-th smallest z, from 0: histograms narrow it down until ``CELLS`` values or one are left."""
    while True:
        low, high, n = values.agg(F.min("z"), F.max("z"), F.count("*")).first()
        if low == high:
            return low
        if n <= CELLS:
            return sorted(r.z for r in values.collect())[k]
        cell = F.least(F.floor((F.col("z") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        # CELLS numbers at most
        for c, n in sorted(tuple(r) for r in values.groupBy(cell).count().collect()):
            if k < n:
                break
            k -= n
        values = values.where(cell == c)


def rank_model(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Gram weights, dense weights, their centres, then threshold and temperature, from all labelled documents."""
    spark = prepare(docs.sparkSession)
    rows = materialise(labelled(docs, labels), "labelled")
    weights = fitted(rows)
    if weights is None:
        return np.append(np.zeros((grams.KINDS << grams.BITS) + 2 * grams.DENSE, np.float32), np.float32([0, 1]))
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode.slices(batches, 2000):
            model, texts = shared.value, batch.column(0).to_pylist()
            found = [grams.scores(grams.Scan(part), model[: -2 * grams.DENSE].reshape(grams.KINDS, -1)) for part in grams.chunks(texts)]
            z = np.concatenate(found) + np.array(batch.column(3).to_pylist()) @ model[-2 * grams.DENSE : -grams.DENSE].astype(float) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(z), *batch.columns[1:3]], names=["z", "label", "left"])

    z = materialise(rows.select("text", "label", "left", "dense").mapInArrow(run, "z double, label int, left boolean"), "strengths")
    counts = {r.left: (r.n, r.zeros) for r in z.groupBy("left").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("zeros")).collect()}
    both = [left for left in (True, False) if left in counts and 0 < counts[left][1] < counts[left][0]]
    # the quantile that splits the rows left out as their labels do, halfway between its neighbours
    fresh, at = z.where(F.col("left") == both[0]), counts[both[0]][1]
    spread = z.agg(F.stddev_pop("z")).first()[0]
    return np.append(weights, np.float32([(nth(fresh, at - 1) + nth(fresh, at)) / 2, max(1e-3, spread)]))


def rank(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, score and predicted of each row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode.slices(batches, 2000):
            found = [score(grams.Scan(part), shared.value) for part in grams.chunks([x or "" for x in batch.column(1).to_pylist()])]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(f"NOT ({HELD})")
    return rank(docs, rank_model(docs, learn)).select("doc_id", F.coalesce(F.expr(HELD), F.lit(False)).alias("held_out"), "score", "predicted")
