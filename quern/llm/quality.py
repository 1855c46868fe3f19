"""Quality rules: hashed n-gram logistic regression, calibrated, scored in Arrow batches against fixed thresholds.

A bounded sample of labelled rows (``SAMPLE`` rows, those of the smallest hash of the id) trains the weights in one
task; a fifth of it is left out and gives the two numbers of the calibration. All documents are then scored in Arrow
batches with the broadcast weights (``4 * 2**18`` floats, whatever the corpus).

Edge cases: a null or empty text has no words, fails the base rule and isn't kept; very long texts are counted and scored
whole, each in a chunk of its own; without any usable label of both kinds the model keeps all that the base rule keeps; an
empty table gives an empty result; null ids and repeated rows are scored like any other; equal texts have equal verdicts;
labels with a null quality or id are left out; columns besides id and text are passed through where they aren't overwritten
(``prefix`` keeps the new names apart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import encode, grams
from quern.session import prepare, table

SAMPLE = 3000
SCALE = 30.0
RIDGE = 2e-4
#: A document is kept from this calibrated probability of label 1 on.
KEEP = 0.3
#: The base rule: fewer words than this, or more than this percentage of words in repeated windows, fails.
LEAST_WORDS, MOST_REPEATED = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(_id, text, label) of at most ``rows`` labelled documents, chosen by hash: the same ones on each run.

    Of several texts with one id the smallest is taken, of several labels the largest.
    """
    some = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("_id").isNotNull())
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    # at most ``rows`` rows of two numbers, so the broadcast is bounded
    joined = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(some), "_id")
    return joined.groupBy("_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fit_task(fit):
    """A mapInArrow function for one partition of (_id, text, label): ``fit(texts, labels)`` as one binary row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.forget()
        rows = sorted((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)), key=lambda r: r[0])
        model = fit([r[1] for r in rows], np.array([r[2] for r in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(model, np.float32).tobytes()], pa.binary())], names=["model"])

    return run


def train(rows: DataFrame, fit) -> np.ndarray:
    """Runs ``fit`` in one task over a bounded sample; what comes back to the driver is the model."""
    found = rows.repartition(1).mapInArrow(fit_task(fit), "model binary").first()
    return np.frombuffer(found[0], np.float32) if found else np.ascontiguousarray(fit([], np.zeros(0)), np.float32)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(texts: list[str], label: np.ndarray) -> np.ndarray:
    """Weights, then bias, slope and offset of the calibration."""
    size = grams.KINDS << grams.BITS
    out = np.zeros(size + 3)
    out[size:] = (0, 1, 10)  # keeps everything
    if len(set(label)) < 2:
        return out
    rows, cols, values, _ = grams.matrix(texts)
    used, col = grams.compact(cols)
    del cols
    left = np.arange(len(texts)) % 5 == 4
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * ~left
    share /= share.sum() or 1
    values *= np.float32(SCALE)

    def loss(x):
        z = grams.product(rows, col, values, x[:-1], len(texts)) + x[-1]
        p = sigmoid(z)
        grad = share * (p - label)
        value = float(share @ (np.logaddexp(0, z) - label * z)) + RIDGE / 2 * float(x[:-1] @ x[:-1])
        return value, np.append(grams.transposed(rows, col, values, grad, len(used)) + RIDGE * x[:-1], grad.sum())

    x = grams.minimise(loss, np.zeros(len(used) + 1))
    out[used] = x[:-1] * SCALE
    z = grams.product(rows, col, values, x[:-1], len(texts)) + x[-1]
    fresh = left if len(set(label[left])) == 2 else ~left

    def platt(ab):
        y = (label[fresh] * (label[fresh].sum() + 1) + (1 - label[fresh])) / np.where(label[fresh] == 1, label[fresh].sum() + 2, (1 - label[fresh]).sum() + 2)
        s = ab[0] * z[fresh] + ab[1]
        r = sigmoid(s) - y
        return float((np.logaddexp(0, s) - y * s).mean()), np.array([(r * z[fresh]).mean(), r.mean()])

    out[size:] = (x[-1], *grams.minimise(platt, np.array([1.0, 0.0])))
    return out


def probability(scan: grams.Scan, model: np.ndarray) -> np.ndarray:
    bias, slope, offset = model[-3:].astype(float)
    z = grams.scores(scan, model[:-3].reshape(grams.KINDS, -1)) + bias
    return sigmoid(slope * z + offset)


def verdicts(docs: DataFrame, model: np.ndarray, keep: float = KEEP, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with the base counts, ``quality_p``, ``base_failed`` and ``kept`` under the prefix (same-named columns go)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    new = [*((prefix + c, pa.int64()) for c in COUNTS), (prefix + "base_failed", pa.bool_()), (prefix + "kept", pa.bool_()), (prefix + "quality_p", pa.float64())]
    held = docs.drop(*(c for c, _ in new))
    at = held.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.forget()
        for batch in encode.slices(batches, 2000):
            texts, found = [x or "" for x in batch.column(at).to_pylist()], {c: [] for c, _ in new}
            for part in grams.chunks(texts):
                scan = grams.Scan(part)
                base = scan.base()
                p = probability(scan, shared.value)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                for c, v in (base | {"base_failed": failed, "kept": ~failed & (p >= keep), "quality_p": p}).items():
                    found[prefix + c].append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(found[c]) if found[c] else [], t) for c, t in new)], names=[*batch.schema.names, *(c for c, _ in new)])

    had = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double"}
    return held.mapInArrow(run, f"{had}, " + ", ".join(f"`{c}` {kinds[t]}" for c, t in new))


def quality_model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    prepare(docs.sparkSession)
    return train(sample(docs, labels, rows), fit_logistic)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return verdicts(docs, model).select("doc_id", *COUNTS, "base_failed", "kept", "quality_p")
