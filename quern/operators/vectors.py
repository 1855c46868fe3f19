"""A kept vector index: coarse lists, product codes of what the list's centre leaves over, exact re-scoring of the best.

Centres and code books are learnt on a sample of bounded size (``SAMPLE``, by hash of the id); every vector is indexed. A vector
belongs to the list of its nearest centre and has one byte for each part of its residual. A search takes a share of the
lists (``probe``) and scores their codes in the tasks; of each ``HELD`` vectors a task scores those whole that are the ``candidates`` of
a query by their codes (at least those that are best overall, and all vectors where there are no more) and keeps k. Neither candidates nor vectors are shuffled, only k rows a query
and task. Vectors with their codes are folders by list, so lists that no query asks for aren't read.

Vectors are added, replaced and deleted as segments and tombstones (``segments``), with the centres learnt first; ``rebuilt`` learns
them anew. Similarity is the cosine, 0 for a zero norm.

Odd inputs: null vectors are not indexed; repeated ids within one segment are vectors of their own; ties go to the smaller
id; an empty index has no hits.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.operators.segments import Store
from quern.session import materialise, prepare

SAMPLE, PARTS, CODES, LISTS, STEPS = 20_000, 16, 256, 4096, 12
#: Share of the lists that a query asks, and of the vectors that it reads whole.
PROBE, READ = 0.8, 0.05
#: Vectors and scores that a task holds at once, about.
HELD, SCORES = 1 << 15, 1 << 22
ENCODED = "id bigint, list int, code binary, embedding array<float>"


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v**2).sum(-1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centre."""
    out, half = np.empty(len(v), np.int64), (centres**2).sum(1) / 2
    for k in range(0, len(v), 4096):
        out[k : k + 4096] = (v[k : k + 4096] @ centres.T - half).argmax(1)
    return out


def means(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of k-means from random vectors."""
    centres = v[rng.permutation(len(v))[:k]].copy()
    for _ in range(STEPS):
        own = nearest(v, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, v)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class Model:
    """Centres of the lists and a code book for each part of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng, v = np.random.default_rng(7), unit(sample.astype(np.float64))
        width = v.shape[1]
        self.parts = next(p for p in range(min(PARTS, width), 0, -1) if width % p == 0)
        self.centres = means(v, min(lists, len(v)), rng)
        left = (v - self.centres[nearest(v, self.centres)]).reshape(len(v), self.parts, -1)
        self.books = np.stack([self._book(left[:, p], rng) for p in range(self.parts)])

    @staticmethod
    def _book(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        book = means(v, min(CODES, len(v)), rng)
        return np.concatenate([book, np.repeat(book[:1], CODES - len(book), 0)])

    def encoded(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        own = nearest(v, self.centres)
        left = (v - self.centres[own]).reshape(len(v), self.parts, -1)
        return own, np.stack([nearest(left[:, p], self.books[p]) for p in range(self.parts)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """What codes say of the residuals."""
        return np.concatenate([self.books[p].astype(np.float32)[codes[:, p]] for p in range(self.parts)], 1)

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, books=self.books)
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Model:
        held, made = np.load(io.BytesIO(data)), Model.__new__(Model)
        made.centres, made.books = held["centres"], held["books"]
        made.parts = len(made.books)
        return made


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class VectorIndex:
    """A stored index of (id, embedding); its methods that change something return the next version."""

    def __init__(self, store: Store, model: Model):
        self.store, self.model = store, model

    @staticmethod
    def created(spark: SparkSession, root: str, vectors: DataFrame, lists: int | None = None) -> VectorIndex:
        """``lists``: by default the square root of the number of vectors, ``LISTS`` at most."""
        some = vectors.where("embedding IS NOT NULL")
        n = some.count()
        limit = int(-(2**63) + 2**64 * min(1.0, SAMPLE / max(1, n))) - 1
        # bounded by ``SAMPLE`` whatever the corpus
        sample = some.where(F.xxhash64("id") <= F.lit(max(limit, -(2**63)))).select("id", "embedding").toArrow().sort_by("id").column(1).combine_chunks()
        if not len(sample):
            raise ValueError("an index is learnt from some vectors")
        model = Model(matrix(sample), lists or min(LISTS, max(1, round(n**0.5))))
        spark.createDataFrame([(bytearray(model.saved()),)], "model binary").coalesce(1).write.parquet(f"{root}/model")
        return VectorIndex(Store(spark, root), model).added(some)

    @staticmethod
    def opened(spark: SparkSession, root: str) -> VectorIndex:
        return VectorIndex(Store.opened(spark, root), Model.loaded(bytes(spark.read.parquet(f"{root}/model").first()[0])))

    def added(self, vectors: DataFrame) -> VectorIndex:
        """With vectors added, in place of those of equal ids."""
        shared = prepare(self.store.spark).sparkContext.broadcast(self.model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(k, 4096) for b in batches for k in range(0, b.num_rows, 4096)):
                if batch.num_rows:
                    own, codes = shared.value.encoded(unit(matrix(batch.column(1))))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["id", "list", "code", "embedding"])

        some = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        made = materialise(some.mapInArrow(run, ENCODED), "encoded-vectors")
        name = self.store.folder("segment")
        # a file a list, several for one that holds many vectors
        made.hint("rebalance", "list").write.partitionBy("list").parquet(f"{self.store.root}/{name}/vectors")
        gone = (self.store.buried(some),) if self.store.segments else ()
        return VectorIndex(self.store.commit((name,), gone), self.model)

    def deleted(self, ids: DataFrame) -> VectorIndex:
        return VectorIndex(self.store.commit((), (self.store.buried(ids),)), self.model)

    def vectors(self) -> DataFrame:
        """(id, segment, list, embedding) of the vectors that count."""
        return self.store.live(self.store.read("vectors", ENCODED)).select("id", "embedding", "list", "segment")

    def rebuilt(self, root: str) -> VectorIndex:
        """An index below a new folder, learnt from the vectors that count now."""
        return VectorIndex.created(self.store.spark, root, self.vectors())

    def searched(self, queries: DataFrame, k: int = 10, probe: float = PROBE, read: float = READ) -> DataFrame:
        """Ranked lists (query_id, id, score, rank) for a stated set of queries (query_id, embedding), in blocks."""
        n = self.store.live(self.store.read("vectors", ENCODED).select("id", "segment")).count()
        candidates = max(2 * k, int(read * n))
        return R.top(R.blocks(queries, lambda some: self._block(some, candidates, probe, k)), k)

    def _block(self, queries: DataFrame, candidates: int, probe: float, k: int) -> DataFrame:
        """(query_id, id, score): k rows a query and task."""
        spark = self.store.spark
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").toArrow()
        ids, q = asked.column(0).to_numpy(), unit(matrix(asked.column(1).combine_chunks())) if asked.num_rows else np.zeros((0, self.model.centres.shape[1]))
        coarse = q @ self.model.centres.T
        lists = max(1, round(probe * len(self.model.centres)))
        probed = np.zeros(coarse.shape, bool)
        np.put_along_axis(probed, np.argsort(-coarse, 1)[:, :lists], True, 1)
        shared = prepare(spark).sparkContext.broadcast((ids, q, np.where(probed, coarse, -np.inf).astype(np.float32), self.model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q, near, model = shared.value
            if not len(qid):
                return
            step = max(1, SCORES // HELD)
            best = [R.Best(len(qid[at : at + step]), k) for at in range(0, len(qid), step)]

            def add(parts: list[tuple]) -> None:
                own, lists, codes, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
                whole, left, short = unit(whole), model.decoded(codes), q.astype(np.float32)
                for n, at in enumerate(range(0, len(qid), step)):
                    score = near[at : at + step, lists]
                    out = np.isinf(score)
                    if len(own) > candidates:
                        score += short[at : at + step] @ left.T
                        np.put_along_axis(out, np.argpartition(-score, candidates - 1, 1)[:, candidates:], True, 1)
                    # most vectors are candidates of some query, so their product costs less than picking them
                    exact = q[at : at + step] @ whole.T
                    exact = np.copysign(np.floor(np.abs(exact) * 1e6 + 0.5), exact) / 1e6 + 0.0
                    exact[out] = -np.inf
                    best[n].add(exact, own)

            parts, held = [], 0
            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    parts.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)), codes, R.matrix(batch.column(3))))
                    held += batch.num_rows
                if held >= HELD:
                    add(parts)
                    parts, held = [], 0
            if parts:
                add(parts)
            for n, at in enumerate(range(0, len(qid), step)):
                if len(best[n].q):
                    yield best[n].rows(qid[at : at + step])

        wanted = np.flatnonzero(probed.any(0)).tolist()  # no more than there are lists
        found = self.store.live(self.store.read("vectors", ENCODED).where(F.col("list").isin(wanted) if wanted else F.lit(False)))
        return found.select("id", "list", "code", "embedding").mapInArrow(run, "query_id bigint, id bigint, score double")
