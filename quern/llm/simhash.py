"""SimHash near-dedup: vantage-point trees deal the fingerprints to shards, triangle bounds prune, exact pairs are linked.

The trees and the search of a shard are in ``vantage``: three trees, one for each block of bits of which one differs in a
single bit at most, with vantage points from a bounded sample of fingerprints (``SAMPLE``), as deep as their number asks
(``SHARD``). Each fingerprint goes to its own shard, and as a guest to those whose boundary it overlaps; shards are searched
on, compared exactly, and give a spanning forest: at most one link a fingerprint. What no vantage point parts (fingerprints
within about eight bits of each other) is one shard however large, held as 9 bytes a fingerprint.

Components of the links are found with min-label propagation and pointer jumping over distinct fingerprints, in written
rounds; Spark splits the hot labels of these joins (adaptive skew joins). Joins of rows deal hot fingerprints apart (``skew``).

Edge cases: null and empty texts have fingerprint zero, which links like any other; fewer than four words are one
shingle; very long texts are read whole, in slices; repeated rows and copies share a fingerprint; rows with a null id get
their component, which a null never names (null if nothing else is in it); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import encode, jaccard, vantage
from quern.llm.skew import hot_join
from quern.session import materialise, maybe_broadcast, prepare, table

SHINGLE = 4
RADIUS = vantage.RADIUS
SEED = 42
#: Fingerprints in a shard, about; and the most that are sampled to plant the trees.
SHARD, SAMPLE = 8192, 1 << 20
#: Rows of four numbers that are broadcast at most, 32 bytes each.
MARKED = 200_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Digests of the word shingles of a whole text in order; one of the whole text if it has no more words than that."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data, n = b" ".join(words), len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends[: n - size + 1] - [len(w) + 1 for w in words[: n - size + 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle digests: the bits that most of them have."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(h)).astype(np.uint64)).sum())


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    return majority(shingles(text, size))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.forget()
        for batch in encode.slices(batches, 2000):
            fps = [signed(fingerprint(x.as_py(), size)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def plant(fps: DataFrame) -> list[vantage.Tree]:
    """Trees from a sample of the distinct fingerprints, by hash: about LEAF for each SHARD of them, SAMPLE at most."""
    n = fps.count()
    wanted = min(SAMPLE, -(-n // SHARD) * vantage.LEAF)
    limit = int(-(2**63) + 2**64 * min(1.0, wanted / max(1, n))) - 1
    # bounded by ``SAMPLE`` whatever the corpus
    some = fps.where(F.xxhash64("fp") <= F.lit(max(limit, -(2**63)))).select("fp").toArrow()
    return vantage.plant(some.column(0).to_numpy().view(np.uint64))


def deal(fps: DataFrame, grown: list[vantage.Tree]) -> DataFrame:
    """(tree, shard, fp, home) of each fingerprint in its own shards and in those whose boundary it overlaps."""
    shared = prepare(fps.sparkSession).sparkContext.broadcast(grown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.forget()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, tree in enumerate(shared.value):
                leaf, at, home, _, _ = tree.route(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), k, np.int32)), pa.array(leaf), pa.array(fp[at]), pa.array(home)], names=["tree", "shard", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "tree int, shard bigint, fp bigint, home boolean")


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the shards of a partition sorted by (tree, shard); a shard may cross batches."""
    masks, held, now = vantage.block_masks(), [], None

    def done() -> pa.RecordBatch:
        fp, home = (np.concatenate([h[k] for h in held]) for k in range(2))
        a, b, _ = vantage.links(fp.view(np.uint64), home, masks[now[0]])
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        tree, shard, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(shard) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
            if a == b:
                continue
            key = int(tree[a]), int(shard[a])
            if held and key != now:
                yield done()
                held = []
            now = key
            held.append((fp[a:b], home[a:b]))
    if held:
        yield done()


def links(fps: DataFrame) -> DataFrame:
    """Distinct links (a, b), a < b, that connect all distinct fingerprints within RADIUS bits of each other."""
    spread = deal(fps, plant(fps))
    return spread.repartition("tree", "shard").sortWithinPartitions("tree", "shard").mapInArrow(searched, "a bigint, b bigint").distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, label): the smallest node that is connected to each node of ``edges`` (a, b).

    Each round hooks every node to the smallest label around it and then jumps pointers, so the rounds follow the
    logarithm of the diameter. A hot node's neighbours are combined before the shuffle (min), rounds are written.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most):
        around = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = materialise(label.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "hooked")
        # the root of a node's old label learns of the smaller one as well
        roots = hooked.where("label < was").groupBy(F.col("was").alias("node")).agg(F.min("label").alias("root"))
        hooked = materialise(hooked.join(roots, "node", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label")), "hooked")
        up = hooked.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialise(hooked.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = jumped.where("label <> was").limit(1).count()
        label = jumped.select("node", "label")
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def groups(docs: DataFrame, similarity: float | None = jaccard.SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of the component) of each row.

    Links are the pairs of that Jaccard similarity or more on sets of five words (``jaccard``); without a similarity, the
    fingerprints within RADIUS bits, and each row's fingerprint is returned as fp.
    """
    if similarity is None:
        rows = materialise(fingerprints(docs).withColumn("node", F.col("fp")), "fingerprints")
        return hot_join(rows, membership(docs, rows, None), "node").select("doc_id", "fp", "component_id")
    rows = materialise(jaccard.sketches(docs), "sketches")
    return hot_join(rows.select("doc_id", "node"), membership(docs, rows, similarity), "node").select("doc_id", "component_id")


def membership(docs: DataFrame, rows: DataFrame, similarity: float | None) -> DataFrame:
    """(node, component_id, label) of the nodes of ``rows`` (doc_id, node and, with a similarity, the sketches of ``docs``)."""
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first")), "nodes")
    if similarity is None:
        label = components(materialise(links(nodes.select(F.col("node").alias("fp"))), "links"))
    else:
        label = jaccard.labels(docs, rows, similarity)
    joined = nodes.join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    joined = materialise(joined, "members")
    least = materialise(joined.groupBy("label").agg(F.min("first").alias("component_id")), "components")
    return materialise(hot_join(joined, least, "label").select("node", "component_id", "label"), "of-node")


def first_of_each(docs: DataFrame, similarity: float = jaccard.SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id (null last), then digest.

    Of rows that are equal in id and text one stays, that of the smallest digest of the whole row. Texts are shuffled only
    for rows of this kind, or if more than ``MARKED`` rows have to go.
    """
    rows = materialise(jaccard.sketches(docs), "sketches")
    labelled = hot_join(rows.select("doc_id", "row", "node"), membership(docs, rows, similarity), "node")
    copies = materialise(labelled.groupBy("label", "doc_id", "row").agg(F.count("*").alias("n")), "copies")
    leads = materialise(copies.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "row")).alias("_lead"), F.count("*").alias("_m")).where("_m > 1"), "leads")
    first = F.col("_lead").isNull() | (F.col("doc_id").eqNullSafe(F.col("_lead.doc_id")) & (F.col("row") == F.col("_lead.row")))
    marks = hot_join(copies, leads, "label", "left").select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("n").alias("_n"), first.alias("_first"))
    marks = materialise(marks.where("NOT _first OR _n > 1"), "marks")
    own = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*own).alias("_d"), F.xxhash64("doc_id", "text").alias("_own"))
    same = (F.col("_own") == F.col("_row")) & F.col("_d.doc_id").cast("long").eqNullSafe(F.col("_doc"))
    seen = held.join(maybe_broadcast(marks, MARKED), same, "left").where("_first IS NULL OR _first")
    once = seen.where("_n IS NOT NULL").groupBy("_own", "_doc").agg(F.min_by("_d", F.xxhash64("_d")).alias("_d")).select("_d.*")
    return seen.where("_n IS NULL").select("_d.*").unionByName(once)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"), similarity=None)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
