"""Near-duplicates by Jaccard similarity of sets of five words: SimHash and MinHash propose pairs, the whole sets decide.

Vantage-point trees over the sets' 64-bit fingerprints (``simhash.links``) come first: the links that they find within 4 bits are
looked at by whole sets, and what is similar is one component from then on. Fingerprints at the similarity mostly differ in more bits,
so bands go on from there.

A row's sketch has 50 bands of six minima; a pair at similarity 0.8 shares no band with probability 3e-7, more similar
pairs with less. Equal sets are one node. Nodes of equal bands are a bucket. Which pairs of a bucket are compared:

1. Stars. The first node of each bucket (in a random order) with all others, in a few bands first and then in the rest, so that
   a group of near copies becomes one component for a few comparisons a node. A bucket whose nodes are one component is done.
2. Small buckets (``SMALL`` nodes at most): all pairs between components.
3. Large buckets: prefixes, which are exact. The words of the sets of all nodes in such buckets are put in one order, rarest
   first; a pair at the similarity has a word in common within the first fifth of the larger set and the first ninth of
   the smaller one, so only nodes that share such a word between components meet, by a join on the word with the bound that
   their places imply. Texts that share a passage and have more than a ninth of their own meet nowhere, however many they are.
   Of a word's nodes those of its most frequent component don't meet each other.

Pairs from bands have two bits of each of the 300 minima compared in the join (at 0.8 these differ in 45 of them, in more
than ``FAR`` with probability 1e-6, at 0.6 in 90); only what passes, and is within the bound on sizes that the similarity
implies, has its whole sets read. Sets are made for nodes that share a bucket only.

Edge cases: null and empty texts have the empty set, which is one node; texts of fewer than five words are one stretch; very
long texts are read whole; repeated rows and ties are one node or equal nodes; null ids make no difference here; an empty
table has no links; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import encode
from quern.llm.skew import hot_join
from quern.session import materialise, maybe_broadcast, prepare

SIMILARITY, WORDS = 0.8, 5
BANDS, ROWS = 50, 6
#: Bands of the first stars, and nodes of buckets whose pairs are all compared.
QUICK, SMALL = 8, 16
#: Minima that may differ in their two bits.
FAR = 77
_rng = np.random.default_rng(42)
FACTORS = _rng.integers(1, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
BITS = tuple(f"bits{k}" for k in range(-(-2 * BANDS * ROWS // 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def word_sets(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct digests of a whole text's stretches of five words; of fewer words there is one stretch."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    found = own[: len(own) - size + 1]
    for k in range(1, size):
        found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - size + 1 + k])
    return np.unique(mixed(found + np.uint64(size)))


def minima(own: np.ndarray) -> np.ndarray:
    """The least of each of many permutations of a set's digests, by their upper halves."""
    half = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(half), 256):  # digests are mixed already, so that odd factors permute them well enough
        least = np.minimum(least, (half[k : k + 256, None] * FACTORS + SHIFTS).min(0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One code a band: the digest of its minima and its number."""
    least = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(least[k].tobytes(), k) for k in range(BANDS)], np.uint64)


def bits(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 minima to a number."""
    two = np.zeros(32 * len(BITS), np.uint64)
    two[: len(least)] = mixed(least.astype(np.uint64) + np.uint64(1)) >> np.uint64(40) & np.uint64(3)
    return (two.reshape(-1, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)


def unlike(a: Column, b: Column) -> Column:
    """How many of 32 pairs of bits differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, row (digest of id and text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (digest of id and text), node (digest of the set), n (its size), fp (its fingerprint), codes and bits of each row."""
    from quern.llm import simhash

    prepare(docs.sparkSession)
    names = ["doc_id", "row", "node", "n", "fp", "codes", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.forget()
        for batch in encode.slices(batches):
            nodes, sizes, fps, codes, flags = [], [], [], [], []
            for x in batch.column(2):
                own = word_sets(x.as_py())
                least = minima(own)
                nodes.append(int(np.array(xxhash.xxh64_intdigest(own.tobytes()), np.uint64).view(np.int64)))
                sizes.append(len(own))
                fps.append(simhash.signed(simhash.majority(own)))
                codes.append(bands(least).view(np.int64))
                flags.append(bits(least))
            flag = np.array(flags, np.int64).reshape(-1, len(BITS))
            arrays = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(codes, pa.list_(pa.int64())), *(pa.array(flag[:, k]) for k in range(len(BITS)))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts(docs).mapInArrow(run, "doc_id bigint, row bigint, node bigint, n int, fp bigint, codes array<bigint>, " + ", ".join(f"{b} bigint" for b in BITS))


def whole_sets(docs: DataFrame) -> DataFrame:
    """node and words (the set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.forget()
        for batch in encode.slices(batches, 256):
            sets = [word_sets(x.as_py()) for x in batch.column(0)]
            nodes = [int(np.array(xxhash.xxh64_intdigest(own.tobytes()), np.uint64).view(np.int64)) for own in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64()))], names=["node", "words"])

    return docs.select("text").mapInArrow(run, "node bigint, words array<bigint>")


def prefixed(sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, la, na, b, lb, nb) of the pairs of ``nodes`` (node, label) between components that their prefixes leave open."""
    words = sets.join(nodes, "node").select("node", "label", F.size("words").alias("n"), F.explode("words").alias("w"))
    common = words.groupBy("w").agg(F.count("*").alias("f"), F.min("label").alias("_l"), F.max("label").alias("_h")).where("f > 1")
    shared = words.join(common, "w").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("f", "w", (F.col("_l") < F.col("_h")).alias("apart")))).alias("items"))
    # words of one node only come first; those of one component lead to no new link
    place = (F.col("n") - F.col("m") + F.col("k")).alias("p")
    probe = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9)
    index = F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9)
    listed = shared.select("node", "label", "n", F.size("items").alias("m"), F.posexplode("items").alias("k", "i")).select("node", "label", "n", "i.w", "i.apart", place)
    entries = materialise(listed.where("apart").where(F.col("p") <= probe).select("node", "label", "n", "w", "p", (F.col("p") <= index).alias("first")), "prefixes")
    held = entries.groupBy("w", "label").agg(F.count("*").alias("m")).groupBy("w").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("of")).where("of > 1")
    entries = materialise(entries.join(held.select("w", "main"), "w"), "prefixes-apart")
    a = entries.where("label <> main").select("w", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("first").alias("fa"))
    b = entries.select("w", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("first").alias("fb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9
    near = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    met = a.join(b, "w").where((F.col("la") != F.col("lb")) & F.when(smaller, F.col("fa")).otherwise(F.col("fb")) & room & near)
    return met.select("a", "la", "na", "b", "lb", "nb")


def near(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that the vantage-point trees link: at most one a node."""
    from quern.llm import simhash

    leads = materialise(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "fingerprints")
    found = materialise(simhash.links(leads.select("fp")), "fingerprint-links")
    side = lambda fp, to: leads.select(F.col("fp").alias(fp), F.col("lead").alias(to))
    across = hot_join(materialise(hot_join(found, side("a", "x"), "a"), "linked-leads"), side("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # of equal fingerprints the first node stands for the others
    equal = hot_join(nodes, leads, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return materialise(across.unionByName(equal), "fingerprint-pairs")


def labels(docs: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of the nodes of ``rows``, the sketches of ``docs``, that are linked to another one: the smallest node of the component."""
    from quern.llm import simhash

    # equal nodes have equal codes, so any row of a node stands for it
    once = materialise(rows.groupBy("node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "fp", "codes", *BITS))), "nodes-once")
    close = near(once.select("node", "fp"))
    sizes = materialise(once.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("m")).where("m > 1"), "bucket-sizes")
    # most codes stand alone; a node's number of words and bits join the rows of open buckets only
    spread = once.select("node", "row", F.posexplode("codes").alias("band", "code")).join(maybe_broadcast(sizes), "code")
    buckets = materialise(spread.select("code", "band", "node", "row", "m"), "buckets")
    linked_nodes = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    some = materialise(buckets.select("row").union(hot_join(once.select("node", "row"), materialise(linked_nodes, "linked-nodes"), "node").select("row")).distinct(), "bucket-rows")
    sets = materialise(whole_sets(texts(docs).join(maybe_broadcast(some, simhash.MARKED), "row", "left_semi")).groupBy("node").agg(F.first("words").alias("words")), "sets")
    # a node's place is the same in all buckets, so its pairs are the same as well
    sketch = once.select("node", "n", *BITS, F.xxhash64(F.lit(7), F.col("node")).alias("place"))
    side = [F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("place").alias("pa"), *(F.col(b).alias(f"a_{b}") for b in BITS)]
    sized = F.least("n", "na") >= similarity * F.greatest("n", "na") - 1e-9
    apart = sum((unlike(F.col(b), F.col(f"a_{b}")) for b in BITS), F.lit(0))
    #: Of rows of a bucket (node, label, ...) that met another's (a, la, ...): what may be similar and isn't linked yet.
    likely = (F.col("pa") < F.col("place")) & (F.col("label") != F.col("la")) & sized & (apart <= FAR)
    pair = ["a", "la", F.col("node").alias("b"), F.col("label").alias("lb")]

    def similar(pairs: DataFrame) -> DataFrame:
        """(a, b), components whose nodes' whole sets are similar."""
        pairs = materialise(pairs.distinct(), "pairs")
        both = hot_join(pairs, sets.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        found = both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9)
        return materialise(found.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "similar")

    def linked(label: DataFrame | None, found: DataFrame) -> DataFrame | None:
        """``label`` after components have been linked."""
        if not found.limit(1).count():
            return label
        more = simhash.components(found)
        if label is None:
            return more
        moved = hot_join(label, more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        return materialise(moved.unionByName(more.join(label, "node", "left_anti")), "labels")

    def open_buckets(label: DataFrame | None, of: DataFrame) -> DataFrame:
        """The rows of buckets that aren't one component, with labels and sketches."""
        of = of.select("code", "m", "node")
        if label is None:
            now = of.withColumn("label", F.col("node"))
        else:
            marked = materialise(of.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
            several = marked.groupBy("code").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h").select("code")
            now = hot_join(marked, materialise(several, "open-codes"), "code")
        return materialise(now.join(sketch, "node"), "open-buckets")

    label = linked(None, similar(close.select("a", F.col("a").alias("la"), "b", F.col("b").alias("lb"))))
    for of in (buckets.where(F.col("band") < QUICK), buckets):
        now = open_buckets(label, of)
        first = materialise(now.groupBy("code").agg(F.min_by(F.struct(*side), "place").alias("s")).select("code", "s.*"), "first-of-bucket")
        label = linked(label, similar(hot_join(now, first, "code").where(likely).select(*pair)))
    now = open_buckets(label, buckets)
    few = now.where(F.col("m") <= SMALL)
    pairs = few.join(few.select("code", *side), "code").where(likely).select(*pair)
    large = materialise(now.where(F.col("m") > SMALL).select("node", "label").distinct(), "large-buckets")
    if large.limit(1).count():
        pairs = pairs.unionByName(prefixed(sets, large, similarity).select("a", "la", "b", "lb"))
    label = linked(label, similar(pairs))
    return label if label is not None else simhash.components(materialise(buckets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "links"))
