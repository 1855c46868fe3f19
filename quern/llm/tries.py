"""Prefix trie of conversations as a burst trie: suffix containers under trie heads, burst by the next turn, sorted and swept.

A conversation is a string of turn ids (``ID`` hexadecimal digits of SHA-256 over role and text). Conversations longer than
``BLOCK`` turns are cut into blocks of one length, at most ``BLOCKS`` a conversation; a block hangs under a head that stands for
all turns before it. Equal blocks under one head are one row with a count and the smallest conversation, so copies never meet.
Each head starts as one container of suffixes. A container of more than ``CONTAINER`` rows is burst: what all its rows have
in common becomes a chain of trie heads, and the rows go on to new containers by the next turn id after it, until no container
is too large. Containers then are single groups of a shuffle: sorted, and swept into nodes with a stack of the open ones.
Counts of leaves and saved tokens come from the containers up through the heads, block by block from the last one.

Conversations are put in order by range partitions of (conv_id, turn, turn id) and counted by partition, so a hot conversation is
spread over tasks; the ids of conversations that end in one node are joined to strings by range partitions too before one
task hashes them in order, which SHA-256 needs.

Edge cases: rows without a conv_id belong to no conversation and are left out; a null turn comes first; null roles and texts are
empty ones; rows of equal turn are in the order of their turn ids, repeated rows are turns of their own; a negative
conv_id belongs to the multiple of 20 below it; an empty table gives no node; other columns are ignored. Texts of any length
are one task's only while they are hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.skew import hot_join
from quern.session import materialise, maybe_broadcast, prepare, table

ID, BLOCK, BLOCKS, CONTAINER = 32, 256, 32, 1024
#: Characters of joined ids in one row.
JOINED = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
FAMILY, HEADS = 20, 4
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ended string, over string"


def short(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, ID)


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn), id and words of each turn, as a written table."""
    prepare(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, ID).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for c in batch.column(0).to_pylist():
                now, n = (c, 0) if c != now else (now, n + 1)
                at.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), batch.column(1), batch.column(2)], names=["conv_id", "part", "at", "id", "words"])

    parts, key = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["conv_id", "turn", "id", "salt"]
    dealt = turns.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("conv_id", "id", "words")
    held = materialise(dealt.mapInArrow(run, "conv_id bigint, part int, at bigint, id string, words bigint"), "turns")
    sizes = held.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation that goes on in a partition is its first one, so there are no more rows than partitions
    later = sizes.withColumn("first", F.sum("n").over(before)).where("first > 0").select("conv_id", "part", "first")
    placed = held.join(maybe_broadcast(materialise(later, "turns-later")), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("first", F.lit(0))).alias("pos"), "id", "words")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordered turns as they are, and (conv_id, total)."""
    return turns, turns.groupBy("conv_id").agg(F.count("*").alias("total"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and totals with the first h turns of each conversation from its family's first one; h is crc32(conv_id) % 4."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("base")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), base)
    heads = turns.where((F.col("pos") < HEADS - 1) & (F.pmod("conv_id", F.lit(FAMILY)) == 0)).select(F.col("conv_id").alias("base"), "pos", "id", "words")
    had = heads.groupBy("base").agg(F.count("*").alias("had"))
    convs = convs.join(had, "base", "left").withColumn("given", F.least("h", F.coalesce("had", F.lit(0))))
    convs = materialise(convs.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "families")
    first = convs.where("given > 0").join(heads, "base").where(F.col("pos") < F.col("given")).select("conv_id", "pos", "id", "words")
    lack = materialise(convs.where("given < h").select("conv_id", (F.col("h") - F.col("given")).alias("lack")), "families-lacking")
    rest = hot_join(turns.where(F.col("pos") >= h), lack, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("pos"), "id", "words")
    return first.unionByName(rest), convs.select("conv_id", "total")


def blocks(turns: DataFrame, size: int) -> DataFrame:
    """conv_id, k, head, tail, path, words, row and last of each block of ``size`` turns of each conversation."""
    items = F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("items")
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / size).alias("k")).agg(items)
    cut = cut.select("conv_id", "k", F.array_join("items.id", "").alias("path"), F.col("items.words").alias("words"))
    # a head stands for the blocks before: two sums modulo 2 of hashes of their place and content
    own = Window.partitionBy("conv_id")
    upto = own.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    mark = [F.xxhash64(F.lit(s), "k", "path") for s in (1, 2)]
    through = [F.bit_xor(m).over(upto) for m in mark]
    name = lambda k, hashes: F.concat_ws("-", k, *(F.hex(x) for x in hashes))
    cut = cut.select("*", *(x.alias(f"x{k}") for k, x in enumerate(through)), *(m.alias(f"m{k}") for k, m in enumerate(mark)), (F.col("k") == F.max("k").over(own)).alias("last"))
    head, tail = name(F.col("k"), [F.col(f"x{k}").bitwiseXOR(F.col(f"m{k}")) for k in range(2)]), name(F.col("k") + 1, [F.col("x0"), F.col("x1")])
    cut = cut.select("conv_id", "k", head.alias("head"), tail.alias("tail"), "path", "words", "last")
    return cut.withColumn("row", short(F.col("head"), F.col("path")))


def common(a: Column, b: Column) -> Column:
    """Turn ids that two paths have in common from the start on."""
    n = F.least(F.length(a), F.length(b)) / ID
    ids = F.sequence(F.lit(0), n.cast("int"))  # one place more than there are ids
    differ = F.transform(ids, lambda k: (k == n) | (F.substr(a, k * ID + 1, F.lit(ID)) != F.substr(b, k * ID + 1, F.lit(ID))))
    return (F.array_position(differ, True) - 1).cast("int")


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a partition sorted by (key, path)."""

    def nodes(rows: list[dict]) -> pa.RecordBatch:
        first = rows[0]
        off, base, over, up = first["off"], first["base"], first["over"], first["up"]
        made: list[list] = []  # low, depth, parent's number, n, children, leaves, saved, ended
        open_: list[tuple[int, int]] = []  # (number, words of the last turn) of the nodes on the way to the row before

        def close(depth: int) -> None:
            while len(open_) > depth:
                x, words = open_.pop()
                own = made[x]
                own[5] = own[5] or 1
                own[6] += (own[3] - 1) * words
                if own[2] >= 0:
                    top = made[own[2]]
                    top[0] = min(top[0], own[0])
                    top[3] += own[3]
                    top[4] += 1
                    top[5] += own[5]
                    top[6] += own[6]

        before: list[str] = []
        for r in rows:
            ids = [r["path"][k : k + ID] for k in range(off * ID, len(r["path"]), ID)]
            same = 0
            while same < min(len(ids), len(before)) and ids[same] == before[same]:
                same += 1
            close(same)
            for k in range(same, len(ids)):
                made.append([r["low"], off + k + 1, open_[-1][0] if open_ else -1, 0, 0, 0, 0, None])
                open_.append((len(made) - 1, r["words"][off + k]))
            end = made[open_[-1][0]]
            end[0], end[3] = min(end[0], r["low"]), end[3] + r["n"]
            end[4], end[5], end[6] = r["children"], r["leaves"], r["saved"]
            end[7] = r["row"] if r["ends"] else None
            before = ids
        close(0)
        out = list(zip(*((n[0], base + n[1], made[n[2]][0] if n[2] >= 0 else up, *n[3:8], None if n[2] >= 0 else over) for n in made), strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), *(pa.array(c, pa.string()) for c in out[7:])], names=[x.split()[0] for x in NODES.split(", ")])

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["key"] != r["key"]:
                yield nodes(held)
                held = []
            held.append(r)
    if held:
        yield nodes(held)


def chains(burst: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of trie heads: ``burst`` containers with what ``below`` (over, children, leaves, saved) says of their ends."""
    joined = burst.join(below.withColumnRenamed("over", "key"), "key")
    left = F.aggregate(F.slice("words", F.col("k") + 1, F.size("words")), F.lit(0).cast("long"), lambda a, x: a + x)
    last = F.col("k") == F.size("words") - 1
    return joined.select("*", F.posexplode("words").alias("k", "_w")).select(
        F.col("low").alias("conv_id"), (F.col("base") + F.col("off") + F.col("k") + 1).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("up")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * left).alias("saved_tokens"), F.when(last, F.col("ended")).alias("ended"), F.when(F.col("k") == 0, F.col("over")).alias("over"),
    )


def sums(nodes: DataFrame) -> DataFrame:
    """(over, children, leaves, saved) of what reports to a container or head."""
    return nodes.where("over IS NOT NULL").groupBy("over").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def block_nodes(rows: DataFrame, container: int) -> DataFrame:
    """The nodes of one block's rows: key, off, base, over, up, row, path, words, n, low, ends, children, leaves, saved."""
    settled, bursts, pending = [], [], rows
    while True:
        loads = pending.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("path", "row", "words")).alias("a"), F.max("path").alias("b"), F.sum("n").alias("n"), F.min("low").alias("low"), *(F.first(c).alias(c) for c in ("off", "base", "over", "up")))
        big = loads.where(F.col("m") > container).withColumn("to", common(F.col("a.path"), F.col("b")))
        big = big.select("key", "off", "base", "over", "up", "n", "low", "to", F.slice("a.words", F.col("off") + 1, F.col("to") - F.col("off")).alias("words"), F.when(F.length("a.path") == F.col("to") * ID, F.col("a.row")).alias("ended"))
        big = materialise(big, "trie-burst")
        if not big.limit(1).count():
            settled.append(pending)
            break
        bursts.append(big.where(F.col("to") > F.col("off")))
        # without a chain, what is below reports to what the container reports to
        chained = F.col("to") > F.col("off")
        moves = maybe_broadcast(big.select("key", "to", F.when(chained, F.col("low")).otherwise(F.col("up")).alias("_up"), F.when(chained, F.col("key")).otherwise(F.col("over")).alias("_over")))
        marked = pending.join(moves, "key", "left")
        settled.append(marked.where("to IS NULL").select(*pending.columns))
        moved = marked.where((F.col("to") * ID < F.length("path"))).withColumns({
            "key": short(F.col("key"), F.substr("path", F.col("off") * ID + 1, (F.col("to") - F.col("off") + 1) * ID)), "off": F.col("to"), "up": F.col("_up"), "over": F.col("_over"),
        })
        pending = materialise(moved.select(*pending.columns), "trie-pending")
    rows = settled[0]
    for s in settled[1:]:
        rows = rows.unionByName(s)
    nodes = materialise(rows.repartition("key").sortWithinPartitions("key", "path").mapInArrow(swept, NODES), "trie-nodes")
    for big in reversed(bursts):
        nodes = nodes.unionByName(materialise(chains(big, sums(nodes)), "trie-chains"))
    return nodes


def joined_ids(ends: DataFrame) -> DataFrame:
    """(row, digest): SHA-256 of the ascending conversation ids of each row, joined by commas."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held, size, number = TaskContext.get().partitionId(), None, [], 0, 0

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["row", "part", "number", "ids"])

        for batch in batches:
            rows = []
            for row, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row != now or size > JOINED:
                    if held:
                        rows.append((now, part, number, ",".join(held)))
                        number += 1
                    now, held, size = row, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if rows:
                yield out(rows)
        if held:
            yield out([(now, part, number, ",".join(held))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for batch in batches:
            rows = []
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row != now:
                    if state:
                        rows.append((now, state.hexdigest()))
                    now, state = row, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["row", "digest"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["row", "digest"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select("row", "conv_id").repartitionByRange(parts, "row", "conv_id").sortWithinPartitions("row", "conv_id")
    pieces = materialise(dealt.mapInArrow(strings, "row string, part int, number bigint, ids string"), "trie-ends")
    return pieces.repartition("row").sortWithinPartitions("row", "part", "number").select("row", "ids").mapInArrow(digests, "row string, digest string")


def trie(conversations: DataFrame, rebuild=plain, block: int = BLOCK, container: int = CONTAINER) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, totals = rebuild(ordered(conversations))
    # numbers of the whole corpus: one row
    n, low, longest, empty = totals.agg(F.count("*"), F.min("conv_id"), F.max("total"), F.count_if(F.col("total") == 0)).first()
    size = max(block, -(-(longest or 0) // BLOCKS))
    deep = -(-(longest or 0) // size)
    cut = materialise(blocks(turns, size), "trie-blocks")
    distinct = cut.groupBy("row").agg(*(F.first(c).alias(c) for c in ("k", "head", "tail", "path", "words")), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.count_if("last").alias("ends"))
    distinct = materialise(distinct, "trie-rows")
    nodes, below = None, None
    for k in range(deep - 1, -1, -1):
        rows = distinct.where(F.col("k") == k)
        if k:
            up = distinct.where((F.col("k") == k - 1) & (F.col("n") > F.col("ends"))).select(F.col("tail").alias("head"), F.col("low").alias("up"))
            rows = rows.join(up, "head")
        else:
            rows = rows.withColumn("up", F.lit(low).cast("long"))
        none = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
        if below is None:
            rows = rows.withColumns(none)
        else:
            rows = rows.join(below.withColumnRenamed("over", "tail"), "tail", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
        rows = rows.select(F.col("head").alias("key"), F.lit(0).alias("off"), F.lit(k * size).cast("long").alias("base"), F.col("head").alias("over"), "up", "row", "path", "words", "n", "low", "ends", "children", "leaves", "saved")
        found = block_nodes(materialise(rows, "trie-block"), container)
        below = sums(found.where("depth = %d" % (k * size + 1)))
        nodes = found if nodes is None else nodes.unionByName(found)
    ends = cut.where("last").select("row", "conv_id")
    if empty:
        ends = ends.unionByName(totals.where("total = 0").select(F.lit("root").alias("row"), "conv_id"))
    if n:
        top = sums(nodes.where("depth = 1")).agg(F.sum("children").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s")) if nodes is not None else totals.select(F.lit(None).alias("c"), F.lit(None).alias("l"), F.lit(None).alias("s")).limit(1)
        root = top.select(
            F.lit(low).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"),
            F.coalesce("c", F.lit(0)).cast("long").alias("n_children"), F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("s", F.lit(0)).cast("long").alias("saved_tokens"),
            F.lit("root" if empty else None).cast("string").alias("ended"), F.lit(None).cast("string").alias("over"),
        )
        nodes = root if nodes is None else nodes.unionByName(root)
    else:
        nodes = conversations.sparkSession.createDataFrame([], NODES)
    digests = joined_ids(ends).withColumnRenamed("row", "ended")
    return nodes.join(digests, "ended", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"), rebuilt)


#: All prefixes of all rebuilt conversations, grouped; crc32 bit by bit.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS pos,
    substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base,
  xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.pos, t.id, t.words FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, t.pos, t.id, t.words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (SELECT c.conv_id, coalesce(list(r.id ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS ids, coalesce(list(r.words ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS words FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d, ids[1:d] AS path, words[d] AS words, len(ids) = d AS ended FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM s)),
n AS (SELECT path, d, min(conv_id) AS low, count(*) AS n, any_value(coalesce(words, 0)) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS children FROM n WHERE d > 0 GROUP BY path[1:d - 1]),
w AS (SELECT n.*, coalesce(k.children, 0) AS children FROM n LEFT JOIN k ON k.path = n.path),
b AS (SELECT path[1:a] AS path, sum((children = 0)::INT) AS leaves, sum(CASE WHEN d > 0 THEN (n - 1) * words ELSE 0 END) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM w) GROUP BY path[1:a])
SELECT w.low AS conv_id, w.d AS depth, u.low AS parent_conv_id, w.n AS n_convs, w.children AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN b ON b.path = w.path LEFT JOIN n u ON w.d > 0 AND u.path = w.path[1:w.d - 1]
"""
