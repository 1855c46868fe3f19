"""Memory maintenance: scored recall, decay, dedup, conflicts, clusters, pruning. No row is changed: each step derives rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vector as V
from quern.session import materialise, maybe_broadcast
from quern.sources.adapters import now


def days_since(column: Column, as_of: str) -> Column:
    return F.when(column.isNotNull(), F.greatest(F.timestamp_diff("SECOND", column, now(as_of)) / 86400.0, F.lit(0.0)))


def decay(accessed: Column, created: Column, as_of: str, rate: float = 0.01) -> Column:
    """exp(-rate * days) since the last access, or the creation; 0.5 where neither is known."""
    return F.coalesce(F.exp(-rate * days_since(F.coalesce(accessed, created), as_of)), F.lit(0.5))


def recency(created: Column, as_of: str) -> Column:
    """Linear over a year, in whole days; 0.5 where it is unknown."""
    return F.coalesce(F.when(created.isNotNull(), F.greatest(F.lit(0.0), 1 - F.floor(days_since(created, as_of)) / 365.0)), F.lit(0.5))


def recall(memories: DataFrame, queries: DataFrame, as_of: str, k: int = 5, candidates: int = 50, decayed: bool = True) -> DataFrame:
    """The k best memories for each query (query_id, user_id, text) among the user's active candidates.

    Where both sides have an ``embedding``, the relevance is 0.7 of their cosine and 0.3 of the words' share, else that share.
    """
    vectors = "embedding" in memories.columns and "embedding" in queries.columns
    first = Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("created_at"), "id")
    some = memories.where("archived_at IS NULL").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= candidates)
    asked = queries.select("query_id", "user_id", F.array_distinct(T.words(F.col("text"))).alias("q"), *([F.col("embedding").alias("q_vector")] if vectors else []))
    joined = some.join(maybe_broadcast(asked), "user_id")
    kw = T.overlap(F.col("q"), T.words(F.col("content")))
    if vectors:
        kw = F.when(F.col("embedding").isNotNull() & F.col("q_vector").isNotNull(), 0.7 * V.cosine(F.col("embedding"), F.col("q_vector")) + 0.3 * kw).otherwise(kw)
    age = decay(F.col("accessed_at"), F.col("created_at"), as_of)
    score = 0.5 * kw + 0.25 * F.col("importance") + 0.25 * age if decayed else 0.6 * kw + 0.3 * F.col("importance") + 0.1 * recency(F.col("created_at"), as_of)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    scored = joined.select("query_id", "user_id", "id", F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)


def remember(memories: DataFrame, per_user: bool = True) -> DataFrame:
    """One row a distinct content: the first row's id, importance raised by 0.1 a repetition up to 1."""
    keys = (["user_id"] if per_user else []) + ["hash"]
    hashed = memories.withColumn("hash", T.content_hash(F.col("content")))
    n = F.count("*")
    return hashed.groupBy(*keys).agg(F.min("id").alias("id"), F.round(F.least(F.min_by("importance", "id") + 0.1 * (n - 1), F.lit(1.0)), 6).alias("importance"), n.alias("n"))


def conflicts(new: DataFrame, memories: DataFrame, threshold: float, last: int = 100) -> DataFrame:
    """(new_id, id, similarity, kind): new facts against the last active rows of their user, similar and contradictory.

    Similarity is the cosine where both have an ``embedding``, else that of the word sets. A pair needs the sets' sizes, what
    they have in common and which side denies, so sets go along as digests of their words.
    """
    vectors = "embedding" in memories.columns and "embedding" in new.columns
    recent = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    some = memories.where("archived_at IS NULL").withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= last)
    own = F.array_distinct(T.words(F.col("content")))

    def side(rows: DataFrame, key: str, name: str) -> DataFrame:
        held = rows.select("user_id", F.col("id").alias(key), own.alias("_w"), *([F.col("embedding").alias(f"{name}_vector")] if vectors else []))
        return held.select("user_id", key, F.transform("_w", lambda w: F.xxhash64(w)).alias(name), T.denies(F.col("_w")).alias(f"{name}_denies"), *([f"{name}_vector"] if vectors else []))

    recalled = materialise(side(some, "id", "old"), "recent-memories")
    pairs = materialise(side(new, "new_id", "new"), "new-memories").join(recalled, "user_id").where("new_id <> id").withColumn("both", F.size(F.array_intersect("new", "old")))
    a, b, both = F.size("new"), F.size("old"), F.col("both")
    share = F.coalesce(F.try_divide(both.cast("double"), a + b - both), F.lit(0.0))
    similarity = F.when(F.col("new_vector").isNotNull() & F.col("old_vector").isNotNull(), V.cosine(F.col("new_vector"), F.col("old_vector"))).otherwise(share) if vectors else share
    kind = F.when(F.col("new_denies") != F.col("old_denies"), "negation").when((both >= 2) & (a > both) & (b > both) & (share >= 0.4), "replacement")
    return pairs.select("new_id", "id", F.round(similarity, 6).alias("similarity"), kind.alias("kind")).where((F.col("similarity") >= threshold) & F.col("kind").isNotNull())


def resolve(pairs: DataFrame) -> DataFrame:
    """Rows after a conflict: (id, content, importance, archived) for actions replace, archive_old, merge and keep_both.

    ``pairs``: old_id, old_content, old_importance, new_id, new_content, new_importance, action.
    """
    act = F.col("action")
    merged = F.concat(F.col("old_content"), F.lit(" [updated: "), F.col("new_content"), F.lit("]"))
    old = F.struct(
        F.col("old_id").alias("id"), F.when(act == "replace", F.col("new_content")).when(act == "merge", merged).otherwise(F.col("old_content")).alias("content"),
        F.when(act == "merge", F.least(F.col("old_importance") + 0.1, F.lit(1.0))).otherwise(F.col("old_importance")).alias("importance"), (act == "archive_old").alias("archived"),
    )
    new = F.struct(F.col("new_id").alias("id"), F.col("new_content").alias("content"), F.col("new_importance").alias("importance"), F.lit(False).alias("archived"))
    rows = F.when(act.isin("archive_old", "keep_both"), F.array(old, new)).otherwise(F.array(old))
    return pairs.select(F.explode(rows).alias("r")).select("r.*")


def prune(memories: DataFrame, as_of: str, days: int = 90, importance: float = 0.3) -> DataFrame:
    """What stays: rows not both unimportant and long unread."""
    stale = F.coalesce(F.col("accessed_at"), F.col("created_at")) < now(as_of) - F.make_dt_interval(days=F.lit(days))
    return memories.where(~(stale & (F.col("importance") < importance)))


def fade(memories: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Importance 0.05 less, 0.05 at least, where a row above 0.1 wasn't read for some days."""
    stale = F.coalesce(F.col("accessed_at"), F.col("created_at")) < now(as_of) - F.make_dt_interval(days=F.lit(days))
    return memories.withColumn("importance", F.when(stale & (F.col("importance") > 0.1), F.greatest(F.round(F.col("importance") - 0.05, 6), F.lit(0.05))).otherwise(F.col("importance")))


def leaders(pairs: DataFrame) -> DataFrame:
    """Greedy leader clusters from similar pairs (a, b), a < b: (id, leader) of all rows in some pair.

    In id order a row leads unless an earlier leader absorbed it. A row is settled as soon as its first leader is known,
    which no smaller open neighbour can come before, so a group of copies takes two rounds; a row without a leader waits
    for its smaller neighbours. Rounds go on until no row is open.
    """
    pairs = materialise(pairs.select("a", "b"), "leader-pairs")
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "leader-ids")
    state = materialise(ids.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("leader")), "leaders")
    total, settled = ids.count(), state.count()
    while settled < total:
        open_ = ids.join(state, "id", "left_anti")
        smaller = open_.join(pairs.withColumnRenamed("b", "id"), "id").join(state.select(F.col("id").alias("a"), F.col("leader")), "a", "left")
        ready = smaller.groupBy("id").agg(F.min(F.when(F.col("leader").isNull(), F.col("a"))).alias("waiting"), F.min(F.when(F.col("leader") == F.col("a"), F.col("a"))).alias("lead"))
        done = ready.where("waiting IS NULL OR lead < waiting").select("id", F.coalesce("lead", "id").alias("leader"))
        state = materialise(state.union(done), "leaders")
        before, settled = settled, state.count()
        if settled == before:
            raise RuntimeError("leader clusters did not settle")
    return state


def merge_clusters(memories: DataFrame, clusters: DataFrame) -> DataFrame:
    """(leader, importance, size) of each cluster of two rows or more: the largest importance plus 0.1, 1 at most."""
    joined = memories.select("id", "importance").join(clusters, "id")
    return joined.groupBy("leader").agg(F.round(F.least(F.max("importance") + 0.1, F.lit(1.0)), 6).alias("importance"), F.count("*").alias("size")).where("size > 1")


def scoped_state(writes: DataFrame) -> DataFrame:
    """Latest value by scope: keys "user:..." a user, "app:..." for all, others a session (left out: not kept)."""
    scope = F.when(F.col("key").startswith("user:"), "user").when(F.col("key").startswith("app:"), "app").otherwise("session")
    kept = writes.withColumn("scope", scope).where("scope <> 'session'").withColumn("owner", F.when(F.col("scope") == "user", F.col("user_id")))
    return kept.groupBy("scope", "owner", "key").agg(F.max_by("value", F.struct("updated_at", "seq")).alias("value"))


def summary(chat: DataFrame, size: int = 500) -> DataFrame:
    """The last characters of each user's messages in order. Only a tail of rows can matter, so only that is collected.

    A message with ``size`` characters behind it counts by the blank that parts it from them. Null contents are left out; a user
    without any other has a null.
    """
    back = Window.partitionBy("user_id").orderBy(F.desc("id"))
    behind = F.sum(F.coalesce(F.length("content") + 1, F.lit(0))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    tail = chat.select("user_id", "id", "content", F.coalesce(behind, F.lit(0)).alias("after")).where(F.col("after") <= size)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("id", "content")))), lambda x: x["content"])
    return tail.groupBy("user_id").agg(parts.alias("parts")).select("user_id", F.when(F.size("parts") > 0, F.right(F.array_join("parts", " "), F.lit(size))).alias("summary"))


def last_n(chat: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each user, oldest first within the user."""
    back = Window.partitionBy("user_id").orderBy(F.desc("id"))
    return chat.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n").orderBy("user_id", "id")


#: How a summary is handed over, and what the assistant answers for short and for cut histories.
HANDOVER, SHORT_REPLY, CUT_REPLY = "[Previous context]: ", "Understood, I'll keep that context in mind.", "Understood."


def compressed(chat: DataFrame, summaries: DataFrame, n: int = 6) -> DataFrame:
    """Two rows that hand over the summary, then the last n messages; users without a summary have the messages only."""
    sizes = chat.groupBy("user_id").agg(F.count("*").alias("_n"))
    reply = F.when(F.coalesce("_n", F.lit(0)) <= n, SHORT_REPLY).otherwise(CUT_REPLY)
    rows = F.array(
        F.struct(F.lit(-2).cast("long").alias("id"), F.lit("user").alias("role"), F.concat(F.lit(HANDOVER), F.col("summary")).alias("content")),
        F.struct(F.lit(-1).cast("long").alias("id"), F.lit("assistant").alias("role"), reply.alias("content")),
    )
    head = summaries.where("summary <> ''").join(sizes, "user_id", "left").select("user_id", F.explode(rows).alias("r")).select("user_id", "r.*")
    return head.unionByName(last_n(chat, n).select("user_id", F.col("id").cast("long").alias("id"), "role", "content"))


def flatten_blocks(content: Column) -> Column:
    """Texts of a JSON array of blocks, joined by blanks (a block without a text is empty); other contents as they are."""
    blocks = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    return F.when(content.startswith("[") & blocks.isNotNull(), joined).otherwise(content)
