"""Queries: memory algebra and chat history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import memory as M
from quern.operators import similarity as W
from quern.plans.registry import query
from quern.session import table
from quern.sources import adapters as S
from quern.sources.adapters import AS_OF, CHAT_SQL, INTERACTIONS_SQL, MEMORIES_SQL

NOW = f"TIMESTAMP '{AS_OF}'"
DAYS = f"greatest(date_diff('second', {{}}, {NOW}) / 86400.0::DOUBLE, 0)"
WORDS = r"list_distinct(regexp_extract_all(lower({}), '\S+'))"
STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def user_queries(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("user_id"), "text")
    return with_vectors(spark, d, b, "query_id")


def with_vectors(spark, d, rows, key="id"):
    """Rows with the vector of their id, if there is one."""
    return rows.join(table(spark, d, "embeddings").select(F.col("vec_id").alias(key), "embedding"), key, "left")


@query("m01_recall", f"""WITH {MEMORIES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, created_at DESC, id) AS n FROM memories WHERE archived_at IS NULL),
 q AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS user_id, {WORDS.format('text')} AS q, embedding AS v FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
 k AS (SELECT query_id, c.user_id, id, importance, accessed_at, created_at, len(list_intersect(q, {WORDS.format('content')})) / CAST(greatest(len(q), 1) AS DOUBLE) AS kw, v, embedding AS w FROM c JOIN q USING (user_id) LEFT JOIN embeddings ON vec_id = id WHERE n <= 50),
 s AS (SELECT query_id, user_id, id, round(0.5::DOUBLE * CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN 0.7::DOUBLE * list_cosine_similarity(v::DOUBLE[], w::DOUBLE[]) + 0.3::DOUBLE * kw ELSE kw END + 0.25::DOUBLE * importance + 0.25::DOUBLE * exp(-0.01::DOUBLE * {DAYS.format('coalesce(accessed_at, created_at)')}), 6) AS score FROM k)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 5""")
def m01(spark, d):
    return M.recall(with_vectors(spark, d, S.memories(spark, d)), user_queries(spark, d), AS_OF)


@query("m02_decay", f"""WITH {MEMORIES_SQL} SELECT id, round(exp(-0.01::DOUBLE * {DAYS.format('coalesce(accessed_at, created_at)')}), 6) AS decay, round(greatest(0, 1 - floor({DAYS.format('created_at')}) / 365.0::DOUBLE), 6) AS recency FROM memories""")
def m02(spark, d):
    return S.memories(spark, d).select("id", F.round(M.decay(F.col("accessed_at"), F.col("created_at"), AS_OF), 6).alias("decay"), F.round(M.recency(F.col("created_at"), AS_OF), 6).alias("recency"))


@query("m04_dedup_upsert", f"""WITH {MEMORIES_SQL} SELECT user_id, md5(lower({STRIP.format('content')})) AS hash, min(id) AS id, round(least(arg_min(importance, id) + 0.1::DOUBLE * (count(*) - 1), 1), 6) AS importance, count(*) AS n FROM memories GROUP BY 1, 2""")
def m04(spark, d):
    return M.remember(S.memories(spark, d))


NEG = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.NEGATIONS) + "]"
KIND = f"""CASE WHEN (len(list_intersect(x, {NEG})) > 0) <> (len(list_intersect(y, {NEG})) > 0) THEN 'negation'
  WHEN len(list_intersect(x, y)) >= 2 AND len(list_filter(x, lambda v: NOT list_contains(y, v))) > 0 AND len(list_filter(y, lambda v: NOT list_contains(x, v))) > 0
  AND len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) >= 0.4 THEN 'replacement' END"""


@query("m05_conflicts", f"""WITH {MEMORIES_SQL}, r AS (SELECT user_id, id, {WORDS.format('content')} AS y, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM memories WHERE archived_at IS NULL),
 f AS (SELECT user_id, id AS new_id, {WORDS.format('content')} AS x FROM memories WHERE id % 50 = 0),
 p AS (SELECT new_id, id, round(CASE WHEN a.embedding IS NOT NULL AND b.embedding IS NOT NULL THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END, 6) AS similarity, {KIND} AS kind
  FROM f JOIN r USING (user_id) LEFT JOIN embeddings a ON a.vec_id = new_id LEFT JOIN embeddings b ON b.vec_id = r.id WHERE n <= 100 AND new_id <> id)
 SELECT * FROM p WHERE similarity >= 0.2 AND kind IS NOT NULL""")
def m05(spark, d):
    memories = with_vectors(spark, d, S.memories(spark, d))
    return M.conflicts(memories.where("id % 50 = 0"), memories, 0.2)  # the stated set of queries


@query("m06_contradiction", f"""WITH p AS (SELECT a.conv_id, a.turn, {WORDS.format('a.text')} AS x, {WORDS.format('b.text')} AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2)
 SELECT conv_id, turn, {KIND} AS kind FROM p""")
def m06(spark, d):
    c = table(spark, d, "conversations")
    w = lambda name: F.array_distinct(T.words(F.col("text"))).alias(name)
    later = c.select("conv_id", (F.col("turn") - 2).alias("turn"), w("y"))
    return c.select("conv_id", "turn", w("x")).join(later, ["conv_id", "turn"]).select("conv_id", "turn", T.contradiction(F.col("x"), F.col("y")).alias("kind"))


ACTION = "['replace', 'archive_old', 'merge', 'keep_both'][CAST(a.id % 4 AS INT) + 1]"


@query("m07_resolution", f"""WITH {MEMORIES_SQL}, p AS (SELECT a.id AS oi, a.content AS oc, a.importance AS om, b.id AS ni, b.content AS nc, b.importance AS nm, {ACTION} AS act FROM memories a JOIN memories b ON b.id = a.id + 1)
 SELECT oi AS id, CASE act WHEN 'replace' THEN nc WHEN 'merge' THEN oc || ' [updated: ' || nc || ']' ELSE oc END AS content, round(CASE act WHEN 'merge' THEN least(om + 0.1::DOUBLE, 1) ELSE om END, 6) AS importance, act = 'archive_old' AS archived FROM p
 UNION ALL SELECT ni, nc, round(nm, 6), false FROM p WHERE act IN ('archive_old', 'keep_both')""")
def m07(spark, d):
    m = S.memories(spark, d).select("id", "content", "importance")
    old = m.select(F.col("id").alias("old_id"), F.col("content").alias("old_content"), F.col("importance").alias("old_importance"), (F.col("id") + 1).alias("new_id"))
    new = m.select(F.col("id").alias("new_id"), F.col("content").alias("new_content"), F.col("importance").alias("new_importance"))
    act = F.element_at(F.array(*map(F.lit, ("replace", "archive_old", "merge", "keep_both"))), (F.col("old_id") % 4 + 1).cast("int"))
    return M.resolve(old.join(new, "new_id").withColumn("action", act)).withColumn("importance", F.round("importance", 6))


@query("m08_archived", f"WITH {MEMORIES_SQL} SELECT id, user_id, archived_at FROM memories WHERE archived_at IS NOT NULL ORDER BY archived_at DESC, id LIMIT 50")
def m08(spark, d):
    return S.memories(spark, d).where("archived_at IS NOT NULL").select("id", "user_id", "archived_at").orderBy(F.desc("archived_at"), "id").limit(50)


@query("m09_forget", "SELECT doc_id AS id FROM documents WHERE NOT contains(text, 'token')")
def m09(spark, d):
    return S.memories(spark, d).where(~F.col("content").contains("token")).select("id")


@query("m10_prune", f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE NOT (coalesce(accessed_at, created_at) < {NOW} - INTERVAL 30 DAY AND importance < 0.3)")
def m10(spark, d):
    return M.prune(S.memories(spark, d), AS_OF, days=30).select("id")


@query("m11_importance_decay", f"""WITH {MEMORIES_SQL} SELECT id, round(CASE WHEN coalesce(accessed_at, created_at) < {NOW} - INTERVAL 7 DAY AND importance > 0.1 THEN greatest(importance - 0.05::DOUBLE, 0.05) ELSE importance END, 6) AS importance FROM memories""")
def m11(spark, d):
    return M.fade(S.memories(spark, d), AS_OF).select("id", F.round("importance", 6).alias("importance"))


PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


def pairs(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").where("label IS NOT NULL")
    return W.close_pairs(v, 0.3)


SETS = r"""w AS (SELECT conv_id * 1000 + turn AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '\S+'))) AS w FROM conversations WHERE role = 'user'),
 c AS (SELECT w, min(id) AS class FROM w GROUP BY w), n AS (SELECT a.class AS a, b.class AS b, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS n FROM c a JOIN c b ON a.class < b.class AND len(a.w) > 0 AND len(b.w) > 0)"""


@query("j08_set_join", f"WITH {SETS} SELECT 'pair' AS kind, a, b, round(k / CAST(n - k AS DOUBLE), 6) AS similarity FROM n WHERE k / CAST(n - k AS DOUBLE) >= 0.2 UNION ALL SELECT 'copy', class, id, 1.0 FROM w JOIN c USING (w) WHERE id <> class")
def j08(spark, d):
    """All user turns against all others by their words, with copies as members of classes."""
    rows = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    pairs, classes = W.similar_sets(rows, T.words(F.col("text")), 0.2)
    copies = classes.where("id <> class").select(F.lit("copy").alias("kind"), F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.select(F.lit("pair").alias("kind"), "a", "b", "similarity").unionByName(copies)


@query("m12_similar_pairs", f"SELECT * FROM ({PAIRS}) WHERE cosine >= 0.3")
def m12(spark, d):
    return pairs(spark, d)


#: Rows in id order, each led by the first leader that it is similar to; a fold over the list of leaders so far.
LEADERS = f"""pr AS MATERIALIZED (SELECT a, b FROM ({PAIRS}) WHERE cosine >= 0.3), ids AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM pr UNION SELECT b FROM pr)),
 nb AS MATERIALIZED (SELECT i.k, i.id, coalesce(list(p.a ORDER BY p.a) FILTER (p.a IS NOT NULL), []) AS smaller FROM ids i LEFT JOIN pr p ON p.b = i.id GROUP BY i.k, i.id),
 fold(k, id, leader, leaders) AS (SELECT k, id, id, [id] FROM nb WHERE k = 1
  UNION ALL SELECT nb.k, nb.id, coalesce(list_min(list_intersect(nb.smaller, leaders)), nb.id), CASE WHEN len(list_intersect(nb.smaller, leaders)) = 0 THEN list_append(leaders, nb.id) ELSE leaders END FROM fold JOIN nb ON nb.k = fold.k + 1)"""


@query("m12_leader_clusters", f"WITH RECURSIVE {LEADERS} SELECT id, leader FROM fold")
def m12_clusters(spark, d):
    return M.leaders(pairs(spark, d))


@query("m13_merged_clusters", f"WITH RECURSIVE {LEADERS} SELECT leader, round(least(max(id % 10 / 10.0::DOUBLE) + 0.1::DOUBLE, 1), 6) AS importance, count(*) AS size FROM fold GROUP BY leader HAVING count(*) > 1")
def m13(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10 / 10.0).alias("importance"))
    return M.merge_clusters(v, M.leaders(pairs(spark, d)))


@query("m14_scoped_state", """WITH w AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'user:' || event_type WHEN event_type = 'error' THEN 'app:error' ELSE event_type END AS key FROM events)
 SELECT CASE WHEN starts_with(key, 'user:') THEN 'user' ELSE 'app' END AS scope, CASE WHEN starts_with(key, 'user:') THEN user_id END AS owner, key, arg_max(value, (ts, event_id)) AS value FROM w WHERE starts_with(key, 'user:') OR starts_with(key, 'app:') GROUP BY ALL""")
def m14(spark, d):
    e = F.col("event_type")
    key = F.when(e.isin("click", "view"), F.concat(F.lit("user:"), e)).when(e == "error", "app:error").otherwise(e)
    return M.scoped_state(table(spark, d, "events").select("user_id", key.alias("key"), "value", F.col("ts").alias("updated_at"), F.col("event_id").alias("seq")))


@query("m15_summary", f"WITH {CHAT_SQL} SELECT user_id, right(string_agg(content, ' ' ORDER BY id), 500) AS summary FROM chat GROUP BY user_id")
def m15(spark, d):
    return M.summary(S.chat(spark, d))


@query("m16_flatten_blocks", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' x end' ELSE text END AS content FROM conversations")
def m16(spark, d):
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    packed = F.to_json(F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.lit("end"))))
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", M.flatten_blocks(F.when(F.col("turn") % 2 == 0, packed).otherwise(F.col("text"))).alias("content"))


@query("m17_fact_filter", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 0.8::DOUBLE WHEN 'system' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS importance FROM conversations WHERE length(text) > 10")
def m17(spark, d):
    kept = table(spark, d, "conversations").where(F.length("text") > 10)
    return kept.select("conv_id", "turn", F.when(F.col("role") == "user", 0.8).when(F.col("role") == "system", 0.9).otherwise(0.6).alias("importance"))


@query("m18_failures_to_replay", f"WITH {INTERACTIONS_SQL} SELECT id, user_id FROM interactions WHERE success = 0 AND id > 500 ORDER BY id LIMIT 10")
def m18(spark, d):
    return S.interactions(spark, d).where("success = 0 AND id > 500").select("id", "user_id").orderBy("id").limit(10)


@query("w01_last_n", f"WITH {CHAT_SQL} SELECT user_id, id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS n FROM chat) WHERE n <= 6")
def w01(spark, d):
    return M.last_n(S.chat(spark, d))


@query("w02_compressed_history", f"""WITH {CHAT_SQL}, s AS (SELECT user_id, count(*) AS n, right(string_agg(content, ' ' ORDER BY id), 500) AS summary FROM chat GROUP BY user_id)
 SELECT user_id, id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS n FROM chat) WHERE n <= 6
 UNION ALL SELECT user_id, -2, 'user', '{M.HANDOVER}' || summary FROM s WHERE summary <> ''
 UNION ALL SELECT user_id, -1, 'assistant', CASE WHEN n <= 6 THEN '{M.SHORT_REPLY.replace("'", "''")}' ELSE '{M.CUT_REPLY}' END FROM s WHERE summary <> ''""")
def w02(spark, d):
    chat = S.chat(spark, d)
    return M.compressed(chat, M.summary(chat))
