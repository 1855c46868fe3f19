"""Queries: small operators one by one (predicates, join kinds, set logic, scalar functions)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import html as H
from quern.functions import text as T
from quern.operators import analytics as A
from quern.operators import documents as D
from quern.operators import retrieval as R
from quern.operators import sequences as Q
from quern.plans.registry import query
from quern.plans.retrieval import OVERLAP, asked, cut, docs, vectors
from quern.plans.sequences import EV, events
from quern.session import table
from quern.sources import adapters as S
from quern.sources.adapters import AS_OF, MEMORIES_SQL, TASKS_SQL

NOW = f"TIMESTAMP '{AS_OF}'"
STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


@query("p02_null_predicates", f"WITH {MEMORIES_SQL} SELECT id, accessed_at IS NULL AS unread FROM memories WHERE archived_at IS NULL")
def p02(spark, d):
    return S.memories(spark, d).where(F.col("archived_at").isNull()).select("id", F.col("accessed_at").isNull().alias("unread"))


@query("p04_in_list", f"WITH {TASKS_SQL} SELECT id, status FROM tasks WHERE status IN ('pending', 'failed') AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p04(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return S.tasks(spark, d).where(F.col("status").isin("pending", "failed")).join(chosen, "user_id", "left_semi").select("id", "status")


@query("p05_time_range", f"SELECT event_id, ts > {NOW} - INTERVAL 1 HOUR AS last_hour FROM events WHERE ts > {NOW} - INTERVAL 2 DAY AND ts <= {NOW}")
def p05(spark, d):
    recent = table(spark, d, "events").where(A.within("ts", AS_OF, days=2))
    return recent.select("event_id", A.within("ts", AS_OF, hours=1).alias("last_hour"))


@query("p07_score_threshold", f"WITH {OVERLAP} SELECT query_id, id, score FROM ov WHERE score >= 0.5")
def p07(spark, d):
    return R.word_overlap(docs(spark, d), asked(spark, d), None, least=0.49995).where("score >= 0.5").select("query_id", "id", "score")


@query("j01_chunk_document", "SELECT d.source, count(*) AS chunks, CAST(sum(length(w)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS w FROM documents) c JOIN documents d USING (doc_id) GROUP BY d.source")
def j01(spark, d):
    own = table(spark, d, "documents")
    chunks = own.select("doc_id", F.explode(F.split("text", "\n")).alias("w"))
    return chunks.join(own.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("w")).alias("chars"))


@query("j03_vector_meta", "SELECT e.vec_id, e.label, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def j03(spark, d):
    return vectors(spark, d).select(F.col("id").alias("vec_id"), "label").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")


@query("j07_child_parent", "SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def j07(spark, d):
    c = table(spark, d, "conversations")
    parents = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return c.select("conv_id", "turn").join(parents, ["conv_id", "turn"], "left")


@query("j09_enriched_hits", f"WITH {OVERLAP}, t AS ({cut('ov', 3)}) SELECT query_id, id, lang, source, quality FROM t LEFT JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id")
def j09(spark, d):
    hits = R.word_overlap(docs(spark, d), asked(spark, d), 3).select("query_id", "id")
    own = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return hits.join(own, "id", "left").join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")


@query("j11_first_seen_wins", "SELECT user_id, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 ELSE 1 END, ts, event_id) AS n FROM events WHERE event_type IN ('click', 'view')) WHERE n = 1")
def j11(spark, d):
    some = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    place = F.when(F.col("event_type") == "click", 0).otherwise(1)
    return some.groupBy("user_id").agg(F.min_by("value", F.struct(place, "ts", "event_id")).alias("value"))


@query("j12_semi", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def j12(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("o01_ordered", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def o01(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("o05_candidates", f"WITH {MEMORIES_SQL} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, created_at DESC, id) AS n FROM memories) WHERE n <= 20")
def o05(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("created_at"), "id")
    return S.memories(spark, d).select("user_id", "id", F.row_number().over(w).alias("n")).where("n <= 20").drop("n")


@query("w08_ranks", f"WITH {OVERLAP} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM ov WHERE score > 0.4")
def w08(spark, d):
    scored = R.word_overlap(docs(spark, d), asked(spark, d), None, least=0.4).where("score > 0.4").select("query_id", "id", "score")
    return R.ranked(scored).select("query_id", "id", "rank")


@query("a17_ngram_counter", f"WITH {EV}, p AS (SELECT action || '->' || lead(action) OVER (PARTITION BY user_id ORDER BY ts, id) AS gram FROM ev) SELECT gram, count(*) AS n FROM p WHERE gram IS NOT NULL GROUP BY gram")
def a17(spark, d):
    pairs = Q.follow_ups(events(spark, d))
    return pairs.select(F.concat_ws("->", "action", "next").alias("gram"), "n")


@query("a19_follow_up_counter", f"WITH {EV}, p AS (SELECT action, lead(action) OVER (PARTITION BY user_id ORDER BY ts, id) AS next FROM ev) SELECT next, count(*) AS n FROM p WHERE action = 'error' AND next IS NOT NULL GROUP BY next")
def a19(spark, d):
    return Q.follow_ups(events(spark, d)).where("action = 'error'").select("next", "n")


@query("set01_word_sets", r"""WITH p AS (SELECT c.conv_id, c.turn, list_distinct(regexp_extract_all(lower(c.text), '\S+')) AS x, list_distinct(regexp_extract_all(lower(a.text), '\S+')) AS y FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1)
 SELECT conv_id, turn, len(list_intersect(x, y)) AS both, len(list_distinct(list_concat(x, y))) AS either, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS first_only FROM p""")
def set01(spark, d):
    c = table(spark, d, "conversations")
    w = lambda name: F.array_distinct(T.words(F.col("text"))).alias(name)
    both = c.select("conv_id", "turn", w("x")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), w("y")), ["conv_id", "turn"])
    count = lambda column, name: F.size(column).cast("long").alias(name)
    return both.select("conv_id", "turn", count(F.array_intersect("x", "y"), "both"), count(F.array_union("x", "y"), "either"), count(F.array_except("x", "y"), "first_only"))


@query("d02_code_fences")
def d02(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    fenced = F.concat(F.left("text", half), F.lit("\n```\n"), F.repeat(F.lit("code line\n"), 40), F.lit("```\n"), F.substring("text", half + 1, F.length("text")))
    own = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("md").alias("kind"), fenced.alias("text"))
    return D.chunks(own).where(F.col("content").contains("```")).select("id", "chunk_index", (F.size(F.split("content", "```")) - 1).alias("fences"))


@query("d06_markdown_tables", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_rows FROM orders GROUP BY o_custkey")
def d06(spark, d):
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" |"))
    pages = table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("# orders\n\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return pages.select("o_custkey", F.regexp_count("text", F.lit(r"(?m)^\|.*\|$")).cast("long").alias("n_rows"))


@query("f01_strip_html_lines", f"""SELECT page_id, length({STRIP.format("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")}) AS n FROM pages""")
def f01(spark, d):
    text = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")
    return table(spark, d, "pages").select("page_id", F.length(T.strip(text)).cast("long").alias("n"))


@query("f02_strings", f"SELECT doc_id, concat_ws('-', substr(text, 1, 5), lang) AS head, len(string_split(text, ' ')) AS parts, starts_with(text, 'The') AS led, replace(text, 'th', 'TH') AS swapped, lower({STRIP.format('text')}) AS low FROM documents")
def f02(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.concat_ws("-", F.substring(t, 1, 5), "lang").alias("head"), F.size(F.split(t, " ")).cast("long").alias("parts"), t.startswith("The").alias("led"), F.replace(t, F.lit("th"), F.lit("TH")).alias("swapped"), F.lower(T.strip(t)).alias("low"))


@query("f03_patterns", r"SELECT doc_id, regexp_matches(text, '\d{4}') AS year, len(regexp_extract_all(text, '[A-Z]\w+')) AS capitals, regexp_extract(text, '(\w+)\.', 1) AS first_end FROM documents")
def f03(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(r"\d{4}").alias("year"), F.regexp_count(t, F.lit(r"[A-Z]\w+")).cast("long").alias("capitals"), F.regexp_extract(t, r"(\w+)\.", 1).alias("first_end"))


@query("f06_hashes", f"SELECT doc_id, md5(lower({STRIP.format('text')})) AS content_hash, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short FROM documents")
def f06(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.content_hash(t).alias("content_hash"), F.sha2(t, 256).alias("digest"), F.substring(F.sha2(t, 256), 1, 16).alias("short"))


@query("f07_numbers", "SELECT event_id, round(exp(-value / 10), 6) AS e, round(sqrt(value), 6) AS r, round(ln(value + 1), 6) AS l, floor(value) AS f, greatest(0, least(1, value / 10)) AS clamped, pow(2.0::DOUBLE, event_id % 8) AS p FROM events")
def f07(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.round(F.exp(-v / 10), 6).alias("e"), F.round(F.sqrt(v), 6).alias("r"), F.round(F.log(v + 1), 6).alias("l"), F.floor(v).cast("double").alias("f"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 10)).alias("clamped"), F.pow(F.lit(2.0), F.col("event_id") % 8).alias("p"),
    )


@query("f08_dates", f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, dayofweek(ts) AS weekday, CAST(date_diff('day', CAST(ts AS DATE), CAST({NOW} AS DATE)) AS BIGINT) AS age FROM events")
def f08(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.hour(ts).cast("long").alias("hour"), (F.dayofweek(ts) - 1).cast("long").alias("weekday"), F.datediff(S.now().cast("date"), ts.cast("date")).cast("long").alias("age"))


@query("f09_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS packed FROM events""")
def f09(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("packed"))


@query("f10_arrays", "SELECT conv_id, len(l) AS n, len(list_distinct(l)) AS kinds, list_contains(l, 'system') AS has_system, l[1:2] AS first_two FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def f10(spark, d):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    each = table(spark, d, "conversations").groupBy("conv_id").agg(roles.alias("l"))
    return each.select("conv_id", F.size("l").cast("long").alias("n"), F.size(F.array_distinct("l")).cast("long").alias("kinds"), F.array_contains("l", "system").alias("has_system"), F.slice("l", 1, 2).alias("first_two"))


@query("f11_maps", "SELECT p_partkey, CASE WHEN length(p_name || p_type || p_brand) > 20 THEN '{{name}}' ELSE p_name || p_type || p_brand END AS name, p_brand AS brand FROM part")
def f11(spark, d):
    m = F.create_map(F.lit("name"), F.concat("p_name", "p_type", "p_brand"), F.lit("brand"), F.col("p_brand"))
    short = F.transform_values(m, lambda k, v: F.when(F.length(v) > 20, F.concat(F.lit("{{"), k, F.lit("}}"))).otherwise(v))
    return table(spark, d, "part").select("p_partkey", short.alias("m")).select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["brand"].alias("brand"))


@query("f13_urls", "SELECT page_id, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS normal FROM pages")
def f13(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", H.host(url).alias("host"), H.normalised(url).alias("normal"))


@query("f14_conditionals", "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), lang) AS tag, CASE WHEN n_chars > 3000 THEN 'long' WHEN n_chars > 500 THEN 'medium' ELSE 'short' END AS size, least(n_chars, 1000) AS cut FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def f14(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.col("n_chars")
    return both.select("doc_id", F.coalesce(F.col("quality").cast("string"), "lang").alias("tag"), F.when(n > 3000, "long").when(n > 500, "medium").otherwise("short").alias("size"), F.least(n, F.lit(1000)).alias("cut"))


@query("m03_linear_recency", f"WITH {MEMORIES_SQL} SELECT user_id, round(avg(greatest(0, 1 - floor(greatest(date_diff('second', created_at, {NOW}) / 86400.0::DOUBLE, 0)) / 365.0::DOUBLE)), 6) AS recency FROM memories GROUP BY user_id")
def m03(spark, d):
    from quern.operators.memory import recency

    return S.memories(spark, d).groupBy("user_id").agg(F.round(F.avg(recency(F.col("created_at"), AS_OF)), 6).alias("recency"))
