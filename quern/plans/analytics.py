"""Queries: telemetry aggregates, predicates, joins on dimensions, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import analytics as A
from quern.plans.registry import query
from quern.session import table
from quern.sources import adapters as S
from quern.sources.adapters import AS_OF, FILES_SQL, INTERACTIONS_SQL, MEMORIES_SQL, TASKS_SQL, USAGE_SQL

T = f"TIMESTAMP '{AS_OF}'"
DAY = f"CAST({T} AS DATE)"
SUM = "round(coalesce(sum({}), 0), 4)"


@query("a01_usage_by_model", f"""WITH {USAGE_SQL} SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, round(sum(cost_usd), 4) AS cost, count(*) AS calls FROM usage WHERE ts > {T} - INTERVAL 7 DAY AND ts <= {T} GROUP BY model""")
def a01(spark, d):
    return A.usage_by_model(S.usage(spark, d), AS_OF)


@query("a02_daily_usage", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS cost, count(*) AS calls FROM events WHERE ts > {T} - INTERVAL 14 DAY AND ts <= {T} GROUP BY 1""")
def a02(spark, d):
    return A.daily_usage(S.usage(spark, d), AS_OF).withColumn("day", F.col("day").cast("string"))


PERIODS = f"""SELECT round(coalesce(sum(value) FILTER (CAST(ts AS DATE) = {DAY}), 0), 4) AS today_cost, count(*) FILTER (CAST(ts AS DATE) = {DAY}) AS today_calls,
 round(coalesce(sum(value) FILTER (CAST(ts AS DATE) = {DAY} - 1), 0), 4) AS yesterday_cost, count(*) FILTER (CAST(ts AS DATE) = {DAY} - 1) AS yesterday_calls,
 round(coalesce(sum(value) FILTER (ts > {T} - INTERVAL 1 HOUR AND ts <= {T}), 0), 4) AS hour_cost, count(*) FILTER (ts > {T} - INTERVAL 1 HOUR AND ts <= {T}) AS hour_calls FROM events"""


@query("a03_a05_period_stats", PERIODS)
def a03(spark, d):
    return A.period_stats(S.usage(spark, d), AS_OF)


TOTALS = f"""WITH {USAGE_SQL} SELECT CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, round(sum(cost_usd), 2) AS total_cost_usd, count(*) AS total_calls FROM usage"""


@query("a06_totals", TOTALS)
def a06(spark, d):
    return A.totals(S.usage(spark, d))


RATE = f"SELECT round(coalesce(100 * avg(success), 100), 1) AS success_rate FROM interactions WHERE created_at > {T} - INTERVAL 24 HOUR AND created_at <= {T}"


@query("a07_success_rate", f"WITH {INTERACTIONS_SQL} {RATE}")
def a07(spark, d):
    return A.success_rate(S.interactions(spark, d), AS_OF)


@query("a08_avg_confidence", f"WITH {INTERACTIONS_SQL} SELECT round(coalesce(avg(confidence), 0), 1) AS avg_confidence FROM interactions WHERE created_at > {T} - INTERVAL 24 HOUR AND created_at <= {T}")
def a08(spark, d):
    return A.average_confidence(S.interactions(spark, d), AS_OF)


@query("a09_cache_efficiency", f"WITH {USAGE_SQL} SELECT round(100.0::DOUBLE * sum(cache_read_tokens) / sum(input_tokens), 1) AS cache_efficiency FROM usage")
def a09(spark, d):
    return A.cache_efficiency(S.usage(spark, d))


@query("a10_model_distribution", f"SELECT event_type AS model, count(*) AS calls, round(sum(value), 4) AS cost FROM events WHERE CAST(ts AS DATE) = {DAY} GROUP BY 1")
def a10(spark, d):
    return A.model_distribution(S.usage(spark, d), AS_OF)


@query("a11_row_counts", f"""WITH {MEMORIES_SQL} SELECT 'memories' AS relation, count(*) AS n, count(archived_at) AS marked FROM memories
 UNION ALL SELECT 'files', count(*), count(*) FILTER (p_size > 25) FROM part UNION ALL SELECT 'chat', count(*), count(*) FILTER (role = 'user') FROM conversations""")
def a11(spark, d):
    one = lambda df, name, marked: df.agg(F.lit(name).alias("relation"), F.count("*").alias("n"), marked.alias("marked"))
    return (
        one(S.memories(spark, d), "memories", F.count("archived_at"))
        .union(one(table(spark, d, "part"), "files", F.count_if(F.col("p_size") > 25)))
        .union(one(table(spark, d, "conversations"), "chat", F.count_if(F.col("role") == "user")))
    )


@query("a12_queue_stats", f"""WITH {TASKS_SQL} SELECT coalesce(task_type, 'all') AS task_type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed
 FROM tasks GROUP BY GROUPING SETS ((task_type), ())""")
def a12(spark, d):
    return A.queue_stats(S.tasks(spark, d), ["pending", "done", "failed"])


@query("a13_health_kpi", f"""WITH {INTERACTIONS_SQL}, p AS ({PERIODS}), r AS ({RATE}), k AS (SELECT *, round(100 - success_rate, 1) AS error_rate, round(today_cost / 5000.0::DOUBLE * 100, 1) AS budget_pct FROM p, r)
 SELECT success_rate, today_cost, today_calls, yesterday_cost, yesterday_calls, error_rate, budget_pct,
 CASE WHEN error_rate > 20 OR budget_pct > 90 THEN 'down' WHEN error_rate > 10 OR budget_pct > 70 THEN 'degraded' ELSE 'healthy' END AS status FROM k""")
def a13(spark, d):
    return A.health(S.usage(spark, d), S.interactions(spark, d), AS_OF, 5000.0)


@query("a14_usage_kpi", f"""WITH p AS ({PERIODS}), t AS ({TOTALS}) SELECT today_cost, today_calls, hour_cost, hour_calls, total_cost_usd AS total_cost, total_calls, total_input_tokens + total_output_tokens AS total_tokens FROM p, t""")
def a14(spark, d):
    u = S.usage(spark, d)
    return A.period_stats(u, AS_OF).join(F.broadcast(A.totals(u))).select(  # one row each
        "today_cost", "today_calls", "hour_cost", "hour_calls", F.col("total_cost_usd").alias("total_cost"), "total_calls", (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_tokens"))


@query("a16_quality_averages", """WITH l AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT count(*) AS n, round(avg(value), 3) AS avg_faithfulness, round(avg(value / 2), 3) AS avg_relevancy FROM l""")
def a16(spark, d):
    last = table(spark, d, "events").select("ts", "event_id", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return last.agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("avg_faithfulness"), F.round(F.avg(F.col("value") / 2), 3).alias("avg_relevancy"))


@query("a18_hour_actions", f"""SELECT user_id, substr(lower(event_type), 1, 50) AS action, count(*) AS n FROM events WHERE hour(ts) BETWEEN hour({T}) - 1 AND hour({T}) + 1 AND ts > {T} - INTERVAL 30 DAY AND ts <= {T} GROUP BY ALL HAVING count(*) >= 3""")
def a18(spark, d):
    e = table(spark, d, "events").where(A.within("ts", AS_OF, days=30))
    h = F.hour(S.now())
    return e.where(F.hour("ts").between(h - 1, h + 1)).groupBy("user_id", F.substring(F.lower("event_type"), 1, 50).alias("action")).agg(F.count("*").alias("n")).where("n >= 3")


@query("a20_distinct_users", "SELECT DISTINCT source AS user_id FROM documents")
def a20(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("user_id")).distinct()


@query("a23_access_suggestions", "SELECT l_partkey AS path, l_suppkey AS user_id, count(*) AS access_count, max(l_shipdate) AS last_accessed FROM lineitem GROUP BY ALL HAVING count(*) >= 3 AND l_partkey % 5 <> 0")
def a23(spark, d):
    seen = table(spark, d, "lineitem").where(F.col("l_partkey") % 5 != 0)  # each fifth file is indexed already
    return seen.groupBy(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("user_id")).agg(F.count("*").alias("access_count"), F.max("l_shipdate").alias("last_accessed")).where("access_count >= 3")


@query("a24_tools_by_server", "SELECT split_part(p_type || '__' || p_brand, '__', 1) AS server, count(*) AS tools, list_sort(list(DISTINCT p_brand))::VARCHAR[] AS names FROM part GROUP BY 1")
def a24(spark, d):
    tools = table(spark, d, "part").select(F.concat_ws("__", "p_type", "p_brand").alias("name"))
    return tools.groupBy(F.split("name", "__")[0].alias("server")).agg(F.count("*").alias("tools"), F.array_sort(F.collect_set(F.split("name", "__")[1])).alias("names"))


@query("a25_modal_size", "SELECT p_brand, min(p_size) AS modal_size FROM (SELECT p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY count(*) DESC) AS r FROM part GROUP BY p_brand, p_size) WHERE r = 1 GROUP BY p_brand")
def a25(spark, d):
    n = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return n.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", -F.col("p_size"))).alias("modal_size"))


@query("j10_cost_with_pricing", f"""WITH {USAGE_SQL}, p(m, i, o, c) AS (VALUES ('click', 3.0::DOUBLE, 15.0::DOUBLE, 0.3::DOUBLE), ('view', 0.8, 4.0, 0.08), ('purchase', 15.0, 75.0, 1.5))
 SELECT user_id, round(sum((input_tokens * coalesce(i, 3.0::DOUBLE) + output_tokens * coalesce(o, 15.0::DOUBLE) + cache_read_tokens * coalesce(c, 0.3::DOUBLE)) / 1000000), 6) AS cost FROM usage LEFT JOIN p ON m = model GROUP BY user_id""")
def j10(spark, d):
    prices = [("click", 3.0, 15.0, 0.3), ("view", 0.8, 4.0, 0.08), ("purchase", 15.0, 75.0, 1.5)]
    return A.priced(S.usage(spark, d), prices).groupBy("user_id").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("e12_budget_gate", f"""WITH {USAGE_SQL}, s AS (SELECT id, user_id, ts, round(coalesce(sum(cost_usd) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS spent FROM usage)
 SELECT *, spent >= 100 AS blocked FROM s""")
def e12(spark, d):
    return A.budget_gate(S.usage(spark, d), 100.0)


@query("p01_filtered_tasks", f"WITH {TASKS_SQL} SELECT * FROM tasks WHERE status = 'pending' AND task_type IN ('1-URGENT', '2-HIGH')")
def p01(spark, d):
    return S.tasks(spark, d).where((F.col("status") == "pending") & F.col("task_type").isin("1-URGENT", "2-HIGH"))


@query("p03_contains", "SELECT doc_id, text LIKE '%the%' AS hit, starts_with(text, 'Th') AS led FROM documents WHERE contains(lower(text), 'token') OR starts_with(text, 'Th')")
def p03(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").where(F.lower(text).contains("token") | text.startswith("Th")).select("doc_id", text.contains("the").alias("hit"), text.startswith("Th").alias("led"))


@query("p06_missing_prefix", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(CAST(quality AS VARCHAR), '') = ''")
def p06(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return both.where(F.coalesce(F.col("quality").cast("string"), F.lit("")) == "").select("doc_id")


@query("o02_top_by_score", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def o02(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query("o03_page", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def o03(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(40).limit(20)


@query("s08_storage_stats", f"WITH {FILES_SQL} SELECT source, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM files GROUP BY source")
def s08(spark, d):
    return S.files(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("total_bytes"))


@query("d18_cleanup_proposal", f"WITH {FILES_SQL} SELECT id, name, accessed_at FROM files WHERE accessed_at < {T} - INTERVAL 30 DAY ORDER BY accessed_at, id LIMIT 50")
def d18(spark, d):
    return S.files(spark, d).where(F.col("accessed_at") < S.now() - F.make_dt_interval(days=F.lit(30))).select("id", "name", "accessed_at").orderBy("accessed_at", "id").limit(50)


@query("p13_indexable", f"""WITH {FILES_SQL} SELECT id, name, size_bytes <= 10485760 AND (starts_with(mime_type, 'text/') OR mime_type = 'application/pdf' OR ext IN ('md', 'txt', 'py', 'json', 'go', 'pdf')) AS indexable FROM files""")
def p13(spark, d):
    from quern.functions.files import indexable

    return S.files(spark, d).select("id", "name", indexable("mime_type", "name", "size_bytes").alias("indexable"))


@query("e16_due_tasks", f"WITH {TASKS_SQL} SELECT id, user_id, next_run_at FROM tasks WHERE status = 'pending' AND next_run_at <= TIMESTAMP '1998-01-01' ")
def e16(spark, d):
    return S.tasks(spark, d).where((F.col("status") == "pending") & (F.col("next_run_at") <= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))).select("id", "user_id", "next_run_at").orderBy("next_run_at", "id")
