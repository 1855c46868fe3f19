"""Queries: sequences, scores and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import sequences as Q
from quern.plans.registry import query
from quern.session import table
from quern.sources import adapters as S
from quern.sources.adapters import AS_OF, CHAT_SQL, TASKS_SQL

NOW = f"TIMESTAMP '{AS_OF}'"


def events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), "value", "ts", (F.col("event_type") != "error").cast("int").alias("success"))


EV = "ev AS (SELECT event_id AS id, user_id, event_type AS action, value, ts, CAST(event_type <> 'error' AS INT) AS success FROM events)"


@query("w03_rate_count", f"WITH {EV} SELECT user_id AS client, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) > 2 AS over FROM ev")
def w03(spark, d):
    return Q.rate_counts(events(spark, d).withColumnRenamed("user_id", "client"), 3600, 2)


@query("w04_sessions", f"""WITH {EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 21600 SECOND THEN 0 ELSE 1 END AS cut FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM g) SELECT user_id AS client, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def w04(spark, d):
    return Q.sessions(events(spark, d).withColumnRenamed("user_id", "client"), "21600 seconds")


@query("w05_follow_ups", f"WITH {EV}, p AS (SELECT action, lead(action) OVER (PARTITION BY user_id ORDER BY ts, id) AS next FROM ev) SELECT action, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY ALL")
def w05(spark, d):
    return Q.follow_ups(events(spark, d))


LISTS = f"l AS (SELECT user_id, CAST(ts AS DATE) AS day, list(action ORDER BY ts, id) AS names FROM ev GROUP BY ALL)"


def lists(spark, d):
    e = events(spark, d).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "action"))).alias("x"))
    return e.select(F.transform("x", lambda v: v["action"]).alias("names")).where(F.size("names") >= 2)


GRAMS = f"""{EV}, {LISTS}, n AS (SELECT array_to_string(names[i:i + k - 1], '->') AS gram FROM (SELECT names, unnest(range(1, len(names) + 1)) AS i FROM l WHERE len(names) >= 2), (VALUES (2), (3), (4)) v(k) WHERE i + k - 1 <= len(names))"""


@query("w06_ngrams", f"WITH {GRAMS} SELECT gram, count(*) AS n FROM n GROUP BY gram")
def w06(spark, d):
    return Q.ngrams(lists(spark, d))


#: The lists of the last days, at most twenty a user.
RECENT = GRAMS.replace(LISTS, f"{LISTS.replace('l AS', 'every AS')}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS back FROM every WHERE day >= DATE '2024-01-05') WHERE back <= 20)")


@query("e01_patterns", f"""WITH RECURSIVE {RECENT}, c AS (SELECT gram, count(*) AS n, len(string_split(gram, '->')) AS len FROM n GROUP BY gram HAVING count(*) >= 3), r AS (SELECT gram, n, row_number() OVER (ORDER BY n DESC, len, gram) AS pos FROM c)
 SELECT gram, n FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.pos < a.pos AND contains(b.gram, a.gram)) ORDER BY pos LIMIT 5""")
def e01(spark, d):
    e = events(spark, d).groupBy("user_id", F.col("ts").cast("date").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "action"))), lambda v: v["action"]).alias("names"))
    return Q.repeated_patterns(Q.recent_lists(e, F.lit("2024-01-05").cast("date"), 20))


@query("e02_suggestions", f"""WITH {EV}, p AS (SELECT user_id, action, lead(action) OVER (PARTITION BY user_id ORDER BY ts, id) AS next FROM ev), c AS (SELECT user_id, action, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
 SELECT user_id, action, next, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, action, next) AS k FROM c) WHERE k <= 2""")
def e02(spark, d):
    from pyspark.sql import Window

    e = events(spark, d)
    nxt = F.lead("action").over(Window.partitionBy("user_id").orderBy("ts", "id"))
    counts = e.select("user_id", "action", nxt.alias("next")).where("next IS NOT NULL").groupBy("user_id", "action", "next").agg(F.count("*").alias("n")).where("n >= 3")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "action", "next"))
    return counts.withColumn("k", k).where("k <= 2").drop("k")


@query("e03_similar_inputs", r"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(a.text), '\S+')) AS x, list_distinct(regexp_extract_all(lower(b.text), '\S+')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2)
 SELECT conv_id, turn, round(len(list_intersect(x, y)) / CAST(least(len(x), len(y)) AS DOUBLE), 6) AS similarity FROM p""")
def e03(spark, d):
    c = table(spark, d, "conversations")
    w = lambda n: F.array_distinct(T.words(F.col("text"))).alias(n)
    both = c.select("conv_id", "turn", w("x")).join(c.select("conv_id", (F.col("turn") - 2).alias("turn"), w("y")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(T.least_overlap(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("w07_ema", f"""WITH {EV}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
 SELECT user_id, round(sum(value * pow(0.7::DOUBLE, n - i) * CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END), 6) AS ema, count(*) AS n FROM r GROUP BY user_id""")
def w07(spark, d):
    return Q.ema(events(spark, d))


@query("w09_char_budget", f"WITH {CHAT_SQL} SELECT user_id, id, total FROM (SELECT user_id, id, CAST(sum(length(content)) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM chat) WHERE total <= 1500")
def w09(spark, d):
    return Q.char_budget(S.chat(spark, d), 1500).select("user_id", "id", "total")


@query("w10_ring", f"WITH {EV} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS n FROM ev WHERE success = 0) WHERE n <= 10")
def w10(spark, d):
    return Q.ring(events(spark, d).where("success = 0"), 10).select("user_id", "id")


@query("a15_tier_counts", f"""SELECT CASE WHEN s >= 3 THEN 'complex' WHEN s >= 1 THEN 'medium' ELSE 'simple' END AS tier, count(*) AS n FROM (SELECT CASE WHEN length(text) > 500 THEN 2 WHEN length(text) > 100 THEN 1 ELSE 0 END AS s FROM (SELECT text FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 50)) GROUP BY 1""")
def a15(spark, d):
    last = table(spark, d, "conversations").where("role = 'user'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(50)
    return last.groupBy(T.tier(F.when(F.length("text") > 500, 2).when(F.length("text") > 100, 1).otherwise(0)).alias("tier")).agg(F.count("*").alias("n"))


def marks(words) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)


@query("e09_complexity", f"""WITH h AS (SELECT conv_id, turn, text, {marks(T.COMPLEX)} AS hard, {marks(T.MEDIUM)} AS mid FROM conversations),
 s AS (SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN 2 WHEN length(text) > 100 THEN 1 ELSE 0 END + hard * 2 + CASE WHEN hard = 0 THEN mid ELSE 0 END - CASE WHEN ends_with(text, '?') AND length(text) < 80 AND hard = 0 THEN 1 ELSE 0 END AS score FROM h)
 SELECT conv_id, turn, score, CASE WHEN score >= 3 THEN 'complex' WHEN score >= 1 THEN 'medium' ELSE 'simple' END AS tier FROM s""")
def e09(spark, d):
    scored = table(spark, d, "conversations").select("conv_id", "turn", T.complexity(F.col("text")).alias("score"))
    return scored.withColumn("tier", T.tier(F.col("score")))


FRICTION = "|".join(f"(?:{p})" for p in T.FRICTION if p.isascii()).replace("'", "''")


@query("e04_friction_flags", f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(t), '{FRICTION}') THEN 'correction' END AS signal FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'No, I meant ' || text ELSE text END AS t FROM conversations)")
def e04(spark, d):
    text = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("No, I meant "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.friction(text).alias("signal"))


@query("e05_style", r"""WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '\S+') AS w, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S')) AS s FROM conversations),
 f AS (SELECT *, greatest(len(w), 1) AS n, list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '\S+')))) / CAST(greatest(len(s), 1) AS DOUBLE) AS per FROM w)
 SELECT conv_id, turn, round(least(1, greatest(0, coalesce(per, 0) / 20)), 6) AS verbosity, round(least(1, greatest(0, 1.0::DOUBLE - len(list_filter(w, lambda x: x IN ('hey', 'lol', 'btw', 'pls', 'thx', 'gonna', 'wanna', 'ya', 'yep', 'nope', 'nah', 'cool', 'haha', 'ok', 'ty', 'np', 'bruh'))) / CAST(n AS DOUBLE) * 10)), 6) AS formality FROM f""")
def e05(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.style(F.col("text")).alias("s")).select("conv_id", "turn", "s.verbosity", "s.formality")


@query("e06_style_guidance", """WITH s AS (SELECT event_id, event_id % 10 / 10.0::DOUBLE AS f, event_id % 7 / 7.0::DOUBLE AS v, event_id % 3 = 0 AS ru FROM events),
 l AS (SELECT event_id, list_filter([CASE WHEN f < 0.3 THEN 'Use casual, informal tone' WHEN f > 0.7 THEN 'Use formal, professional tone' END, CASE WHEN v < 0.3 THEN 'Be very concise and brief' WHEN v > 0.7 THEN 'Provide detailed explanations' END, 'Explain technical concepts simply', CASE WHEN ru THEN 'Respond in Russian' END], lambda x: x IS NOT NULL) AS p FROM s)
 SELECT event_id, chr(10) || chr(10) || '## Style guidance:' || chr(10) || array_to_string(list_transform(p, lambda x: '- ' || x), chr(10)) AS guidance FROM l""")
def e06(spark, d):
    e = F.col("event_id")
    s = F.struct((e % 10 / 10.0).alias("formality"), (e % 7 / 7.0).alias("verbosity"), F.lit(0.1).alias("technical_level"), F.lit(0.0).alias("emoji_usage"), F.when(e % 3 == 0, "ru").otherwise("en").alias("language"))
    return table(spark, d, "events").select("event_id", T.style_guidance(s).alias("guidance"))


@query("e08_friction_batch", f"WITH {EV}, c AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev WHERE success = 0) SELECT user_id, id FROM c WHERE n >= 5 AND k <= 20")
def e08(spark, d):
    bad = events(spark, d).where("success = 0")
    many = bad.groupBy("user_id").count().where("count >= 5").select("user_id")
    return Q.ring(bad.join(many, "user_id", "left_semi"), 20).select("user_id", "id")


@query("e13_local_hours", f"SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 480 AS night, hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) < 1050 AS day FROM events")
def e13(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", Q.local_hours(ts, "22:00", "08:00").alias("night"), Q.local_hours(ts, "09:00", "17:30").alias("day"))


@query("e14_cron", "SELECT event_id, minute(ts) % 15 = 0 AND hour(ts) BETWEEN 9 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5 AS a, minute(ts) IN (0, 30) AND dayofweek(ts) IN (0, 6) AS b FROM events")
def e14(spark, d):
    return table(spark, d, "events").select("event_id", Q.cron("*/15 9-17 * * 1-5", F.col("ts")).alias("a"), Q.cron("0,30 * * * 6,7", F.col("ts")).alias("b"))


@query("e15_next_run", """WITH m AS (SELECT event_id AS id, ts, date_trunc('day', ts) + to_days(k) + INTERVAL 6 HOUR + to_minutes(n) AS t FROM events, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) v(k), (VALUES (0), (20), (40)) u(n))
 SELECT id, ts, min(t) AS next_run_at FROM m WHERE dayofweek(t) = 1 AND t > date_trunc('minute', ts) GROUP BY id, ts""")
def e15(spark, d):
    return Q.next_run(table(spark, d, "events").select(F.col("event_id").alias("id"), "ts"), "*/20 6 * * 1")


@query("e15_month_ends", """WITH c AS (SELECT t FROM (SELECT d + INTERVAL 3 HOUR + to_minutes(n) AS t FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT max(ts) FROM events) + INTERVAL 366 DAY, INTERVAL 1 DAY)) AS d), (VALUES (15), (45)) u(n)) WHERE day(t) = 31)
 SELECT event_id AS id, ts, CASE WHEN t <= date_trunc('minute', ts) + INTERVAL 1 MINUTE + INTERVAL 366 DAY THEN t END AS next_run_at FROM events ASOF LEFT JOIN c ON c.t > date_trunc('minute', ts)""")
def e15_months(spark, d):
    return Q.next_run(table(spark, d, "events").select(F.col("event_id").alias("id"), "ts"), "15,45 3 31 * *")


@query("e17_transitions", f"""WITH {TASKS_SQL}, e AS (SELECT id, CASE status WHEN 'failed' THEN 'running' ELSE status END AS status, ['claim', 'complete', 'fail', 'cancel'][CAST(id % 4 AS INT) + 1] AS event, id % 3 = 0 AS recurring FROM tasks)
 SELECT id, CASE WHEN event = 'claim' AND status = 'pending' THEN 'running' WHEN event = 'complete' AND status = 'running' THEN CASE WHEN recurring THEN 'pending' ELSE 'done' END WHEN event = 'fail' AND status = 'running' THEN CASE WHEN recurring THEN 'pending' ELSE 'failed' END
 WHEN event = 'cancel' AND status IN ('pending', 'running') THEN 'cancelled' END AS next_status FROM e""")
def e17(spark, d):
    event = F.element_at(F.array(*map(F.lit, ("claim", "complete", "fail", "cancel"))), (F.col("id") % 4 + 1).cast("int"))
    status = F.when(F.col("status") == "failed", "running").otherwise(F.col("status"))
    return S.tasks(spark, d).select("id", Q.transition(status, event, F.col("id") % 3 == 0).alias("next_status"))


@query("e18_queue", "WITH q AS (SELECT doc_id AS target_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 200) SELECT target_id, (row_number() OVER (ORDER BY target_id) - 1) // 20 AS batch_no FROM q")
def e18(spark, d):
    queue = table(spark, d, "labels").select(F.col("doc_id").alias("target_id"), F.lit("done").alias("status"))
    return Q.enqueue(queue, table(spark, d, "documents").select(F.col("doc_id").alias("target_id")))


STREAK = f"""{EV}, i AS (SELECT *, sum(success) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS g FROM ev), k AS (SELECT id, user_id, CAST(sum(1 - success) OVER (PARTITION BY user_id, g ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i)"""


@query("e19_streaks", f"WITH {STREAK} SELECT id, user_id, streak, streak >= 3 AS open FROM k")
def e19(spark, d):
    return Q.streaks(events(spark, d)).select("id", "user_id", "streak", (F.col("streak") >= 3).alias("open"))


@query("e20_backoff", f"WITH {STREAK} SELECT id, CASE WHEN streak > 0 THEN least(30 * pow(2.0::DOUBLE, streak - 1), 3600) ELSE 0.0::DOUBLE END AS wait, CASE WHEN streak >= 3 THEN 'down' WHEN streak > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM k")
def e20(spark, d):
    return Q.streaks(events(spark, d)).select("id", Q.backoff(F.col("streak")).alias("wait"), Q.health(F.col("streak")).alias("status"))


@query("e21_tool_call_text", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS name FROM events""")
def e21(spark, d):
    e = F.col("event_id")
    call = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": {"k": 1}}'))
    text = F.when(e % 4 == 0, call).when(e % 4 == 1, F.concat(F.lit("see\n```json\n"), call, F.lit("\n```"))).when(e % 4 == 2, F.translate(call, '"', "'")).otherwise(F.lit("nothing"))
    return table(spark, d, "events").select("event_id", Q.tool_call(text)["name"].alias("name"))


@query("e22_schedules", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN (user_id % 60) || ' 9 * * *' WHEN 1 THEN '*/' || (user_id % 50 + 1) || ' * * * *' WHEN 2 THEN '0 9 * * 1' WHEN 3 THEN '30 8 * * 1-5' WHEN 4 THEN NULL ELSE '0 * * * *' END AS cron FROM events""")
def e22(spark, d):
    e, u = F.col("event_id") % 6, F.col("user_id")
    text = (
        F.when(e == 0, F.concat(F.lit("Every day at 9:"), F.lpad((u % 60).cast("string"), 2, "0"))).when(e == 1, F.concat(F.lit("every "), (u % 50 + 1).cast("string"), F.lit(" min")))
        .when(e == 2, "on Monday").when(e == 3, "weekdays at 8:30").when(e == 4, "tomorrow at 9:00").otherwise("каждый час")
    )
    return table(spark, d, "events").select("event_id", Q.schedule(text).alias("cron"))


@query("e23_skills", f"""WITH {EV}, {LISTS} SELECT user_id, CAST(day AS VARCHAR) AS day, lower(names[1]) || '_' || lower(names[2]) || '_' || lower(names[3]) AS name, len(names) AS steps FROM l WHERE len(names) >= 3""")
def e23(spark, d):
    e = events(spark, d).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "action"))).alias("x"))
    calls = F.transform("x", lambda v: F.struct(v["action"].alias("name"), F.create_map(F.lit("k"), v["action"]).alias("input")))
    request = F.array_join(F.transform(F.slice("x", 1, 3), lambda v: v["action"]), " ")
    return e.select("user_id", F.col("day").cast("string").alias("day"), Q.skill(calls, request).alias("s")).where("s IS NOT NULL").select("user_id", "day", "s.name", F.size("s.steps").cast("long").alias("steps"))


@query("e24_config_diff", """WITH o AS (SELECT p_type || '.' || p_partkey AS path, p_brand AS value FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT p_type || '.' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_brand END AS value FROM part WHERE p_partkey % 15 <> 0)
 SELECT coalesce(o.path, n.path) AS path, o.value AS old, n.value AS new, starts_with(coalesce(o.path, n.path), 'PROMO.') AS reloadable FROM o FULL JOIN n ON o.path = n.path WHERE o.value IS DISTINCT FROM n.value""")
def e24(spark, d):
    p = table(spark, d, "part").select(F.concat_ws(".", "p_type", F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("value"), "p_partkey")
    new = p.where("p_partkey % 15 <> 0").select("path", F.when(F.col("p_partkey") % 4 == 0, "new").otherwise(F.col("value")).alias("value"))
    return Q.config_diff(p.where("p_partkey % 10 <> 0"), new, ("PROMO",))


@query("e26_requests", f"""WITH s AS (SELECT event_id % 3000 AS request_id, min(ts) FILTER (event_type = 'click') AS a, min(ts) FILTER (event_type = 'purchase') AS b FROM events WHERE ts <= {NOW} GROUP BY 1)
 SELECT request_id, CASE WHEN b IS NOT NULL THEN 'done' WHEN a IS NULL THEN 'queued' ELSE 'active' END AS state, CAST(trunc((epoch_us(coalesce(b, {NOW})) - epoch_us(a)) / 1000000.0::DOUBLE) AS BIGINT) AS elapsed FROM s""")
def e26(spark, d):
    e = table(spark, d, "events").where(F.col("ts") <= S.now())
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "end").otherwise("queue")
    return Q.requests(e.select((F.col("event_id") % 3000).alias("request_id"), kind.alias("kind"), "ts"), S.now())


@query("e27_reaper", f"SELECT event_type, count(*) AS n FROM events WHERE ts >= {NOW} - INTERVAL 10 DAY GROUP BY 1")
def e27(spark, d):
    return Q.reap(table(spark, d, "events"), "ts", S.now(), 10).groupBy("event_type").agg(F.count("*").alias("n"))


@query("p10_keyword_triggers", "SELECT conv_id, turn, list_filter(['the', 'oner', 'que'], lambda k: contains(lower(text), k)) AS hits FROM conversations")
def p10(spark, d):
    keys = F.array(*map(F.lit, ("the", "oner", "que")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.filter(keys, lambda k: F.contains(F.lower("text"), k)).alias("hits"))


@query("p14_response_status", "SELECT conv_id, turn, CASE WHEN contains(lower(substr(text, 1, 50)), 'error') OR starts_with(text, 'Err') THEN 0 ELSE 1 END AS success FROM conversations")
def p14(spark, d):
    bad = F.lower(F.substring("text", 1, 50)).contains("error") | F.col("text").startswith("Err")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(bad, 0).otherwise(1).alias("success"))


@query("p15_previews", "SELECT conv_id, turn, substr(text, 1, 150) AS preview, (regexp_extract_all(text, '\\S+'))[1:5] AS first_words FROM conversations")
def p15(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 150).alias("preview"), F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 5).alias("first_words"))


@query("f04_strip_markdown", """SELECT doc_id, lang || ' ' || source || chr(10) || 'plain code' AS text FROM documents""")
def f04(spark, d):
    page = F.concat(F.lit("# **"), "lang", F.lit("** [" ), "source", F.lit("](http://x.y)\n> plain `code`\n```\nx\n```"))
    return table(spark, d, "documents").select("doc_id", T.strip_markdown(page).alias("text"))


@query("f05_speech_directives", "SELECT doc_id, lang AS voice, source AS speed FROM documents")
def f05(spark, d):
    text = F.concat(F.lit("Hi [[tts:voice="), "lang", F.lit(" speed="), "source", F.lit("]] there"))
    return table(spark, d, "documents").select("doc_id", T.speech_directives(text).alias("m")).select("doc_id", F.col("m")["voice"].alias("voice"), F.col("m")["speed"].alias("speed"))


@query("j06_anti_unprocessed", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def j06(spark, d):
    done = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("j05_left_entities", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j05(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query("j04_entity_join", """SELECT DISTINCT r_name, n_name, c_mktsegment FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def j04(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    joined = c.join(urgent, "c_custkey", "left_semi").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("r_name", "n_name", "c_mktsegment").distinct()
