"""Queries: readers of files and structured text, exports and logs. Files are written from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.session import scratch, table
from quern.sources import files as X
from quern.sources import tail as N
from quern.sources.adapters import CHAT_SQL, MEMORIES_SQL, chat, memories


@query("s01_text_files", "SELECT source, count(*) AS n FROM documents WHERE text <> '' GROUP BY source")
def s01(spark, d):
    """Documents as JSON-free text files, one folder a source, read back as lines."""
    root = scratch(spark, "text-files")
    flat = table(spark, d, "documents").where("text <> ''").select("source", F.regexp_replace("text", r"\s+", " ").alias("value"))
    flat.write.partitionBy("source").text(root)
    return spark.read.option("wholetext", "false").text(root).groupBy("source").agg(F.count("*").alias("n"))


@query("s04_directory_scan", "SELECT 'txt' AS kind, count(*) AS n, count(*) AS read FROM (SELECT DISTINCT lang, doc_id // 1000 FROM documents)")
def s04(spark, d):
    """Files of a thousand documents' digests at most in nested folders, found by their extension; other files there are no documents."""
    root = scratch(spark, "folder")
    each = table(spark, d, "documents").select("lang", F.floor(F.col("doc_id") / 1000).alias("part"), F.coalesce(F.md5("text"), F.lit("")).alias("value"))
    each.repartition("lang", "part").write.partitionBy("lang", "part").text(root)
    # one line a language
    each.select(F.coalesce("lang", F.lit("")).alias("value")).distinct().coalesce(1).write.option("compression", "gzip").text(f"{root}/packed")
    return X.documents(spark, root).groupBy("kind").agg(F.count("*").alias("n"), F.count("text").alias("read"))


@query("s07_object_listing")
def s07(spark, d):
    return X.listing(spark, f"{d}/documents.parquet").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query("s10_log_tail", """SELECT event_id AS pos, CAST(ts AS VARCHAR) AS ts, 'ERROR' AS level, 'quern' AS logger, 'user ' || user_id || ' failed' AS message FROM events WHERE event_type = 'error' AND event_id % 9 <> 0 AND starts_with('user ' || user_id, 'user 1') ORDER BY event_id DESC LIMIT 100""")
def s10(spark, d):
    row = F.struct(F.col("ts").cast("string").alias("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.lit("quern").alias("logger"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" failed")).alias("message"))
    line = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(row))
    lines = table(spark, d, "events").select(F.col("event_id").alias("pos"), line.alias("line"))
    return X.log_tail(lines, 100, "error", "user 1")


@query("s10_log_files", """SELECT CAST(ts AS VARCHAR) AS ts, 'ERROR' AS level, 'quern' AS logger, 'user ' || user_id || ' failed' AS message FROM events WHERE event_type = 'error' AND event_id % 9 <> 0 AND starts_with('user ' || user_id, 'user 1') ORDER BY events.ts DESC LIMIT 100""")
def s10_files(spark, d):
    """The same from log files in order of time, read from their ends."""
    row = F.struct(F.col("ts").cast("string").alias("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.lit("quern").alias("logger"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" failed")).alias("message"))
    line = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(row)).alias("line")
    root = scratch(spark, "log-files")
    table(spark, d, "events").select("ts", line).repartitionByRange(4, "ts").sortWithinPartitions("ts").select("line").write.text(root)
    return N.newest(spark, root, 100, "error", "user 1").select("ts", "level", "logger", "message")


@query("s15_frontmatter", "SELECT doc_id, lang AS name, source AS keywords, length(text) AS body_length FROM documents")
def s15(spark, d):
    page = F.concat(F.lit("---\nname: "), "lang", F.lit("\n# a comment\nkeywords: \""), "source", F.lit("\"\n---\n"), "text")
    got = table(spark, d, "documents").select("doc_id", X.frontmatter(page).alias("f"))
    return got.select("doc_id", F.col("f.meta")["name"].alias("name"), F.col("f.meta")["keywords"].alias("keywords"), F.length("f.body").cast("long").alias("body_length"))


@query("s16_directives", "SELECT doc_id AS id, k AS pos, CASE k WHEN 0 THEN 'check' ELSE 'task' END AS directive, CASE k WHEN 0 THEN lang ELSE source END AS target, CASE k WHEN 0 THEN 'first' ELSE 'second' || chr(10) || 'line' END AS body FROM documents, (VALUES (0), (1)) v(k)")
def s16(spark, d):
    page = F.concat(F.lit("# boot\n## CHECK "), "lang", F.lit("\nfirst\n## Task "), "source", F.lit("\nsecond\nline\n"))
    return X.directives(table(spark, d, "documents").select(F.col("doc_id").alias("id"), page.alias("text")))


@query("s06_content_source", "SELECT url AS key, page_id AS name, md5(html) AS doc_hash FROM pages")
def s06(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("key"), F.col("page_id").alias("name"), F.md5("html").alias("doc_hash"))


@query("s13_full_read", f"WITH {MEMORIES_SQL} SELECT id, user_id, created_at FROM memories")
def s13(spark, d):
    return memories(spark, d).select("id", "user_id", "created_at").orderBy("user_id", "id")


@query("k01_markdown_export", f"WITH {MEMORIES_SQL} SELECT id, '- **[fact]** ' || content || ' _(importance: ' || importance || ')_' AS line FROM memories")
def k01(spark, d):
    return X.markdown_lines(memories(spark, d).select("id", F.lit("fact").alias("type"), "content", "importance"))


@query("k02_history_export", f"WITH {CHAT_SQL} SELECT user_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM chat GROUP BY user_id")
def k02(spark, d):
    root = scratch(spark, "export")
    X.export(chat(spark, d), root, "json")
    back = spark.read.schema("user_id long, id long, role string, content string").json(root)
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("k03_usage_export", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS cost FROM events GROUP BY 1")
def k03(spark, d):
    root = scratch(spark, "export")
    X.export(table(spark, d, "events").select("event_type", "value"), root, "csv")
    back = spark.read.schema("event_type string, value double").option("header", "true").csv(root)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("cost"))


@query("k04_surplus_backups", "SELECT source, name, pos FROM (SELECT p_brand AS source, p_name || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name || p_partkey DESC) AS pos FROM part) WHERE pos > 5")
def k04(spark, d):
    backups = table(spark, d, "part").select(F.col("p_brand").alias("source"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("modified"))
    return X.surplus(backups).select("source", "name", "pos")


@query("k04_restored_backup", "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def k04_restore(spark, d):
    root = scratch(spark, "backups")
    X.snapshots(spark, {"events": table(spark, d, "events").select("event_id", "event_type"), "labels": table(spark, d, "labels")}, root, "one")
    back = X.restored(spark, root, "one", ["events", "labels"])
    return back["events"].groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("o04_clamped_page", "SELECT p_brand AS source, p_name || p_partkey AS name, p_size AS modified FROM part ORDER BY p_size DESC, p_name || p_partkey DESC LIMIT 200")
def o04(spark, d):
    backups = table(spark, d, "part").select(F.col("p_brand").alias("source"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("modified"))
    return X.newest(backups, 5000)


@query("k05_interaction_log", "SELECT conv_id, turn, substr(text, 1, 200) AS text, length(substr(text, 1, 200)) AS n FROM conversations")
def k05(spark, d):
    root = scratch(spark, "log")
    X.append(table(spark, d, "conversations").select("conv_id", "turn", "text"), root, {"text": 200})
    return spark.read.parquet(root).select("conv_id", "turn", "text", F.length("text").cast("long").alias("n"))


@query("f16_extensions", "SELECT p_partkey, lower(regexp_extract(p_name || '.Tar.GZ', '(\\.[^./]+)$', 1)) AS ext FROM part")
def f16(spark, d):
    from quern.functions.files import extension

    return table(spark, d, "part").select("p_partkey", extension(F.concat("p_name", F.lit(".Tar.GZ"))).alias("ext"))


