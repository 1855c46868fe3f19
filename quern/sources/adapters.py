"""The engine's relations (usage log, interactions, chat, memories, chunks, files, tasks) over the given tables.

Every "now" is the explicit ``AS_OF``; no operator reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import table

AS_OF = "2024-01-30 12:00:00"


def now(as_of: str = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, model, input_tokens, output_tokens, cache_read_tokens, cost_usd, ts."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"),
        (F.col("event_id") % 97).alias("output_tokens"), (F.col("event_id") % 13).alias("cache_read_tokens"), F.col("value").alias("cost_usd"), "ts",
    )


USAGE_SQL = """usage AS (SELECT event_id AS id, user_id, event_type AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
  event_id % 97 AS output_tokens, event_id % 13 AS cache_read_tokens, value AS cost_usd, ts FROM events)"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, tool, success, confidence (null for each tenth row), created_at."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("tool"), (F.col("event_type") != "error").cast("int").alias("success"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("confidence"), F.col("ts").alias("created_at"),
    )


INTERACTIONS_SQL = """interactions AS (SELECT event_id AS id, user_id, event_type AS tool, CAST(event_type <> 'error' AS INT) AS success,
  CASE WHEN event_id % 10 <> 0 THEN value END AS confidence, ts AS created_at FROM events)"""


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, id, role, content."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


CHAT_SQL = "chat AS (SELECT conv_id AS user_id, turn AS id, role, text AS content FROM conversations)"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, content, importance, created_at, accessed_at (null for each third), archived_at (set for each eleventh)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    start = F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")
    after = lambda n: start + F.make_dt_interval(hours=n.cast("int"))
    i = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        i.alias("id"), F.col("source").alias("user_id"), F.col("text").alias("content"),
        F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.2).otherwise(0.5).alias("importance"),
        after(i % 1000).alias("created_at"), F.when(i % 3 != 0, after(i % 1300)).alias("accessed_at"), F.when(i % 11 == 0, after(i % 1400)).alias("archived_at"),
    )


MEMORIES_SQL = """memories AS (SELECT d.doc_id AS id, source AS user_id, text AS content,
  CASE quality WHEN 1 THEN 0.8::DOUBLE WHEN 0 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS importance,
  TIMESTAMP '2023-12-01' + to_hours(d.doc_id % 1000) AS created_at,
  CASE WHEN d.doc_id % 3 <> 0 THEN TIMESTAMP '2023-12-01' + to_hours(d.doc_id % 1300) END AS accessed_at,
  CASE WHEN d.doc_id % 11 = 0 THEN TIMESTAMP '2023-12-01' + to_hours(d.doc_id % 1400) END AS archived_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, source, size_bytes, mime_type, accessed_at."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("."), ext).alias("name"), F.col("p_brand").alias("source"), (F.col("p_size") * 400_000).cast("long").alias("size_bytes"),
        F.when(ext == "jpg", "image/jpeg").when(ext == "png", "image/png").when(ext == "bin", "application/octet-stream").when(ext == "pdf", "application/pdf").otherwise("").alias("mime_type"),
        (F.lit("2023-11-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("p_partkey") % 90).cast("int"))).alias("accessed_at"),
    )


EXTENSIONS = ("md", "txt", "py", "png", "pdf", "bin", "json", "jpg", "go")
FILES_SQL = f"""files AS (SELECT *, CASE WHEN ext = 'jpg' THEN 'image/jpeg' WHEN ext = 'png' THEN 'image/png' WHEN ext = 'bin' THEN 'application/octet-stream' WHEN ext = 'pdf' THEN 'application/pdf' ELSE '' END AS mime_type
  FROM (SELECT p_partkey AS id, p_name || '.' || ext AS name, ext, p_brand AS source, CAST(p_size AS BIGINT) * 400000 AS size_bytes, TIMESTAMP '2023-11-01' + to_days(CAST(p_partkey % 90 AS INT)) AS accessed_at
  FROM (SELECT *, [{', '.join(f"'{e}'" for e in EXTENSIONS)}][p_partkey % {len(EXTENSIONS)} + 1] AS ext FROM part)))"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, task_type, status, next_run_at."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("task_type"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"), F.col("o_orderdate").alias("next_run_at"),
    )


TASKS_SQL = """tasks AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS task_type,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, o_orderdate AS next_run_at FROM orders)"""
