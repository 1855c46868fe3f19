"""Incremental ingestion and the join of two streams."""

import pytest
from pyspark.sql import functions as F

from quern.session import scratch
from quern.streaming import events, ingest


def rows(table):
    return sorted((r.id, r.text) for r in table.rows().collect())


def test_batches_replays_and_deletions(spark):
    make = lambda *x: spark.createDataFrame(list(x), "id long, text string, seq int, gone boolean")
    table = ingest.new_table(spark, "id", "id long, text string", 4)
    one = table.applied(make((1, "a", 0, False), (2, "b", 0, None), (None, "x", 0, False), (3, "c", 0, False)), 0)
    assert rows(one) == [(1, "a"), (2, "b"), (3, "c")] and rows(table) == []
    two = one.applied(make((1, "old", 1, False), (1, "new", 2, False), (2, None, 5, True), (9, None, 0, False)), 1)
    assert rows(two) == [(1, "new"), (3, "c"), (9, None)] and rows(one) == [(1, "a"), (2, "b"), (3, "c")]
    assert two.applied(make((1, "replayed", 9, False)), 1) is two
    three = two.applied(make(), 2)
    assert rows(three) == rows(two) and dict(three.ledger) == {"stream": 2}
    # partitions without rows are no folders; another source has its own batch ids
    four = three.applied(make((1, None, 0, True), (3, None, 0, True), (9, None, 0, True)), 0, "other")
    assert rows(four) == [] and dict(four.ledger) == {"stream": 2, "other": 0}
    assert rows(ingest.Ingested.opened(spark, table.root)) == []


def test_a_killed_batch_leaves_the_old_version(spark, monkeypatch):
    make = lambda *x: spark.createDataFrame(list(x), "id long, text string, seq int, gone boolean")
    table = ingest.new_table(spark, "id", "id long, text string", 4).applied(make((1, "a", 0, False)), 0)
    keep = ingest.Ingested._committed
    monkeypatch.setattr(ingest.Ingested, "_committed", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.applied(make((1, "b", 1, False)), 1)
    monkeypatch.setattr(ingest.Ingested, "_committed", keep)
    assert rows(ingest.Ingested.opened(spark, table.root)) == [(1, "a")]
    assert rows(ingest.Ingested.opened(spark, table.root).applied(make((1, "b", 1, False)), 1)) == [(1, "b")]


def test_a_stream_goes_on_where_it_stopped(spark):
    root = scratch(spark, "test-stream")
    add = lambda *x: spark.createDataFrame(list(x), "id long, text string, seq int, gone boolean").coalesce(1).write.mode("append").parquet(f"{root}/in")
    table = ingest.new_table(spark, "id", "id long, text string", 4)
    add((1, "a", 0, False), (2, "b", 0, False))
    stream = lambda: spark.readStream.schema("id long, text string, seq int, gone boolean").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    assert rows(ingest.ingest(stream(), table.root)) == [(1, "a"), (2, "b")]
    add((2, "c", 1, False))
    add((1, None, 2, True))
    last = ingest.ingest(stream(), table.root)
    assert rows(last) == [(2, "c")]
    assert ingest.ingest(stream(), table.root).version == last.version


def test_two_streams(spark):
    root = scratch(spark, "test-pairs")
    made = [(1, 1, "start", "2024-01-01 00:00:00"), (1, 2, "end", "2024-01-01 00:30:00"), (2, 3, "start", "2024-01-01 00:00:00"), (2, 4, "end", "2024-01-01 03:00:00"), (3, 5, "start", "2024-01-01 05:00:00"), (9, 6, "end", "2024-01-01 06:00:00"), (1, 7, "end", "2024-01-01 00:45:00")]
    spark.createDataFrame(made, "request_id long, event_id long, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(root)
    own = lambda kind: spark.readStream.schema("request_id long, event_id long, kind string, ts timestamp").parquet(root).where(F.col("kind") == kind)
    got = {tuple(r) for r in events.run(events.paired(own("start"), own("end"), "1 hour")).collect()}
    # request 3 is still open: an end within the hour could follow
    assert got == {(1, 1, 2, 1800.0), (1, 1, 7, 2700.0), (2, 3, None, None)}
