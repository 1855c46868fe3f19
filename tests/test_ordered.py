"""State machines in event order against a replay of sorted rows."""

import random

from pyspark.sql import functions as F

from quern.session import scratch
from quern.streaming import events, ordered


def test_machine_equals_a_replay(spark):
    import pandas as pd

    rng = random.Random(8)
    start = pd.Timestamp("2024-01-01").value // 1000
    made = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice(["error", "view", "error"]), rng.choice([None, 1.5, 4.0, -2.0]), start + rng.randrange(0, 40) * 600_000_000) for i in range(400)]
    root = scratch(spark, "test-ordered")
    spark.createDataFrame(made, "event_id long, user_id long, event_type string, value double, us long").withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(3).write.parquet(root)
    stream = spark.readStream.schema(spark.read.parquet(root).schema).option("maxFilesPerTrigger", 5).parquet(root)
    step, first, output = ordered.habits(ring=4)
    got = {(r.event_id, r.user_id): (r.cached, r.average, r.wait, r.oldest) for r in events.run(ordered.in_order(stream, step, first, output)).collect()}
    passed = max(r[4] for r in made) - 600_000_000
    want, state = {}, {}
    for i, user, kind, value, us in sorted(made, key=lambda r: (r[4], r[0])):
        if us <= passed:
            state[user], out = step(state.get(user, first), {"ts": pd.Timestamp(us * 1000), "event_type": kind, "value": value, "event_id": i})
            want[i, user] = out
    assert got.keys() == want.keys()
    assert all(g[0] == w[0] and g[2:] == w[2:] and (g[1] is None or g[1] != g[1] or abs(g[1] - w[1]) < 1e-9) for g, w in ((got[k], want[k]) for k in want))


def test_many_keys_cost_a_few_calls(spark, monkeypatch):
    """Keys are dealt to buckets, so what is written to the store goes by these and by leaves; a null key has a machine of its own."""
    monkeypatch.setattr(ordered, "BUCKETS", 4)
    rng = random.Random(4)
    made = [(i, rng.choice([None, (1 << 60) + 1, *range(300)]), rng.choice(["error", "view"]), rng.randrange(1, 900) * 1_000_000) for i in range(1500)]
    root, out = scratch(spark, "test-buckets"), scratch(spark, "test-buckets-out")
    spark.createDataFrame(made, "event_id long, user_id long, event_type string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(2).write.parquet(root)
    step = lambda n, row: (n + 1, (n, row["user_id"] is None))
    ran = ordered.in_order(spark.readStream.schema(spark.read.parquet(root).schema).parquet(root), step, 0, "place long, nobody boolean", late="0 seconds", reads=())
    query = ran.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    assert sum(s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]) < 60
    want, seen = {}, {}
    for i, user, _, _ in sorted(made, key=lambda r: (r[3], r[0])):
        want[i] = (user, seen.get(user, 0), user is None)
        seen[user] = seen.get(user, 0) + 1
    assert {r.event_id: (r.user_id, r.place, r.nobody) for r in spark.read.schema(ran.schema).parquet(f"{out}/rows").collect()} == want
