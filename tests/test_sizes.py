"""Faults that showed on larger tables, on frames small enough for a test."""

from pyspark.sql import functions as F

from quern.operators import memory as M


def test_summary_keeps_the_blank_at_its_start(spark):
    rows = [(1, 0, "first"), (1, 1, "x" * 99), (2, 0, None), (3, 0, "a"), (3, 1, None), (3, 2, "b")]
    chat = spark.createDataFrame(rows, "user_id long, id long, content string")
    assert {r.user_id: r.summary for r in M.summary(chat, 100).collect()} == {1: " " + "x" * 99, 2: None, 3: "a b"}


def test_close_pairs_judge_the_rounded_cosine(spark):
    from math import sqrt

    from quern.operators import similarity as W

    rows = [(1, [1.0, 0.0], 0), (2, [0.2999996, sqrt(1 - 0.2999996**2)], 0), (3, [0.2999994, -sqrt(1 - 0.2999994**2)], 0)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    assert [tuple(r) for r in W.close_pairs(v, 0.3).collect()] == [(1, 2, 0.3)]


def test_best_rows_are_those_of_a_sort_and_hold_no_more(spark):
    import numpy as np

    from quern.operators.retrieval import Best

    rng = np.random.default_rng(3)
    score, ids = np.round(rng.standard_normal((5, 900)), 1), rng.permutation(900)
    score[:, 300:500] = -np.inf
    score[4] = 1.0  # copies
    score[3, 2:] = -np.inf
    best = Best(5, 7)
    for at in range(0, 900, 100):
        best.add(score[:, at : at + 100], ids[at : at + 100])
        assert len(best.q) <= 35
    want = {(q, s, i) for q in range(5) for s, i in sorted((-s, i) for s, i in zip(score[q], ids) if s > -np.inf)[:7]}
    assert {(q, -s, i) for q, s, i in zip(best.q, best.score, best.id)} == want


def test_approximate_search_shuffles_no_pairs(spark):
    import numpy as np

    from quern.operators import retrieval as R

    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)], "id long, embedding array<float>")
    q = v.where("id < 6").select(F.col("id").alias("query_id"), "embedding")
    found = R.ann(v, q, 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.query_id: r.id for r in found.where("rank = 0").collect()} == {k: k for k in range(6)}
    assert R.ann(v, q.limit(0), 3).count() == 0


def test_machine_asks_the_store_by_leaves_not_rows(monkeypatch):
    """A replay of shuffled rows against a store that counts its calls, with leaves of four rows."""
    import random

    import pandas as pd

    from quern.streaming import ordered

    calls = []

    class Store:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name in ("getMapState", "getValueState"):
                    return Store()
                if name in ("updateValue", "update"):
                    self.held[a[0] if name == "updateValue" else ()] = a[-1]
                elif name == "removeKey":
                    del self.held[a[0]]
                elif name in ("getValue", "get"):
                    return self.held[a[0] if a else ()]
                elif name == "exists":
                    return () in self.held
                elif name == "registerTimer":
                    self.held[a[0]] = True
                elif name == "deleteTimer":
                    del self.held[a[0]]
            return call

    class Passed:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    monkeypatch.setattr(ordered, "LEAF", 4)
    rng, timers, now = random.Random(5), Store(), Passed()
    machine = ordered.Machine("k", "ts", "i", lambda state, row: (state + 1, (state,)), 0, ["i", "k", "place"])
    machine.init(timers)
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=rng.randrange(40) * (1 if i < 60 else 5))) for i in range(120)]
    start, out = pd.Timestamp("2024-01-01").value // 1_000_000, []
    for upto, some in ((-1, rows[:50]), (19, rows[50:60]), (100, [r for r in rows[60:] if r[1].value // 1_000_000 > start + 19]), (500, [])):
        rng.shuffle(some)
        if some:
            list(machine.handleInputRows(("a",), iter([pd.DataFrame(some[:20], columns=["i", "ts"]), pd.DataFrame(some[20:], columns=["i", "ts"])]), None))
        now.at = start + upto
        while any(t <= now.at for t in timers.held):
            frames = list(machine.handleExpiredTimer(("a",), now, None))
            assert all(len(f) <= max(4, int(f.i.map(dict(rows)).value_counts().max())) for f in frames)
            out += [tuple(r) for f in frames for r in f.itertuples(index=False)]
    want = sorted((r for r in rows if r in rows[:60] or r[1].value // 1_000_000 > start + 19), key=lambda r: (r[1], r[0]))
    assert out == [(i, "a", n) for n, (i, _) in enumerate(want)]

    # a key's rows that come and pass at once: few calls, however many rows
    monkeypatch.setattr(ordered, "LEAF", 1024)
    machine.init(Store())
    calls.clear()
    list(machine.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["i", "ts"])]), None))
    list(machine.handleExpiredTimer(("a",), now, None))
    assert len(calls) < 20


def test_habits_round_as_sql_does(spark, tmp_path):
    """Averages next to halves: the scaled double decides, not the digits that are printed."""
    from support import duck, rows_of

    from quern.plans import catalogue

    rows = [(k, f"2024-01-01 00:{k:02d}:00", 1 if k < 30 else 2, "view", round(33.3035545 + k * 0.0000035, 7)) for k in range(60)]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    made.coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for p in (tmp_path / "made").iterdir():
        p.unlink()
    (tmp_path / "made").rmdir()
    assert rows_of(catalogue.queries()["t09_habits"](spark, str(tmp_path))) == duck(catalogue.oracle_sql()["t09_habits"], str(tmp_path))[1]


def test_texts_give_k_rows_a_query_and_task_in_bounded_batches(spark):
    from quern.operators import retrieval as R
    from quern.session import BATCH_ROWS

    docs = spark.range(3000).select("id", F.concat(F.lit("alpha beta w"), "id").alias("text")).coalesce(1)
    asked = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 1, 1.0)], "query_id long, number int, weight double")
    numbers = spark.createDataFrame([("alpha", 0), ("w2999", 1)], "term string, number int")
    held = R.postings_of(docs, numbers, lambda c: F.split(c, " "))
    score = lambda k, least=0.0: R.term_scores(held, asked, lambda tf, size: tf * 1.0, k, least)
    assert sorted(map(tuple, score(2).collect())) == [(1, 0, 0.5), (1, 2999, 1.0), (2, 2999, 1.0)]
    assert score(None).count() == 3001 and score(None, 0.6).count() == 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS


def test_thresholds_rank_nothing(spark):
    from quern.plans import catalogue

    found = catalogue.queries()["p07_score_threshold"](spark, "/root/testdata/sf0.001")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_hashed_embedding_hashes_a_word_once(spark):
    from quern.operators import documents as D

    rows = [(0, None), (1, ""), (2, "b a  A\n" * 9 + "c"), (3, " ".join(f"w{k}" for k in range(400)))]
    df = spark.createDataFrame(rows, "id long, text string").select("id", D.hashed_embedding(F.col("text")).alias("e"), F.transform(F.regexp_extract_all(F.lower(F.substring("text", 1, 2000)), F.lit(r"\S+"), F.lit(0)), lambda w: F.xxhash64(w)).alias("h"))
    assert df.select("e")._jdf.queryExecution().analyzed().toString().count("xxhash64") <= 2
    for r in df.collect():
        raw = [0.0] * 32
        for h in r.h or ():
            raw[h % 32] += 1.0 if h > 0 else -1.0
        size = sum(x * x for x in raw) ** 0.5
        assert all(abs(e - (x / size if size else 0.0)) < 1e-7 for e, x in zip(r.e, raw, strict=True))


def test_sets_that_only_share_frequent_words_are_not_written_as_pairs(spark, monkeypatch):
    from quern.operators import similarity as W

    held = W.materialise
    written = []

    def counted(df, what):
        out = held(df, what)
        written.append(out.count())
        return out

    monkeypatch.setattr(W, "materialise", counted)
    some = [(i, f"x z{i % 10} u{i}") for i in range(40)] + [(100 + i, " ".join([f"z{i % 10}", *(f"f{i}-{k}" for k in range(9))])) for i in range(450)]
    pairs, _ = W.similar_sets(spark.createDataFrame(some, "id long, text string"), F.split("text", " "), 0.3)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 10 == b % 10}
    assert max(written) < 40 * 39 // 2


def test_kept_index_scores_a_few_queries_at_a_time(spark, monkeypatch):
    import numpy as np

    from quern.operators import vectors as I
    from quern.session import scratch

    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(16)]) for i in range(300)], "id long, embedding array<float>")
    q = v.where("id < 9").select(F.col("id").alias("query_id"), "embedding")
    index = I.VectorIndex.created(spark, scratch(spark, "test-vectors"), v)
    at_once = sorted(map(tuple, index.searched(q, 3).collect()))
    monkeypatch.setattr(I, "SCORES", 8)  # one query at a time
    assert sorted(map(tuple, index.searched(q, 3).collect())) == at_once and len(at_once) == 27


def test_ranks_of_all_rows_are_given_by_ranges(spark, monkeypatch):
    from quern.operators import retrieval as R

    held, written = R.materialise, []
    monkeypatch.setattr(R, "RANKED", 50)
    monkeypatch.setattr(R, "materialise", lambda df, what: written.append(held(df, what)) or written[-1])
    rows = [(q, i, float(i * 7 % 4)) for q, n in ((1, 400), (2, 3), (3, 90)) for i in range(n)]
    got = R.ranked(spark.createDataFrame(rows, "query_id long, id long, score double").repartition(5))
    want = {(q, i): k for n in (1, 2, 3) for k, (q, i, _) in enumerate(sorted((r for r in rows if r[0] == n), key=lambda r: (-r[2], r[1])))}
    assert got.columns == ["query_id", "id", "score", "rank"] and {(r.query_id, r.id): r.rank for r in got.collect()} == want
    assert max(r["count"] for r in written[-1].groupBy("_range").count().collect()) < 200
