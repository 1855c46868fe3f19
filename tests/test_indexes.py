"""Stored indexes and look-ups against what a scan of everything gives."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA

from quern.operators import lexical, retrieval, sequences, substrings, vectors
from quern.operators.segments import Store
from quern.session import scratch


def bag(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(2)
    kinds = [[f"{k}{i}" for i in range(60)] for k in ("red", "blue", "green", "grey")]
    return [(i, " ".join([*rng.choices(kinds[i % 4], k=rng.randint(3, 40)), f"tag{i // 9}"])) for i in range(900)] + [(900, None), (901, ""), (902, "of two kinds red1 blue2")]


def test_inverted_index_after_changes(spark, prose):
    docs = spark.createDataFrame(prose, "id long, text string")
    asked = spark.createDataFrame([(1, "red1 red2 tag17"), (2, "blue7 green5"), (3, "nothing here"), (4, "red9 red9 kinds"), (5, None), (6, "tag30 blue1 blue2 blue3")], "query_id long, text string")
    late = F.col("id") % 3 == 0
    root = scratch(spark, "test-lexical")
    index = lexical.Index.created(spark, root, docs.where(~late).withColumn("text", F.when(F.col("id") % 5 == 1, "red1 red2 old words").otherwise(F.col("text"))))
    before = index
    index = index.added(docs.where(late | (F.col("id") % 5 == 1))).deleted(docs.where("id % 11 = 4").select("id"))
    want = bag(retrieval.bm25(docs.where("id % 11 <> 4"), asked, 5))
    for state in (index, lexical.Index.opened(spark, root), index.compacted()):
        hits, report = state.searched(asked, 5)
        assert bag(hits.select("query_id", "id", "score", "rank")) == sorted(tuple(r) for r in want)
        counts = report.agg(F.sum("blocks"), F.sum("read")).first()
        # blocks of the other kinds aren't met, and of those that are some can't reach the fifth score
        assert counts[1] <= 0.9 * counts[0]
    # the version before is still there
    old, _ = before.searched(asked, 5)
    assert bag(old) != want
    assert [v for _, v in state.store.segments] == [index.store.version + 1] and not state.store.tombstones


def test_ranges_give_what_reaches_the_least_score(spark, prose):
    index = lexical.Index.created(spark, scratch(spark, "test-lexical-least"), spark.createDataFrame([*prose[:300], (None, "red1 red1 red1")], "id long, text string"))
    weights = spark.createDataFrame([(1, "red1", 1.0), (1, "red2", 0.5), (2, "blue1", 1.0)], "query_id long, term string, weight double")
    chosen = index.documents().select("segment", "range").distinct().crossJoin(weights.select("query_id").distinct())
    every = {(r.query_id, r.id): r.score for r in index._scored(chosen, weights, 20.0).collect()}
    assert {q for q, _ in every} == {1, 2} and (1, None) in every
    some = index._scored(chosen.withColumn("least", F.expr("if(query_id = 1, 1.0D, NULL)")), weights, 20.0).collect()
    assert {(r.query_id, r.id): r.score for r in some} == {k: s for k, s in every.items() if k[0] == 2 or s >= 0.9999}
    assert len(some) < len(every)


def test_ranges_are_regrouped_without_a_shuffle(spark, prose):
    ranges = lexical.forward(spark.createDataFrame(prose, "id long, text string").coalesce(1))
    rows = ranges.select(F.explode(F.arrays_zip("ids", "lens", "terms", "tfs")).alias("d")).selectExpr("d.ids AS id", "d.lens AS len", "d.terms AS terms", "d.tfs AS tfs").where("id % 3 <> 0")
    made = lexical.regrouped(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert [len(r.ids) for r in got[:-1]] == [lexical.RANGE] * (len(got) - 1) and len({r["range"] for r in got}) == len(got)
    every = lambda some: [(r.id, r.len, r.terms, r.tfs) for r in some]
    assert [x for r in got for x in zip(r.ids, r.lens, r.terms, r.tfs, strict=True)] == every(rows.collect())


def test_fronts_as_all_pairs():
    rng = np.random.default_rng(3)
    block, tf, size = rng.integers(0, 40, 400), rng.integers(1, 5, 400), rng.integers(1, 9, 400)
    got = sorted((block[k], tf[k], size[k]) for k in lexical.fronts(block, tf, size))
    every = {(b, t, s) for b, t, s in zip(block, tf, size, strict=True)}
    assert got == sorted((b, t, s) for b, t, s in every if not any(b == c and (u >= t and z <= s) and (u, z) != (t, s) for c, u, z in every))
    assert not len(lexical.fronts(block[:0], tf[:0], size[:0]))


def test_two_writers_of_one_version(spark, prose):
    docs = spark.createDataFrame(prose[:20], "id long, text string")
    index = lexical.Index.created(spark, scratch(spark, "test-writers"), docs)
    index.deleted(docs.where("id = 1").select("id"))
    with pytest.raises(Exception, match="exist"):
        index.deleted(docs.where("id = 2").select("id"))
    assert Store.opened(spark, index.store.root).version == 2


def test_empty_index(spark):
    nothing = spark.createDataFrame([], "id long, text string")
    index = lexical.Index.created(spark, scratch(spark, "test-empty"), nothing)
    hits, _ = index.searched(spark.createDataFrame([(1, "word")], "query_id long, text string"))
    assert hits.count() == 0


@pytest.mark.parametrize("seed", [1])
def test_vector_index_recall_after_changes(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((3000, 32))
    v[5] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    every = spark.createDataFrame([*rows, (9999, None)], "id long, embedding array<float>")
    root = scratch(spark, "test-vectors")
    late = F.col("id") % 3 == 1
    index = vectors.VectorIndex.created(spark, root, every.where(~late).withColumn("embedding", F.when(F.col("id") % 4 == 2, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))))
    index.added(every.where(late | (F.col("id") % 4 == 2))).deleted(every.where("id % 7 = 1").select("id"))
    index = vectors.VectorIndex.opened(spark, root)
    asked = every.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    left = every.where("embedding IS NOT NULL AND id % 7 <> 1")
    want = {(r.query_id, r.id): r.score for r in retrieval.knn(left, asked, 10).collect()}
    got = {(r.query_id, r.id): r.score for r in index.searched(asked, 10, read=0.1).collect()}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got.keys() & want.keys())
    assert index.vectors().count() == left.count()


def test_vector_index_of_the_given_table(spark):
    every = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = every.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = vectors.VectorIndex.created(spark, scratch(spark, "test-given"), every)
    want = {(r.query_id, r.id) for r in retrieval.knn(every, asked, 10).collect()}
    # the registered query's settings: a twentieth of the vectors is read for a query
    assert len({(r.query_id, r.id) for r in index.searched(asked).collect()} & want) >= 0.9 * len(want)


def test_vector_search_shuffles_k_rows_a_query_and_task(spark):
    rng = np.random.default_rng(8)
    every = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((2500, 16)))], "id long, embedding array<float>")
    asked = every.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = vectors.VectorIndex.created(spark, scratch(spark, "test-few"), every)
    found = index._block(asked, 400, 0.8, 5)
    rows = found.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count"), F.count_distinct("query_id")).first()
    assert tuple(rows) == (5, 50)
    # a list is a file, with the codes beside the vectors
    held = index.vectors()
    assert len(held.inputFiles()) == held.select("list").distinct().count()
    # codes decide where there are more vectors than candidates: the best of very few are still the query itself
    assert {(r.query_id, r.id) for r in index.searched(asked, 1, read=0.001).collect()} == {(i, i) for i in range(0, 2500, 50)}


def test_strings_in_texts(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices("abcü ", k=rng.randint(0, 40)))) for i in range(300)] + [(300, None)]
    strings = ["", "a", "ü", "ab", "b ", "abc", "cab", "abca", "aaaa", "zzz", "ü b", "abcabcabc"]
    got = substrings.holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(s,) for s in strings], "string string"))
    assert bag(got) == sorted((i, s) for i, t in texts for s in strings if s and s in (t or ""))
    assert substrings.holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([("",)], "string string")).count() == 0


def test_names_in_texts(spark):
    texts = [(1, "Alpha beta alpha beta gamma"), (2, "alpha"), (3, None), (4, "beta, gamma! beta"), (5, "alphabet a")]
    names = ["alpha beta", "beta gamma", "alpha", "gamma beta", "a", ""]
    got = substrings.naming(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert bag(got) == [(1, "alpha"), (1, "alpha beta"), (1, "beta gamma"), (4, "beta gamma"), (4, "gamma beta"), (5, "a")]
    assert substrings.naming(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "name string")).count() == 0


CRON = ["*/20 6 * * 1", "* * * * *", "59 23 31 12 *", "0 0 29 2 *", "5 */7 1-7 * 0,3", "30 4 * 2,11 *", "15,45 3 31 * *", "0 12 13 * 5", "0 0 30 2 *"]


@pytest.mark.parametrize("expression", CRON)
def test_next_run_is_that_of_a_scan(spark, expression):
    rng = random.Random(expression)
    start = dt.datetime(2023, 1, 1)
    times = [start + dt.timedelta(seconds=rng.randrange(3 * 366 * 86400)) for _ in range(30)] + [dt.datetime(2024, 2, 28, 23, 59, 30), dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2024, 1, 31, 3, 44, 59)]
    fields = [set(sequences.field_values(n, p)) for n, p in zip(sequences.FIELDS, expression.split(), strict=True)]

    def scan(t):
        at = t.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        end = at + dt.timedelta(days=366)
        while at <= end:
            if at.day not in fields[2] or at.month not in fields[3] or (at.weekday() + 1) % 7 not in fields[4]:
                at = (at + dt.timedelta(days=1)).replace(hour=0, minute=0)
            elif at.hour not in fields[1]:
                at = (at + dt.timedelta(hours=1)).replace(minute=0)
            elif at.minute not in fields[0]:
                at += dt.timedelta(minutes=1)
            else:
                return at
        return None

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)] + [(99, None)], "id long, ts timestamp_ntz")
    assert {r.id: r.next_run_at for r in sequences.next_run(rows, expression).collect()} == {i: scan(t) for i, t in enumerate(times)} | {99: None}


def test_cron_fields_outside_the_grammar():
    with pytest.raises(ValueError):
        sequences.field_values("minute", "1-5,9")
    assert sequences.field_values("weekday", "7") == [0] and re.match(r"\[1, 2", str(sequences.field_values("day", "1-31")))


def test_index_broadcasts_no_frame_of_many_rows_in_a_small_file(spark, prose):
    index = lexical.Index.created(spark, scratch(spark, "test-lexical-wide"), spark.createDataFrame(prose[:40], "id long, text string"))
    weights = spark.range(30_000).select(F.col("id").alias("query_id"), F.lit("red1").alias("term"), F.lit(1.0).alias("weight"))
    ranges = index.documents().where(F.array_contains("terms", "red1")).select("segment", "range").distinct().limit(1)
    chosen = spark.range(30_000).select(F.col("id").alias("query_id")).crossJoin(ranges)
    scored = index._scored(chosen, weights, 5.0)
    assert "SortMergeJoin" in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.groupBy("query_id").count().agg(F.count("*"), F.min("count") == F.max("count")).first()[:] == (30_000, True)
