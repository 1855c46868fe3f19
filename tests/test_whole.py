"""Operators that must not lose rows or neighbours: each failed before its operator did the whole job."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern import session
from quern.operators import assist as A
from quern.operators import documents as D
from quern.operators import memory as M
from quern.operators import retrieval as Q
from quern.operators import sequences as S
from quern.plans import assist as plans
from quern.session import table
from quern.sources import files as X


def test_ann_recall_on_the_given_embeddings(spark):
    for sf in ("sf0.001", "sf0.1"):
        v = table(spark, f"/root/testdata/{sf}", "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
        exact = {(r.query_id, r.id) for r in Q.knn(v, q, 10).collect()}
        found = {(r.query_id, r.id) for r in Q.ann(v, q, 10).collect()}
        print("recall", sf, len(exact & found) / len(exact))
        assert len(exact & found) >= 0.9 * len(exact)


def test_backend_choice_is_exact_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(A, "backend", lambda vectors, preferred="auto", **_: preferred)
    monkeypatch.setattr(A, "BACKENDS", {"exact": lambda v, q, k: "exact", "auto": lambda v, q, k: "by size"})
    assert plans.r07(spark, "/root/testdata/sf0.001") == "exact"


def test_leaders_keep_large_groups_and_long_chains(spark):
    near = [(a, b) for a in range(60) for b in range(a + 1, 60)] + [(100 + k, 101 + k) for k in range(36)]
    got = {r.id: r.leader for r in M.leaders(spark.createDataFrame(near, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(60), 0) | {100 + k: 100 + k - k % 2 for k in range(37)}


def test_patterns_however_many_hold_each_other(spark):
    # every longer pattern holds the shorter ones as text, and there are more of them than any fixed number of first rows
    lists = [[f"n{k}x{j}" for j in range(4)] for k in range(3000) for _ in range(3)] + [["a", "b"]] * 50 + [["xa", "bc"]] * 60 + [["q", "r", "s", "t"]] * 40
    got = [(r.gram, r.n) for r in S.repeated_patterns(spark.createDataFrame([(x,) for x in lists], "names array<string>"), 3, 5).collect()]
    assert got[:2] == [("xa->bc", 60), ("q->r", 40)] and "a->b" not in dict(got)
    counts = {}
    for x in lists:
        for size in (2, 3, 4):
            for i in range(len(x) - size + 1):
                g = "->".join(x[i : i + size])
                counts[g] = counts.get(g, 0) + 1
    kept = []
    for g, n in sorted(((g, n) for g, n in counts.items() if n >= 3), key=lambda r: (-r[1], r[0].count("->"), r[0])):
        if len(kept) < 5 and not any(g in k for k, _ in kept):
            kept.append((g, n))
    assert got == kept


def test_lists_out_of_the_lookback_do_not_count(spark):
    rows = [(1, f"2024-01-{d:02d}", ["a", "b"]) for d in range(1, 29)] + [(2, "2023-01-01", ["c", "d"])] * 9 + [(1, "2024-01-30", ["solo"])]
    lists = spark.createDataFrame(rows, "user_id long, at string, names array<string>")
    kept = S.recent_lists(lists, F.lit("2024-01-11"), 10).collect()
    assert len(kept) == 9 and {r.user_id for r in kept} == {1} and min(r["at"] for r in kept) == "2024-01-20"


def plain_sections(text):
    stack, out = [], []
    for line in text.split("\n"):
        if m := re.match(r"^(#{1,6})[ \t]+(.+)$", line):
            stack = [s for s in stack if s[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            out.append((len(m[1]), m[2].strip(), " > ".join(t for _, t in stack)))
    return out


def test_sections_of_whole_texts(spark):
    rng = random.Random(2)
    texts = ["\n".join("#" * rng.randint(1, 6) + f" t{k}" if rng.random() < 0.4 else f"line {k} # no heading" for k in range(rng.randint(0, 400))) for _ in range(12)] + [None, "", "####### seven"]
    rows = D.markdown_sections(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id", "pos").collect()
    for k, text in enumerate(texts):
        assert [(r.level, r.title, r.section_path) for r in rows if r.id == k] == plain_sections(text or "")


def test_chunks_are_slices_with_whole_fences():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "more. ", "\n", "\n\n", "\n# head\n", "```\ncode. and\n\nmore\n```", "x" * 30]) for _ in range(rng.randint(0, 120)))
        size, overlap = rng.randint(40, 200), rng.randint(0, 30)
        spans, at = D.split_spans(text, rng.choice(["md", "py", "js", ""]), size, overlap), 0
        for a, b in spans:
            assert a <= b and a >= at - overlap and text[at:a].strip() in ("", "#", "##", "###", "."), (text, spans)
            assert text[a:b].count("```") % 2 == 0
            at = max(at, b)
        assert not text[at:].strip()
    assert D.split_text("ab. " * 30, "", 22, 0) == ["ab. ab. ab. ab. ab. ab"] * 4 + ["ab. ab. ab. ab. ab", "ab."]


def test_query_blocks_give_the_same_lists(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(60)] + [(99, None)], "id long, text string")
    asked = spark.createDataFrame([(k, " ".join(rng.sample(words, rng.randint(1, 3)))) for k in range(12)], "query_id long, text string")
    vectors = spark.createDataFrame([(k, [rng.random(), rng.random()]) for k in range(40)], "id long, embedding array<double>")
    points = vectors.where("id < 12").withColumnRenamed("id", "query_id")
    runs = [lambda: Q.bm25(docs, asked, 4), lambda: Q.word_overlap(docs, asked, 4), lambda: Q.knn(vectors, points, 4)]
    want = [sorted(map(tuple, r().collect())) for r in runs]
    monkeypatch.setattr(Q, "blocks", lambda queries, own, most=3, real=Q.blocks: real(queries, own, most))
    assert [sorted(map(tuple, r().collect())) for r in runs] == want and all(want)


def test_search_modes_and_parents(spark):
    lists = {name: spark.createDataFrame([(1, i, 1.0, r) for r, i in enumerate(ids)], "query_id long, id long, score double, rank int") for name, ids in {"keyword": [1, 2, 3], "vector": [4, 2], "entity": [2]}.items()}
    children = spark.createDataFrame([(4, 40), (2, 20)], "chunk_id long, parent_id long")
    order = lambda mode: [r.id for r in Q.knowledge_search(lists, children, 3, mode).orderBy("rank").collect()]
    assert order("keyword") == [1, 20, 3] and order("vector") == [40, 20] and order("hybrid")[0] == 20


def test_relevance_prefers_vectors_where_both_have_one(spark):
    memories = spark.createDataFrame([(1, "u", "x", 0.0, None, None, None, [1.0, 0.0]), (2, "u", "x y", 0.0, None, None, None, None)], "id long, user_id string, content string, importance double, created_at timestamp_ntz, accessed_at timestamp_ntz, archived_at timestamp_ntz, embedding array<double>")
    asked = spark.createDataFrame([(7, "u", "x", [0.6, 0.8])], "query_id long, user_id string, text string, embedding array<double>")
    got = {r.id: r.score for r in M.recall(memories, asked, "2024-01-01 00:00:00").collect()}
    assert got == {1: round(0.5 * (0.7 * 0.6 + 0.3) + 0.125, 6), 2: 0.625}
    pairs = M.conflicts(asked.selectExpr("8 AS id", "user_id", "'not x' AS content", "embedding"), memories, 0.5).collect()
    assert [(r.new_id, r.id, r.similarity, r.kind) for r in pairs] == [(8, 1, 0.6, "negation")]


def test_changes_by_time_then_digest(spark):
    kind = "path string, modified long, digest string"
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], kind), spark.createDataFrame([("a", 1, "y"), ("b", 2, "x"), ("c", 2, "y"), ("e", 1, "x")], kind)
    assert {r.path: r.change for r in D.file_changes(old, new).collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "removed", "e": "new"}


def test_backups_come_back_and_limits_are_drawn_in(spark):
    with pytest.raises(ValueError):
        X.restored(spark, "/tmp", "..", ["t"])
    assert [X.clamped(n, 200) for n in (-5, 0, 7, 999)] == [1, 1, 7, 200]


def test_broadcasts_are_bounded_in_bytes_and_clusters_need_a_shared_folder(spark, monkeypatch):
    wide = spark.range(50).selectExpr("id", "repeat('x', 1000) AS text")
    assert "broadcast" in session.maybe_broadcast(wide)._jdf.queryExecution().logical().toString().lower() + session.maybe_broadcast(wide)._jdf.queryExecution().toString().lower()
    assert session.maybe_broadcast(wide, size=10_000) is wide

    class Far:
        class sparkContext:
            applicationId, master = "x", "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Far)
