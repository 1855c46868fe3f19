"""Periodic runs against a version that compares all words a period apart."""

import hashlib
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from support import DATA
from pyspark.sql import functions as F

from quern.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words) -> list[tuple[int, int, int]]:
    n, out, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            run = (i, j + q - i)
            if run[1] >= 2 * q and run not in seen:
                seen.add(run)
                if run[1] >= max(6, 4 * q):
                    out.append((*run, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *own, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=45), max_size=4), st.integers(0, 10**6))
def test_runs_of_any_words(texts, seed):
    rng = random.Random(seed)
    tails = []
    for w in texts:
        if len(w) > 4 and rng.random() < 0.7:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randint(3, 10)
            w = w[:a] + (w[a : a + p] * len(w))[: len(w) - a]
        tails.append(w)
    assert periods.runs_of(tails) == [brute(w) for w in tails]


def test_one_word_many_times_and_no_words():
    assert periods.runs_of([[7] * 100_000, [], [1, 2] * 3]) == [[(0, 100_000, 1)], [], []]
    assert periods.runs_of([[1, 2] * 4 + [1, 3]]) == [[(0, 9, 2)]]
    assert periods.runs_of([[5] * 5]) == [[]] and periods.runs_of([[5] * 6]) == [[(0, 6, 1)]]


def test_odd_rows(docs, nothing):
    got = periods.find(docs, periods.periodic_tail).withColumn("top", periods.strongest(F.col("runs"))).collect()
    want = Counter()
    for r in docs.collect():
        if len(r.text or "") < 12_000:
            want[expected(r.doc_id, r.text)[:5]] += 1
    seen = Counter((r.doc_id, len(r.runs), *((r.top.start, r.top.length, r.top.period) if r.top else (None,) * 3)) for r in got)
    assert not want - seen and sum(seen.values()) == docs.count()
    assert ("word", 1) in {(r.collapsed, len(r.runs)) for r in got}
    assert periods.find(nothing).count() == 0


def test_registered_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in periods.op11_periodic_runs(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    short = [k for k, t in texts.items() if len(WORD.findall(t or "")) < 700]
    assert len(short) > 100
    for k in short:
        r = got[k]
        assert (k, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(k, texts[k])
    assert sum(r.n_runs > 0 for r in got.values()) > 5
