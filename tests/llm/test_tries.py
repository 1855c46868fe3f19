"""The prefix trie against one made of dictionaries, with small blocks and containers so that all paths are met."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from support import DATA
from pyspark.sql import types as T

from quern.llm import tries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("head", T.StringType()), T.StructField("pos", T.StringType())])


def brute(rows, rebuild: bool) -> Counter:
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def bag(df) -> Counter:
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed: int):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(100, 130), -7, -20, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 0, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", "d  e\tf"])))
    start = [("user", "same first words"), ("assistant", "same answer"), ("user", "and more")]
    for c in range(200, 300):  # a common beginning, with copies of whole conversations
        rows += [(c, t, *x) for t, x in enumerate(start + [("assistant", f"answer {c % 7}")] * (c % 3))]
    rows += [(500, t, "user", f"turn {t % 5}") for t in range(21)] + [(501, t, "user", f"turn {t % 5}") for t in range(19)] + [(502, 3, "user", "again")] * 5
    rows += [(None, 1, "user", "none"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("block,container", [(256, 1024), (4, 3)])
def test_nodes(spark, block, container):
    rows = conversations(block)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert bag(tries.trie(df, tries.rebuilt, block, container)) == brute(rows, True)
    if block == 4:
        assert bag(tries.trie(df, block=block, container=container)) == brute(rows, False)


def test_turnless_and_empty(spark):
    # conversation 1 has fewer turns than are taken from conversation 0, which isn't there
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    assert bag(tries.trie(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), tries.rebuilt)) == brute(rows, True)
    assert tries.trie(spark.createDataFrame([], SCHEMA), tries.rebuilt).count() == 0
    assert tries.trie(spark.createDataFrame([(None, 1, "a", "b", "", "")], SCHEMA)).count() == 0


def test_registered_query(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert bag(tries.op13_prefix_trie(spark, DATA)) == brute(rows, True)
