"""The tail of logs read from the back, and table functions."""

import json
import random

import pytest

from quern.operators import documents, tables
from quern.session import scratch
from quern.sources import tail


@pytest.mark.parametrize("block", [1, 3, 7, 64, 10_000])
def test_lines_from_the_end(block):
    rng = random.Random(block)
    for _ in range(60):
        data = bytes(rng.choice(b"ab\n\n\xc3\xa9") for _ in range(rng.randint(0, 60)))
        want, at = [], 0
        for line in data.split(b"\n"):
            if line:
                want.append((at, line))
            at += len(line) + 1
        assert [(p, x) for p, x, _ in tail.lines_from_the_end(lambda a, n, data=data: data[a : a + n], len(data), block)] == want[::-1]


def test_newest_rows_of_large_logs(spark, tmp_path):
    for k in range(2):
        with (tmp_path / f"{k}.jsonl").open("w") as out:
            for i in range(40_000):
                out.write(json.dumps({"ts": f"2024-01-{k + 1:02d}T{i:06d}", "level": "ERROR" if i % 10 == 0 else "INFO", "logger": "q", "message": f"user {i % 7} did"}) + "\n" if i % 13 else "{broken\n\n")
    (tmp_path / "empty.jsonl").write_text("")
    got = tail.newest(spark, f"file://{tmp_path}", 20, "error", "USER 3").collect()
    want = [i for i in range(40_000 - 1, -1, -1) if i % 10 == 0 and i % 13 and i % 7 == 3][:20]
    assert [(r.ts, r.level, r.message) for r in got] == [(f"2024-01-02T{i:06d}", "ERROR", "user 3 did") for i in want]
    size = (tmp_path / "1.jsonl").stat().st_size
    assert max(r.bytes_read for r in got) <= 4 * tail.BLOCK < size / 4
    assert tail.newest(spark, f"file://{tmp_path}/0.jsonl", 1).first().ts == "2024-01-01T039999"


def test_chunks_as_a_table_function(spark):
    rows = [(1, "md", "# a\n\n" + "word " * 900), (2, None, None), (3, "py", "x = 1\n" * 500), (4, "", "short")]
    docs = spark.createDataFrame(rows, "id long, kind string, text string")
    tables.registered(spark)
    docs.createOrReplaceTempView("documents_to_cut")
    got = spark.sql("SELECT c.* FROM documents_to_cut d, LATERAL chunks(d.id, d.kind, d.text) c")
    want = documents.chunks(docs.fillna({"kind": ""}))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got.selectExpr("CAST(id AS STRING) AS key", "chunk_index", "content").createOrReplaceTempView("cut_documents")
    counted = spark.sql("SELECT * FROM chunk_numbers(TABLE(cut_documents) PARTITION BY key ORDER BY chunk_index)")
    assert {r.key: (r.chunks, r.characters) for r in counted.collect()} == {str(i): (len(c), sum(map(len, c))) for i, k, t in rows if (c := documents.split_text(t or "", k or ""))}
    assert scratch(spark, "x") != scratch(spark, "x")
