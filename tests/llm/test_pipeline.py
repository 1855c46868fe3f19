"""The corpus pipeline stage by stage, each judged on its own input."""

import corpus_pipeline
from support import DATA

from quern.llm import pii, simhash
from quern.session import materialise, table


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    held = []
    for name, stage in corpus_pipeline.STAGES:
        held.append(docs)
        docs = materialise(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == held[0].columns
    rules, near, personal, mixed = held[1:]
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    kept = {r.doc_id for r in rules.collect()}
    good = {r.doc_id for r in held[0].collect() if labels.get(r.doc_id) == 1}
    assert len(kept & good) >= 0.9 * len(good)
    groups = simhash.groups(rules).collect()
    assert sorted(r.doc_id for r in near.collect()) == sorted({r.component_id for r in groups})
    assert personal.count() == near.count()
    assert not [r for r in personal.collect() if pii.base(r.text)]
    assert {r.doc_id for r in mixed.collect()} <= kept
    n = {}
    for r in docs.collect():
        n[r.sequence_id] = n.get(r.sequence_id, 0) + r.length
    assert all(n[k] == 1024 for k in range(max(n)))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).limit(1).count() == 1


def test_entry_names_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert not set(entry.oracle_sql()) - set(names)
