"""Near-duplicates on sets of five words against brute force."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_components, brute_fingerprint, collected

from quern.llm import jaccard, simhash, vantage


def word_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_groups(texts):
    sets, label = [word_set(x) for x in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def edited(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return out


def samples():
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    base, passage = prose(200), prose(120)
    texts = [edited(base, rng, rng.randint(0, 6)) for _ in range(150)]  # one hot group
    texts += [passage + prose(60) for _ in range(60)]  # a common passage, but below the similarity
    for _ in range(40):
        own = prose(rng.randint(20, 150))
        texts += [own, edited(own, rng, rng.randint(1, 4))]
    chain = prose(150)
    for _ in range(20):
        texts.append(chain := edited(chain, rng, 2))
    return [" ".join(x) for x in texts]


def test_groups_are_those_of_all_pairs(spark):
    texts = samples()
    want = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.groups(docs).collect()} == dict(enumerate(want))
    stayed = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in stayed) == sorted(set(want))
    # most of these pairs are further apart than the four bits of op3
    assert len({r.component_id for r in simhash.groups(docs, similarity=None).collect()}) > len(set(want))


def test_a_shared_passage_does_not_pair_texts(spark, monkeypatch):
    """Texts at 0.59 share 90 words and have 30 of their own: pairs compared grow with the texts, not with their square."""
    rng, seen, keep = random.Random(9), [], jaccard.materialise
    passage = [f"p{k}" for k in range(90)]

    def counted(df, what):
        made = keep(df, what)
        if what == "pairs":
            seen.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "materialise", counted)
    compared = []
    for n in (150, 300):
        docs = spark.createDataFrame([(i, " ".join(passage + [f"own{rng.random()}" for _ in range(30)])) for i in range(n)], "doc_id long, text string")
        seen.clear()
        assert {r.doc_id: r.component_id for r in simhash.groups(docs).collect()} == {i: i for i in range(n)}
        compared.append(sum(seen))
    assert compared[1] <= 3 * compared[0] + 100 and compared[1] < 300 * 299 / 2 / 10


def test_fingerprints_alone_of_odd_texts(docs):
    rows = collected(docs)
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components(fps)
    least = {c: min((r.doc_id for r, x in zip(rows, comp, strict=True) if x == c and r.doc_id is not None), default=None) for c in set(comp)}
    want = Counter((r.doc_id, simhash.signed(f), least[c]) for r, f, c in zip(rows, fps, comp, strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash.groups(docs, similarity=None).collect()) == want


def test_vantage_point_trees_find_the_closest_first(spark, monkeypatch):
    """What the trees link within 4 bits is among the pairs whose sets are compared; those that aren't similar stay apart."""
    rng, seen, keep = random.Random(12), {}, jaccard.materialise

    def held(df, what):
        made = keep(df, what)
        if what == "fingerprint-pairs":
            seen["pairs"] = {frozenset((r.a, r.b)) for r in made.collect()}
        return made

    monkeypatch.setattr(jaccard, "materialise", held)
    texts = []
    for _ in range(30):
        own = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
        texts += [" ".join(own), " ".join([*own, "more"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = jaccard.sketches(docs).select("doc_id", "node", "fp").collect()
    node, fp = {r.doc_id: r.node for r in rows}, {r.doc_id: r.fp for r in rows}
    close = [k for k in range(0, 60, 2) if ((fp[k] ^ fp[k + 1]) & ((1 << 64) - 1)).bit_count() <= vantage.RADIUS]
    assert len(close) >= 20
    assert {r.doc_id: r.component_id for r in simhash.groups(docs).collect()} == {k: k - k % 2 for k in range(60)}
    assert all(frozenset((node[k], node[k + 1])) in seen["pairs"] for k in close)


def test_links_of_fingerprints_are_checked_by_whole_sets(spark):
    """Pairs that the trees would link stay apart if their sets are below the similarity."""
    texts = [" ".join(f"{side}{k}" for k in range(40)) for side in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard.sketches(docs).withColumn("fp", F.lit(5).cast("long"))
    label = {r.node: r.label for r in jaccard.labels(docs, rows.localCheckpoint()).collect()}
    assert not label
