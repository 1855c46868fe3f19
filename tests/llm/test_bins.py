"""Best-fit packing: ids of the plain library, whole bins, bounds, and results near the best."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from support import DATA
from tokenizers import Tokenizer

from quern.llm import bins, encode

PATH = encode.vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def checked(plain, texts, rows, length=bins.LENGTH):
    """Every id of every (doc_id, text) in one piece at one place; the number of sequences."""
    want = defaultdict(int)
    for doc_id, text in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            want[doc_id, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in places.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end <= length
    return len(places)


def test_ids_are_those_of_the_library(plain):
    enc = bins.WordEncoder(PATH)
    assert enc.cuts
    texts = ["It's WE'LL  don''t ÀÉß ŉ'S 12²", "<|endoftext|> hi", "İstanbul ǅ ſ", "!'s  a b", "", "日本 ok", "x_y_z --- 'S 'T\t\r\n  tab", "Straße ÄÖÜ ẞ", "á e", "“quoted” – 1,234.5", "\U0001f600"]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_generations_forget_without_harm(plain, monkeypatch):
    monkeypatch.setattr(encode, "GENERATION", 20)
    enc, rng = bins.WordEncoder(PATH), random.Random(3)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    for _ in range(30):
        texts = [" ".join(rng.choices(words, k=25)) for _ in range(3)]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_is_no_more_than_the_best(sizes):
    best = len(sizes)

    def put(k, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if k == len(sizes):
            best = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + sizes[k] <= 20:
                put(k + 1, [*fills[:b], fills[b] + sizes[k], *fills[b + 1 :]])
        put(k + 1, [*fills, sizes[k]])

    put(0, [])
    assert -(-sum(sizes) // 20) <= bins.bound(sizes, 20) <= best


def test_crossing_keeps_whole_bins_and_every_piece():
    rng = random.Random(5)
    own = bins.Shard(sorted((rng.randint(1, 900) for _ in range(300)), reverse=True), 1000, 1)
    a, b = own.shaken(), own.shaken()
    for child in (own.crossed(a, b), own.changed(a)):
        fills = np.bincount(child, own.weights)
        assert len(child) == 300 and (fills > 0).all() and fills.max() <= 1000
    groups = lambda x: {frozenset(np.flatnonzero(x == k).tolist()) for k in range(int(x.max()) + 1)}
    assert groups(own.crossed(a, b)) & groups(b)


def test_evolution_beats_best_fit():
    rng = random.Random(7)
    own = bins.Shard(sorted((rng.randint(400, 900) for _ in range(400)), reverse=True), 2048, 1)
    first = own.worth(own.packed(list(range(400))))
    guests = []
    for _ in range(4):
        guests = own.evolved(guests)
    assert own.least <= own.worth(guests[0])[0] < first[0]


def test_odd_rows(plain, docs, nothing):
    rows = bins.pack(docs, length=64, shard=32, keep_ids=True).collect()
    checked(plain, [(r.doc_id, r.text) for r in docs.collect()], rows, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert bins.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        bins.pack(nothing, length=1 << 15)


def test_registered_query_is_near_the_bound(spark, plain):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = bins.op12_best_fit(spark, DATA).collect()
    assert checked(plain, texts, rows) <= bins.bound([r.length for r in rows]) + 1
