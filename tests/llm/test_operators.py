"""Each operator against a brute-force version, a round trip or held-out labels, and on odd inputs."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from support import DATA, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import encode, entries, grams, media, mixing, packing, pii, quality, ranking, secrets, simhash, token_files, toolcalls
from quern.session import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(docs):
    return docs.select("doc_id", "text").collect()


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_as_sql(spark, name):
    same(entries.queries()[name](spark, DATA), entries.oracle_sql()[name])


# media columns


def test_media_round_trip(docs):
    got = media.media_columns(docs).collect()
    want = Counter()
    for r in collected(docs):
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        want[r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.width == 64 and r.height * 64 == r.payload_bytes for r in got)


def test_media_is_read_by_plain_tar_and_by_position(spark, docs):
    import tarfile

    root = scratch(spark, "test-media")
    media.write_shards(docs, f"{root}/shards").write.parquet(f"{root}/index")
    for r in spark.read.parquet(f"{root}/index").collect():
        with tarfile.open(f"{root}/shards/{r.shard}".removeprefix("file://")) as tar:
            data = tar.extractfile(f"{r.digest}.png").read()
        assert len(data) == r.length and data[:8] == b"\x89PNG\r\n\x1a\n"


@given(st.binary(max_size=300))
def test_png_round_trip(data):
    png = media.encode_png(data)
    assert media.decode_png(png) == media.pad(data) and media.read_head(png[: media.HEAD])[3] == len(data)


def test_media_of_nothing(nothing):
    assert media.media_columns(nothing).count() == 0


# quality rules and ranking


def brute_base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_base_counts(docs, labels):
    got = quality.verdicts(docs, quality.quality_model(docs, labels))
    rows = got.collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == bag((r.doc_id, *brute_base(r.text)) for r in collected(docs))
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.quality_p <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\tü日", max_size=60), min_size=1, max_size=6))
def test_base_counts_of_any_text(texts):
    base = grams.Scan(texts).base()
    assert [tuple(int(base[c][k]) for c in quality.COUNTS) for k in range(len(texts))] == [brute_base(t) for t in texts]


def test_without_labels_the_base_rule_decides(docs, labels):
    got = quality.verdicts(docs, quality.quality_model(docs, labels.limit(0))).collect()
    assert all(r.kept != r.base_failed for r in got)


def test_rules_keep_good_and_reject_bad_labels(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    got = entries.queries()["op2_quality_rules"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in got if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in got)


def test_ranking_on_held_out_labels(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    got = entries.queries()["op6_quality_classifier"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_ranking_of_odd_inputs(docs, labels, nothing):
    model = ranking.rank_model(docs, labels)
    assert all(0 <= r.score <= 1 for r in ranking.rank(docs, model).collect())
    assert ranking.rank(nothing, model).count() == 0
    assert {r.score for r in ranking.rank(docs, ranking.rank_model(docs, labels.limit(0))).collect()} == {0.5}


# near-duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(fps))]


def test_simhash_of_odd_texts(docs):
    got = simhash.groups(docs, similarity=None).collect()
    rows = collected(docs)
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components(fps)
    least = {c: min((r.doc_id for r, x in zip(rows, comp, strict=True) if x == c and r.doc_id is not None), default=None) for c in set(comp)}
    want = Counter((r.doc_id, simhash.signed(f), least[c]) for r, f, c in zip(rows, fps, comp, strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == want


def test_links_of_dense_groups(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)} | {centre ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 6))) for _ in range(500)}
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"))
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    at = {simhash.signed(x): k for k, x in enumerate(fps)}
    comp = brute_components(fps)
    groups = Counter(comp)
    assert {k for k in at if groups[comp[at[k]]] > 1} == set(label)
    assert len({(comp[at[k]], v) for k, v in label.items()}) == len({comp[at[k]] for k in label})


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.label for r in simhash.components(edges).collect()} == {0}


def test_simhash_of_nothing(nothing):
    assert simhash.groups(nothing).count() == 0


# tool calls


def test_tool_calls_of_every_kind(spark):
    calls = spark.createDataFrame([
        (1, "a", None, 0, "search", '{"query":"x","limit":3}'), (1, "b", "a", 1, "search", '{"limit":"3","query":"x"}'), (1, "c", "b", 2, "search", '{"limit":99,"query":"x"}'),
        (1, "d", "zz", 3, "search", "not json"), (1, "e", "d", 4, "other", "{}"), (1, "f", None, 5, "lookup", '{"limit":1}'), (1, "f", None, 5, "lookup", '{"limit":1}'),
        (2, "p", "q", 0, "search", '{"query":"x","limit":3}'), (2, "q", "p", 1, "search", '{"query":"x","limit":3}'), (None, "n", None, 0, "search", '{"query":"x","limit":3}'),
    ], "conv_id long, call_id string, parent_id string, seq int, name string, arguments string")
    results = spark.createDataFrame([(1, "a", "r"), (1, "a", "r2"), (3, "lost", "x"), (None, "n", None)], "conv_id long, call_id string, content string")
    rows = {r.call_id: r for r in toolcalls.validate(toolcalls.levels(toolcalls.link(calls, results))).drop("args").collect()}
    assert {k: r.status for k, r in rows.items()} == {"a": "answered", "b": "unanswered", "c": "unanswered", "d": "unanswered", "e": "unanswered", "f": "unanswered", "p": "unanswered", "q": "unanswered", "n": "answered", "lost": "orphan"}
    assert {k: r.level for k, r in rows.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1, "f": 0, "p": None, "q": None, "n": 0, "lost": 0}
    assert {k: r.problem for k, r in rows.items()} == {"a": None, "b": "type of limit", "c": "range of limit", "d": "malformed", "e": "unknown tool", "f": "missing query", "p": None, "q": None, "n": None, "lost": None}
    assert rows["f"].copies == 1


def test_messages_are_canonical(spark):
    for r in toolcalls.op4_tool_calls(spark, DATA).limit(50).collect():
        assert r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_tool_calls_of_nothing(spark):
    assert toolcalls.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# secrets


def test_secrets_match_plain_scanning(docs):
    def brute(text):
        out = []
        for order, (kind, expression, least) in enumerate(secrets.RULES):
            for m in re.finditer(expression, text or ""):
                if not least or len(m[least[0]]) >= least[1]:
                    out.append((m.start(), order, kind, m.end()))
        return sorted(out)

    got = secrets.scan(docs).collect()
    assert Counter((r.doc_id, tuple((s.start, s.ord, s.kind, s.end) for s in r.found)) for r in got) == Counter((r.doc_id, tuple(brute(r.text))) for r in collected(docs))
    assert sum(len(r.found) for r in got) >= 4


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]{12,}") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("[0-9a-f]{32,}") == [] and secrets.trigram_query("ab|cde") == []
    assert set(secrets.trigram_query("(?i)abcd|xyz")) == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}


def test_secrets_of_nothing(nothing):
    assert secrets.scan(nothing).count() == 0


# personal data


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_pii(text):
    out = []
    for k, (kind, expression) in enumerate(BASE):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1059@.+-() %_\n", max_size=60))
def test_base_spans_of_any_text(text):
    assert pii.base(text) == brute_pii(text)


def test_pii_of_odd_texts(docs, nothing):
    model = pii.train(docs)
    got = pii.find(docs, model).collect()
    assert Counter((r.doc_id, r.base) for r in got) == Counter((r.doc_id, pii.name(brute_pii(r.text))) for r in collected(docs))
    assert all(set(r.base.split(",")) <= set(r.spans.split(",")) for r in got)
    assert pii.find(nothing, pii.train(nothing)).count() == 0
    done = {r.doc_id: r for r in pii.redact(docs, model).where("doc_id IS NOT NULL").collect()}
    whole = " ".join(r.text or "" for r in done.values())
    assert "john.doe" not in whole and "555-8791" not in whole and "[EMAIL]" in whole and "4111" not in whole
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in done.values())


def test_trees_add_wider_forms_and_leave_other_numbers(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/documents.parquet").where("text rlike '[@+]'").orderBy("doc_id").collect()]
    model = pii.Model(texts)
    find = lambda t: [t[s:e] for s, _, e in model.added(t, pii.base(t))]
    assert find("please call (603) 555-8791 now") == ["(603) 555-8791"]
    assert find("write john.doe (at) example.com please") == ["john.doe (at) example.com"]
    for clean in ("released 2021-04-12 and 12 345 678 more", "It was at the dot of noon", "pages 12-34 of 56", "version 12.34.56 of 2020"):
        assert find(clean) == []


# tokens


@pytest.fixture(scope="module")
def encoder():
    return encode.encoder(encode.vocabulary_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'slltre .,\n\t1é日²ªÀ_́"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_ids_are_the_librarys(encoder, texts):
    assert encoder.encode(texts) == encoder._whole(texts)


def ids_of(encoder, text, end):
    return np.append(np.frombuffer(encoder._whole([text or ""])[0], encoder.dtype).astype("<u4"), np.uint32(end)).astype("<u4")


def test_token_files_round_trip(spark, docs, encoder):
    root = scratch(spark, "test-tokens")
    token_files.write(docs, f"{root}/files", encode.vocabulary_path()).write.parquet(f"{root}/index")
    got = token_files.read(token_files.starts(spark.read.parquet(f"{root}/index")), f"{root}/files").orderBy("start").collect()
    want = Counter((r.doc_id, len(x := ids_of(encoder, r.text, 2)), zlib.crc32(x.tobytes())) for r in collected(docs))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)


def test_token_rows_have_equal_length_and_masks(spark, docs):
    import pyarrow as pa
    from pyarrow import fs

    root = scratch(spark, "test-tokens")
    index = token_files.write(docs, root, encode.vocabulary_path()).collect()
    for file in {r.file for r in index}:
        where = fs.FileSystem.from_uri(f"{root}/{file}")[1]
        table = pa.ipc.open_file(pa.memory_map(where)).read_all()
        assert table.schema.field("input_ids").type.list_size == 1024 == table.schema.field("mask").type.list_size
        mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["mask"].chunks])
        assert mask.sum() == sum(r.n_tokens for r in index if r.file == file)


def test_packing_is_whole(docs, encoder, nothing):
    got = packing.pack(docs, window=4096).collect()
    pieces = sorted((r.sequence_id, r.offset, r.length) for r in got)
    places = [s * 1024 + o for s, o, _ in pieces]
    assert places == [0, *np.cumsum([n for _, _, n in pieces])[:-1].tolist()] and all(o + n <= 1024 for _, o, n in pieces)
    whole = {}
    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        whole[r.doc_id] = ids_of(encoder, r.text, 0)
    for r in got:
        if r.doc_id is not None:
            x = whole[r.doc_id]
            assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(len(ids_of(encoder, r.text, 0)) for r in collected(docs))
    assert packing.pack(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 9)), min_size=1, max_size=5), st.integers(5, 90))
def test_schedule_is_a_deficit_round_robin(queues, window):
    totals, weights = [n for n, _ in queues], [w for _, w in queues]
    plan = packing.Schedule(totals, weights, window)
    seen = []
    for q, n in enumerate(totals):
        for _, size, place, _ in plan.pieces(q, 0, n, 16) if n else ():
            seen += range(place, place + size)
    assert sorted(seen) == list(range(sum(totals)))
    for w in range(plan.windows):  # while no queue is dry each window holds the target shares, to one id a queue
        then = plan.served(w + 1)
        if all(t < n for t, n in zip(then, totals, strict=True)):
            for t, p in zip(then.tolist(), weights, strict=True):
                assert abs(t - p * (w + 1) * window / sum(weights)) <= 1


# mixing


def test_mix_of_odd_sources(docs, nothing):
    got = mixing.plan(docs).collect()
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, target, total = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, sum(sizes.values())
    free = set(order)
    while True:  # brute force: cap and share anew until nothing changes
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    assert mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n")).count() <= len(order)
    assert sum(len(WORD.findall(r.text or "")) for r in mixing.mix(docs).collect()) == sum(taken.values())
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mix_is_the_same_again(docs):
    assert bag(mixing.plan(docs).collect()) == bag(mixing.plan(docs.repartition(2)).collect())
