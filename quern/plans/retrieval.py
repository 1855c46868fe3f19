"""Queries: ranked retrieval. Queries are the ``benchmark`` texts, or a stated set of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vector as V
from quern.operators import lexical as L
from quern.operators import retrieval as R
from quern.operators import substrings as X
from quern.operators import vectors as I
from quern.plans.registry import query
from quern.session import materialise, maybe_broadcast, scratch, table


def docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def each_50th(spark, d):
    return vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


def item_vectors(spark, d):
    """The vectors that stand for the benchmark queries: equal ids."""
    ids = maybe_broadcast(asked(spark, d).select(F.col("query_id").alias("id")))
    return vectors(spark, d).join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")


TERMS = f"regexp_extract_all(translate(lower(text), '{T.ACCENTED}', '{T.FOLDED}'), '[\\p{{L}}\\p{{N}}]+')"
WORDS = r"regexp_extract_all(lower(text), '\S+')"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1"


def cut(scored: str, k: int) -> str:
    return f"SELECT query_id, id, score, rank FROM (SELECT *, {RANK} AS rank FROM {scored}) WHERE rank < {k}"


BM25 = f"""tok AS (SELECT doc_id AS id, {TERMS} AS t FROM documents), stats AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok),
 q AS (SELECT item_id AS query_id, unnest(list_distinct({TERMS})) AS term FROM benchmark),
 tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 bm AS (SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.000001::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 4) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), stats GROUP BY query_id, id)"""
OVERLAP = f"""qw AS (SELECT item_id AS query_id, list_distinct({WORDS}) AS q FROM benchmark), qe AS (SELECT query_id, len(q) AS n, unnest(q) AS w FROM qw),
 dw AS (SELECT doc_id AS id, unnest(list_distinct({WORDS})) AS w FROM documents),
 ov AS (SELECT query_id, id, round(count(*) / CAST(any_value(n) AS DOUBLE), 4) AS score FROM qe JOIN dw USING (w) GROUP BY query_id, id)"""
COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query("r01_bm25", f"WITH {BM25} {cut('bm', 10)}")
def r01(spark, d):
    return R.bm25(docs(spark, d), asked(spark, d))


def stored_index(spark, d):
    """All documents by way of a first version, replacements and new ones, and deletions; every 17th is gone at the end."""
    new = docs(spark, d)
    late = F.col("id") % 5 == 3
    first = new.where(~late).withColumn("text", F.when(F.col("id") % 7 == 2, F.concat(F.lit("an older text: "), F.reverse("text"))).otherwise(F.col("text")))
    index = L.Index.created(spark, scratch(spark, "lexical"), first)
    index = index.added(new.where(late | (F.col("id") % 7 == 2)))
    return index.deleted(new.where("id % 17 = 6").select("id"))


LEFT = BM25.replace("AS t FROM documents)", "AS t FROM documents WHERE doc_id % 17 <> 6)", 1)


@query("r01_stored_index", f"WITH {LEFT} {cut('bm', 10)}")
def r01_stored(spark, d):
    hits, _ = stored_index(spark, d).searched(asked(spark, d))
    return hits


@query("r01_compacted_index", f"WITH {LEFT} {cut('bm', 10)}")
def r01_compacted(spark, d):
    hits, _ = stored_index(spark, d).compacted().searched(asked(spark, d))
    return hits


@query("r02_overlap", f"WITH {OVERLAP} {cut('ov', 10)}")
def r02(spark, d):
    return R.word_overlap(docs(spark, d), asked(spark, d))


@query("r03_cosine_topk", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) {cut('s', 10)}")
def r03(spark, d):
    return R.knn(vectors(spark, d), each_50th(spark, d))


@query("r04_l2_topk", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 / (1 + list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) {cut('s', 10)}")
def r04(spark, d):
    return R.knn(vectors(spark, d), each_50th(spark, d), metric="l2", digits=4)


@query("r05_ann")
def r05(spark, d):
    return R.ann(vectors(spark, d), each_50th(spark, d))


def kept_vectors(spark, d):
    """A kept index: a first version without every third vector and with others turned round, replacements, and deletions."""
    new = vectors(spark, d)
    late = F.col("id") % 3 == 1
    turned = F.when(F.col("id") % 4 == 2, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    index = I.VectorIndex.created(spark, scratch(spark, "vectors"), new.where(~late).select("id", turned.alias("embedding")))
    index = index.added(new.where(late | (F.col("id") % 4 == 2)).select("id", "embedding"))
    return index.deleted(new.where("id % 7 = 1").select("id"))


@query("r05_kept_index")
def r05_kept(spark, d):
    return kept_vectors(spark, d).searched(each_50th(spark, d))


@query("r06_index_contents", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE vec_id % 7 <> 1")
def r06_contents(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return kept_vectors(spark, d).vectors().select("id", F.round(total, 4).alias("total"))


@query("r06_vector_upsert", "SELECT label, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS replaced FROM embeddings WHERE NOT vec_id % 7 = 1 GROUP BY label")
def r06(spark, d):
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.lit(0).alias("new"))
    new = old.where("id % 3 = 0").withColumn("new", F.lit(1))
    gone = old.where("id % 7 = 1").select("id")
    return R.upsert(old, new).join(gone, "id", "left_anti").groupBy("label").agg(F.count("*").alias("n"), F.sum("new").alias("replaced"))


def two_lists(spark, d, k=50):
    lexical = R.top(R.bm25(docs(spark, d), asked(spark, d), k).select("query_id", "id", "score"), k)
    return lexical, R.knn(vectors(spark, d), item_vectors(spark, d), k)


VEC = f"""cs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
 lists AS (SELECT * FROM ({cut('bm', 50)}) UNION ALL SELECT * FROM ({cut('cs', 50)}))"""


def fused(base: int) -> str:
    return f"fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank + {base})), 6) AS score FROM lists GROUP BY query_id, id)"


@query("r08_rrf0", f"WITH {BM25}, {VEC}, {fused(0)} SELECT * FROM fu")
def r08(spark, d):
    return R.rrf(list(two_lists(spark, d)))


@query("r09_rrf1", f"WITH {BM25}, {VEC}, {fused(1)} SELECT * FROM fu")
def r09(spark, d):
    return R.rrf(list(two_lists(spark, d)), base=1)


@query("r10_hybrid", f"WITH {BM25}, {VEC}, {fused(0)} {cut('fu', 10)}")
def r10(spark, d):
    return R.hybrid(*two_lists(spark, d))


ENTITIES = f"""men AS (SELECT DISTINCT chunk_id, t[i] || ' ' || t[i + 1] AS name FROM (SELECT doc_id AS chunk_id, t, unnest(range(1, len(t))) AS i FROM (SELECT doc_id, {TERMS} AS t FROM documents))),
 qn AS (SELECT item_id AS query_id, t[1] || ' ' || t[2] AS name, t[1:5] AS ws FROM (SELECT item_id, {TERMS} AS t FROM benchmark)),
 ex AS (SELECT query_id, chunk_id AS id, 1.0::DOUBLE AS score FROM qn JOIN men USING (name)),
 lo AS (SELECT query_id, chunk_id AS id, 0.5::DOUBLE AS score FROM (SELECT query_id, unnest(ws) AS w FROM qn WHERE query_id NOT IN (SELECT query_id FROM ex)) JOIN
  (SELECT chunk_id, unnest(string_split(name, ' ')) AS w FROM men) USING (w) WHERE length(w) > 3),
 en AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM ex UNION ALL SELECT * FROM lo) GROUP BY query_id, id)"""


@query("r12_entity_search", f"WITH {ENTITIES} {cut('en', 10)}")
def r12(spark, d):
    return X.entity_search(docs(spark, d), named(asked(spark, d)))


def named(queries):
    """A query's first two terms as the name that it asks for, and its first five as words."""
    t = queries.select("query_id", T.terms(F.col("text")).alias("t"))
    return t.select("query_id", F.array(F.array_join(F.slice("t", 1, 2), " ")).alias("names"), F.slice("t", 1, 5).alias("words"))


@query("r13_parents", f"""WITH {OVERLAP}, h AS ({cut('ov', 20)}), p AS (SELECT *, CASE WHEN id % 5 <> 0 THEN id - id % 5 + 1000000000 ELSE id END AS parent FROM h)
 SELECT query_id, parent AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY rank) AS n FROM p) WHERE n = 1""")
def r13(spark, d):
    children = table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") - F.col("doc_id") % 5 + 1_000_000_000).alias("parent_id"))
    return R.resolve_parents(R.word_overlap(docs(spark, d), asked(spark, d), 20), children)


#: Sub-queries (a question and its halves), their lists by terms, vectors and names, fused, then parents, best of each, re-ranked.
PARTS = r"""pq AS (SELECT item_id AS q0, text AS question, regexp_extract_all(text, '\S+') AS w FROM benchmark), ph AS (SELECT *, CAST(ceil(len(w) / 2.0) AS BIGINT) AS n FROM pq),
 pl AS (SELECT q0, question, list_filter([question, array_to_string(w[1:n], ' '), CASE WHEN len(w) > 1 THEN array_to_string(w[n + 1:len(w)], ' ') END], lambda x: x IS NOT NULL) AS p FROM ph),
 sub AS (SELECT q0, question, q0 * 10 + i AS item_id, p[i + 1] AS text FROM (SELECT *, unnest(range(0, len(p))) AS i FROM pl))"""
SEARCH = f"""WITH {PARTS}, {BM25.replace('FROM benchmark', 'FROM sub')}, {ENTITIES.replace('FROM benchmark', 'FROM sub')},
 cs AS (SELECT sub.item_id AS query_id, b.vec_id AS id, {COSINE} AS score FROM sub JOIN embeddings a ON a.vec_id = sub.q0, embeddings b),
 lists AS (SELECT * FROM ({cut('bm', 30)}) UNION ALL SELECT * FROM ({cut('cs', 30)}) UNION ALL SELECT * FROM ({cut('en', 30)})), {fused(1)}, hits AS ({cut('fu', 30)}),
 up AS (SELECT query_id, id - id % 5 AS id, score, row_number() OVER (PARTITION BY query_id, id - id % 5 ORDER BY rank) AS n FROM hits),
 best AS (SELECT query_id // 10 AS query_id, id, max(score) AS score FROM up WHERE n = 1 GROUP BY ALL),
 re AS (SELECT query_id, best.id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(pq.question), '\\S+')), list_distinct(regexp_extract_all(lower(substr(d.text, 1, 1000)), '\\S+')))) / CAST(len(list_distinct(regexp_extract_all(lower(pq.question), '\\S+'))) AS DOUBLE), 4) AS score
  FROM best JOIN pq ON pq.q0 = query_id JOIN documents d ON d.doc_id = best.id) {cut('re', 6)}"""


@query("r14_kb_search", SEARCH)
def r14(spark, d):
    from quern.operators import assist as A

    sub = materialise(A.rewrite(asked(spark, d)).select((F.col("query_id") * 10 + F.col("part")).alias("query_id"), F.col("query_id").alias("question"), "text"), "sub-queries")
    own = item_vectors(spark, d).withColumnRenamed("query_id", "question")
    lists = {
        "keyword": R.bm25(docs(spark, d), sub, 30), "vector": R.knn(vectors(spark, d), sub.join(maybe_broadcast(own), "question").select("query_id", "embedding"), 30),
        "entity": X.entity_search(docs(spark, d), named(sub), 30),
    }
    children = docs(spark, d).select(F.col("id").alias("chunk_id"), (F.col("id") - F.col("id") % 5).alias("parent_id"))
    found = R.knowledge_search(lists, children, 30).withColumn("query_id", F.floor(F.col("query_id") / 10))
    return A.rerank(R.best_of([found]), docs(spark, d), asked(spark, d), k=6)


@query("r14_logged_search", f"""WITH res AS ({SEARCH}), qw AS (SELECT item_id AS query_id, list_distinct({WORDS}) AS q, len(regexp_extract_all(text, '\\S+')) AS n FROM benchmark),
 j AS (SELECT qw.query_id, res.score, len(list_intersect(qw.q, list_distinct(regexp_extract_all(lower(d.text), '\\S+')))) / CAST(len(qw.q) AS DOUBLE) AS part FROM qw JOIN res USING (query_id) JOIN documents d ON d.doc_id = res.id),
 w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS most, avg(score) OVER (PARTITION BY query_id) AS mean, count(*) OVER (PARTITION BY query_id) AS n FROM j),
 m AS (SELECT query_id, round(avg(least(part, 1)), 3) AS faithfulness, round(avg(CASE WHEN most <> 0 THEN score / most END), 3) AS relevancy, round(avg(CASE WHEN n = 1 OR score >= mean THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS context_precision FROM w GROUP BY query_id),
 l AS (SELECT query_id, list(id ORDER BY rank) AS chunk_ids FROM res GROUP BY query_id)
 SELECT qw.query_id, CASE WHEN n > 1 THEN 3 ELSE 2 END AS n_queries, coalesce(chunk_ids, []) AS chunk_ids, coalesce(faithfulness, 0) AS faithfulness, coalesce(relevancy, 0) AS relevancy, coalesce(context_precision, 0) AS context_precision FROM qw LEFT JOIN l USING (query_id) LEFT JOIN m USING (query_id)""")
def r14_logged(spark, d):
    """The whole search with what is logged about each query."""
    from quern.operators import assist as A

    return A.query_log(r14(spark, d), asked(spark, d), A.rewrite(asked(spark, d)), docs(spark, d))


@query("r16_rerank_scores", """WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE 'scores: [' || event_id % 10 || ', ' || event_id % 7 || ', 3] done' END AS reply FROM events)
 SELECT event_id, CASE WHEN reply = 'none' THEN [5.0, 5.0, 5.0]::DOUBLE[] ELSE [event_id % 10, event_id % 7, 3]::DOUBLE[] END AS scores FROM r""")
def r16(spark, d):
    e = F.col("event_id")
    reply = F.when(e % 4 == 0, "none").otherwise(F.concat(F.lit("scores: ["), (e % 10).cast("string"), F.lit(", "), (e % 7).cast("string"), F.lit(", 3] done")))
    return table(spark, d, "events").select("event_id", R.rerank_scores(reply, F.lit(3)).alias("scores"))


@query("r19_quality", f"""WITH {OVERLAP}, h AS ({cut('ov', 5)}), j AS (SELECT h.query_id, h.score, len(list_intersect(qw.q, list_distinct(regexp_extract_all(lower(d.text), '\\S+')))) / CAST(len(qw.q) AS DOUBLE) AS part
  FROM h JOIN qw USING (query_id) JOIN documents d ON d.doc_id = h.id), w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS most, avg(score) OVER (PARTITION BY query_id) AS mean, count(*) OVER (PARTITION BY query_id) AS n FROM j)
 SELECT query_id, round(avg(least(part, 1)), 3) AS faithfulness, round(avg(score / most), 3) AS relevancy, round(avg(CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN score >= mean THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS context_precision FROM w GROUP BY query_id""")
def r19(spark, d):
    results = R.word_overlap(docs(spark, d), asked(spark, d), 5).join(docs(spark, d), "id").select("query_id", "text", "score")
    return R.quality_metrics(results, asked(spark, d))


@query("r20_file_search", """WITH f AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS low FROM part), q AS (SELECT n_nationkey AS query_id, list_distinct(string_split(CASE n_nationkey % 3 WHEN 0 THEN 'red widget economy' WHEN 1 THEN 'blue bolt' ELSE 'small ring promo' END, ' ')) AS q FROM nation),
 s AS (SELECT query_id, id, round(0.3::DOUBLE * len(list_filter(q, lambda w: contains(low, w))) / len(q), 3) AS score FROM f, q), t AS (SELECT * FROM s WHERE score > 0.05) """ + cut("t", 10))
def r20(spark, d):
    k = F.col("n_nationkey")
    queries = table(spark, d, "nation").select(k.cast("long").alias("query_id"), F.when(k % 3 == 0, "red widget economy").when(k % 3 == 1, "blue bolt").otherwise("small ring promo").alias("text"))
    files = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("description"))
    return X.substring_score(queries.withColumn("query_id", F.col("query_id").cast("int")), files)


@query("r21_tool_selection", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), t AS ({cut('s', 8)})
 SELECT query_id, id FROM t UNION SELECT DISTINCT query_id, CAST(59 AS BIGINT) FROM t""")
def r21(spark, d):
    best = R.knn(vectors(spark, d), each_50th(spark, d), 8).select("query_id", "id")
    forced = best.select("query_id").distinct().withColumn("id", F.lit(59).cast("long"))
    return best.unionByName(forced.join(best, ["query_id", "id"], "left_anti"))


@query("r22_skill_match", f"""WITH {OVERLAP}, s AS (SELECT query_id, id, round(score + 0.01::DOUBLE * (id % 20), 4) AS score FROM ov), t AS (SELECT * FROM s WHERE score > 0.1) {cut('t', 3)}""")
def r22(spark, d):
    return R.word_overlap(docs(spark, d), asked(spark, d), 3, least=0.1, boost=lambda ids: 0.01 * (ids % 20))


@query("r23_step_completion", r"""WITH p AS (SELECT c.conv_id, c.turn, list_distinct(regexp_extract_all(lower(c.text), '\p{L}{3,}')) AS s, list_distinct(regexp_extract_all(lower(a.text), '\p{L}{3,}')) AS w
  FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user')
 SELECT conv_id, turn, CASE WHEN len(s) > 0 AND len(list_intersect(s, coalesce(w, []))) / CAST(len(s) AS DOUBLE) >= 0.2 THEN 'done' ELSE 'pending' END AS status FROM p""")
def r23(spark, d):
    c = table(spark, d, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), T.letter_runs(F.col("text")).alias("w"))
    steps = c.where("role = 'user'").select("conv_id", "turn", T.letter_runs(F.col("text")).alias("s"))
    both = steps.join(answers, ["conv_id", "turn"], "left")
    share = F.coalesce(T.common(F.col("s"), F.coalesce("w", F.array().cast("array<string>"))) / F.size("s").cast("double"), F.lit(0.0))
    return both.select("conv_id", "turn", F.when((F.size("s") > 0) & (F.when(F.size("s") > 0, share).otherwise(0.0) >= 0.2), "done").otherwise("pending").alias("status"))


@query("f12_vector_functions", """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS cosine,
 round(list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS l2, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings""")
def f12(spark, d):
    v = vectors(spark, d)
    one = F.broadcast(v.where("id = 0").select(F.col("embedding").alias("q")).limit(1))  # one row
    e, q = F.col("embedding"), F.col("q")
    return v.join(one).select(F.col("id").alias("vec_id"), F.round(V.cosine(e, q), 6).alias("cosine"), F.round(V.l2(e, q), 6).alias("l2"), F.round(V.norm(e), 6).alias("norm"))
