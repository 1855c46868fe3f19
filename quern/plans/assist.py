"""Queries: rewriting, re-ranking, corrective search, prefixes, registered functions and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import html as H
from quern.operators import assist as A
from quern.operators import pages as P
from quern.operators import retrieval as R
from quern.plans.registry import query
from quern.plans.retrieval import OVERLAP, asked, cut, docs, each_50th, vectors
from quern.session import table

HALVES = r"""h AS (SELECT query_id, text, regexp_extract_all(text, '\S+') AS w FROM (SELECT item_id AS query_id, text FROM benchmark)), hh AS (SELECT *, CAST(ceil(len(w) / 2.0) AS BIGINT) AS n FROM h)"""


@query("r07_backend_choice", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) {cut('s', 3)}")
def r07(spark, d):
    return A.search(vectors(spark, d), each_50th(spark, d), 3, preferred="exact")  # its SQL is exact at every size


@query("r15_rerank", f"""WITH {OVERLAP}, t AS ({cut('ov', 20)}), r AS (SELECT t.query_id, t.id, round(len(list_intersect(qw.q, list_distinct(regexp_extract_all(lower(substr(d.text, 1, 1000)), '\\S+')))) / CAST(len(qw.q) AS DOUBLE), 4) AS score
 FROM t JOIN qw USING (query_id) JOIN documents d ON d.doc_id = t.id) {cut('r', 5)}""")
def r15(spark, d):
    return A.rerank(R.word_overlap(docs(spark, d), asked(spark, d), 20), docs(spark, d), asked(spark, d))


@query("r17_rewrite", f"""WITH {HALVES}, l AS (SELECT query_id, list_filter([text, array_to_string(w[1:n], ' '), CASE WHEN len(w) > 1 THEN array_to_string(w[n + 1:len(w)], ' ') END], lambda x: x IS NOT NULL) AS p FROM hh)
 SELECT query_id, CAST(i AS INT) AS part, p[i + 1] AS text FROM (SELECT query_id, p, unnest(range(0, len(p))) AS i FROM l)""")
def r17(spark, d):
    return A.rewrite(asked(spark, d))


@query("r18_corrective")
def r18(spark, d):
    find = lambda q: R.word_overlap(docs(spark, d), q, 10)
    return A.corrective(find, asked(spark, d), lambda t: A.halves(t)[1], threshold=0.6)


@query("d14_prefixed_chunks", "SELECT doc_id AS id, substr(text, 1, 80) || chr(10) || source AS content FROM documents WHERE text <> ''")
def d14(spark, d):
    own = table(spark, d, "documents").where("text <> ''")
    return A.prefixed(own.select(F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("source").alias("content")))


def plain(column: str) -> str:
    """SQL of a stripped page or title, entities decoded."""
    held = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({column}, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"
    held = f"regexp_replace(regexp_replace({held}, '^\\s+', ''), '\\s+$', '')"
    for old, new in H.FILE_ENTITIES:
        held = "replace({}, '{}', '{}')".format(held, old, new.replace("'", "''"))
    return held


BOXLESS = "html"
for box in ("nav", "footer", "header", "aside", "menu"):
    BOXLESS = f"regexp_replace({BOXLESS}, '<{box}[\\s>].*?</{box}>', '', 'gis')"


@query("d07_html_sections", f"""WITH p AS (SELECT page_id, string_split(regexp_replace({BOXLESS}, '<h([1-6])[^>]*>(.*?)</h[1-6]>', chr(1) || '\\1\\2' || chr(2), 'gis'), chr(1)) AS p FROM pages),
 s AS (SELECT page_id, unnest(range(0, len(p))) AS pos, unnest(p) AS x FROM p),
 t AS (SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN pos = 0 THEN 0 ELSE CAST(substr(x, 1, 1) AS INT) END AS level, CASE WHEN pos = 0 THEN '' ELSE substr(split_part(x, chr(2), 1), 2) END AS h, CASE WHEN pos = 0 THEN x ELSE split_part(x, chr(2), 2) END AS b FROM s)
 SELECT page_id, pos, level, {plain('h')} AS title, {plain('b')} AS body FROM t WHERE level > 0 OR {plain('b')} <> ''""")
def d07(spark, d):
    return P.sections(table(spark, d, "pages"))


def price_with_tax(price: float, rate: float) -> float:
    """A sample of a registered function."""
    if price < 1000:
        raise ValueError("too cheap")
    return round(price * (1 + rate), 2)


@query("u01_registered_function", "SELECT p_partkey, CASE WHEN p_retailprice >= 1000 THEN round(p_retailprice * 1.5::DOUBLE, 2) END AS value, CASE WHEN p_retailprice < 1000 THEN 'ValueError: too cheap' END AS error FROM part")
def u01(spark, d):
    A.registered(spark, price_with_tax)
    return table(spark, d, "part").selectExpr("p_partkey", "price_with_tax(p_retailprice, 0.5D) AS r").selectExpr("p_partkey", "round(r.value, 2) AS value", "r.error AS error")


@query("u02_hook_chain", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def u02(spark, d):
    hooks = A.Hooks()
    hooks.add("scan", lambda df: df.where("o_totalprice > 1000"), 10)
    hooks.add("scan", lambda df: df.where("no_such_column > 1"), 20)
    hooks.add("scan", lambda df: df.where("o_orderpriority = '1-URGENT'"), 30)
    return hooks.apply("scan", table(spark, d, "orders")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("h10_first_success", """SELECT query_id, provider, value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_position(['click', 'view', 'signup'], provider), value) AS n FROM (SELECT user_id AS query_id, event_type AS provider, value FROM events WHERE value > 5 AND event_type IN ('click', 'view', 'signup'))) WHERE n = 1""")
def h10(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("provider"), (F.col("value") > 5).alias("ok"), "value")
    return A.first_success(rows, ["click", "view", "signup"]).select("query_id", "provider", "value")


@query("p11_eligible", "SELECT p_partkey FROM part WHERE p_size % 3 <> 1 AND p_brand <> 'Brand#7'")
def p11(spark, d):
    size = F.col("p_size") % 3
    skills = table(spark, d, "part").select("p_partkey", F.when(size == 0, F.array(F.lit("linux"), F.lit("darwin"))).when(size == 1, F.array(F.lit("win32"))).alias("os"), F.when(F.col("p_brand") == "Brand#7", F.array(F.lit("no-such-tool"))).alias("bins"), F.lit(None).cast("array<string>").alias("env"))
    return A.eligible(skills, "linux", ["sh"], []).select("p_partkey")
